"""Word lists, patterns and tables that results depend on."""

# All names below are fixed values.
FIELD_WORDS = (
    "名称", "分类", "措施", "条件", "防护", "信息", "日期", "编号", "沸点", "闪点", "密度", "粘度", "溶解度", "蒸气压", "温度", "途径",
    "毒性", "数据", "危害", "危险性", "处理", "运输", "法规", "外观", "气味", "pH", "状态", "颜色", "含量", "描述", "建议", "限制",
)
SECTION_HINTS = (
    ("急救", 4), ("误服", 4), ("接触眼睛", 4), ("接触皮肤", 4), ("吸入", 4), ("灭火", 5), ("消防", 5), ("泄漏", 6), ("收集", 6), ("操作", 7),
    ("储存", 7), ("接触控制", 8), ("防护", 8), ("暴露", 8), ("物理和化学", 9), ("外观", 9), ("闪点", 9), ("稳定性", 10), ("反应性", 10),
    ("分解产物", 10), ("毒性", 11), ("毒理", 11), ("生态", 12), ("环境", 12), ("废弃", 13), ("处理注意", 13), ("运输", 14), ("法规", 15), ("其他信息", 16),
)
TEXTBOX_HINTS = (
    ("reactivity", 10), ("chemical stability", 10), ("thermal decomposition", 10), ("hazardous decomposition", 10),
    ("additional information about design", 8), ("relevant safety", 15), ("this information is based", 16),
)
SECTION_TITLES = (
    (1, "Identification of the substance/mixture"), (2, "Hazards identification"), (3, "Composition/information on ingredients"), (4, "First aid measures"),
    (5, "Firefighting measures"), (6, "Accidental release measures"), (7, "Handling and storage"), (8, "Exposure controls/personal protection"),
    (9, "Physical and chemical properties"), (10, "Stability and reactivity"), (11, "Toxicological information"), (12, "Ecological information"),
    (13, "Disposal considerations"), (14, "Transport information"), (15, "Regulatory information"), (16, "Other information"),
)
COMPONENT_HEADERS = (("化学品名称", "CAS编号", "含量"), ("成分名称", "CAS号", "含量"), ("组分", "CAS", "浓度"), ("Ingredient", "CAS", "%"), ("Component", "CAS", "w/w"))
COMPONENT_CAPTIONS = ("成分", "组分", "成分/组成", "危险成分", "名称", "化学品名称")
DEFAULT_COMPONENT_HEADER = "化学品名称 | CAS编号 | 含量%（w/w）"
FULL_WIDTH, HALF_WIDTH = "＞＜～％－（）：；，　＝．、﹪", "><~%-():;, =.,%"
FULL_WIDTH_MARKS = "＞＜～％－（），；："
CAS_PLACEHOLDERS = ("商业机密", "待确认", "无单一", "无", "不适用", "无数据")
CAS_PLACEHOLDERS_EN = ("tradesecret", "businesssecret", "tradesecrets", "businesssecrets", "proprietary", "confidential", "unknown")
CAS_PLACEHOLDER_SPACED = r"(?i)^(trade\s*secrets?|business\s*secrets?|proprietary|confidential|unknown)$"
UNITS = r"\p{Nd}\s*(%|％|℃|°C|°F|mPa·?s|mPa\s*s|g/?cm3|g/?cm|g/?m3|g/?m|kg/?m3|kg/?m|mg/?L|mg/?m3|mg/?kg|ppm|mol/?L|N/?m|S/?cm|Pa\s*s|kJ|MJ|hPa|mm|mbar|bar|µm|μm)"
COLOUR_STATE = r"^(?:乳白|乳黄|白|黑|红|黄|蓝|绿|灰|棕|浅|深|无|微|淡)?[^\s\p{Z}，。]{0,6}(?:液体|乳液|粉末|粉状|固体|气体|气态|透明|不透明|胶体|糊状|膏状|色)$"
CHEMICAL_NAME = r"^(?:[A-Za-z][A-Za-z0-9\-]*|[一-鿿]{1,6})(?:醇|油|酯|烷|酸|胺|酮|醚|烃|苯|烯|醛|酚|橡胶|分散体|乳液|树脂|溶液|溶剂油|蜡)$"
GLOVE_MATERIAL = r"^(?:天然|丁腈|丁基|氟化|氯丁|氯磺化|聚氯乙烯|PVC|NBR|IIR|FKM|CR|NR)[-\s]*橡胶"
HAZARD_CLASS = r"^([^\s\p{Z}].*?)[\s\p{Z}]{2,}(未分类|类别[\s\p{Z}]*\p{Nd}+(?:[A-Z])?|\p{Nd}+(?:[A-Z]?B?类))[\s\p{Z}]*[。.]?[\s\p{Z}]*$"
NOT_HEADINGS = ("无数据资料", "无数据", "专家意见", "不适用", "未提供", "无")
LABEL_ELEMENTS = ("标签元素", "标签要素", "没有其他危险")
PICTOGRAM_LABEL, PICTOGRAM_MARK = "GHS-象形图", "[象形图]"
JOINED_P_LABEL = r"^(存储|处置|事故响应|废弃处置|补充信息)(.+)$"
HAZARD_CODE = r"^\s*[HP]\s*\p{Nd}{3}(?:\s*[+＋]\s*\.?\s*[HP]\s*\p{Nd}{3})*"
PAGE_FIXED_WORDS = ("版本", "Version", "修订", "页码", "公司", "电话", "传真", "地址", "物料", "安全技术说明书", "MSDS")
TITLE_EN = r"(?i)^SECTION\s*(\p{Nd}{1,2})\s*[:.\-]\s*(.+?)\s*$"
TITLE_CN = r"^(\p{Nd}{1,2})\s*[.、．]\s*(.+?)\s*$"
PAGE_NUMBER = r"^\p{Nd}+[\s\p{Z}]*/[\s\p{Z}]*\p{Nd}+$"
PAGE_COMPOUND = r"^([^A-Za-z0-9][^A-Za-z0-9\s\p{Z}]*)[\s\p{Z}]+([A-Za-z][\w\-]*(?:-|_)[A-Za-z0-9][\w\-]*)$"
PAGE_STRAY_LETTER = r"^[PFD][\p{L}&&[^\p{ASCII}]]"
MIXTURE_TAIL = r"\s+(\p{Nd}+(?:[±＋\-]\p{Nd}+)?\s*(?:%\s*(?:（w/w）)?|（w/w）|w/w|wt%|W/W))\s*$"
NAME_COLUMN =r"(?i)chemical\s*name|ingredient|component|化学品名称|成分名称|组分|名称|物质"
CAS_COLUMN = r"(?i)cas\s*(?:编号|号|no\.?|number|#)?(?![a-z])"
CONC_COLUMN = r"(?i)concentration|含量|浓度|percent|weight|\bw/w|%"
CAS_PLACEHOLDER_IN_TEXT = r"(?i)(proprietary|trade\s*secrets?|商业机密|待确认|无单一|confidential)"
CAS_IN_TEXT = r"\b(\p{Nd}{2,7}-\p{Nd}{2}-\p{Nd})\b"
CONC_IN_TEXT = r"([<>≤≥＞＜]?\s*\p{Nd}+(?:\.\p{Nd}+)?\s*[-~±～]\s*\p{Nd}+(?:\.\p{Nd}+)?\s*[%％]?|[<>≤≥＞＜]?\s*\p{Nd}+(?:\.\p{Nd}+)?\s*[%％]|[<>≤≥＞＜]?\s*\p{Nd}+(?:\.\p{Nd}+)?(?=\s|$))"
S9_SYNONYMS = (("PH值", "pH值"), ("蒸发速度", "蒸发速率"), ("水中溶解度", "水溶性"), ("最低初沸点", "初沸点"))
NO_DATA, SUMMARY_COLUMN, PRODUCT_NAME, PRODUCT_TYPE = "无数据", "(总结句)", "产品名称", "产品类型"
PAGE_SECTION_TITLE = "0 页眉/页脚"
SEARCH_DROPPED = r"[\s\p{Z}：:，,。；;（）()\-]"
EDGE_PUNCTUATION = "，,。；;.:：·-—–～~"
#: White space as str.strip() has it.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Fixed values of HTML: elements that begin and end a block of text; those of them that have no end tag; those that make text bold.
HTML_BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
HTML_ENDLESS = ("hr",)
HTML_BOLD = ("b", "strong")
