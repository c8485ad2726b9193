"""Automatic list numbers of paragraphs, by windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import CHUNK, carried

LEVELS = 9


def _lists(levels: DataFrame) -> DataFrame:
    """doc_id, _lists: one row for each document, its lists by num_id with start and text of each level; `more` has the levels beyond Word's nine."""
    level = F.struct("start", "lvl_text")
    found = [F.max(F.when(F.col("ilvl") == k, level)).alias(f"l{k}") for k in range(LEVELS)]
    more = F.collect_set(F.when(~F.col("ilvl").between(0, LEVELS - 1), F.struct("ilvl", "start", "lvl_text"))).alias("more")
    one = levels.where("num_id is not null").groupBy("doc_id", "num_id").agg(*found, more)
    return one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("num_id", F.struct(*[f"l{k}" for k in range(LEVELS)], "more")))).alias("_lists"))


def auto_numbers(paragraphs: DataFrame, levels: DataFrame, word_exact: bool = False) -> DataFrame:
    """paragraphs (doc_id, pos, num_id, ilvl) with `number`, '' where the list or level is not defined.

    levels: doc_id, num_id, ilvl, start, lvl_text. Level k counts from its start since a shallower level last fired; a
    template's %n shows level n as it stands: the paragraph's own number at its own level, and at other levels the next
    number to be given (1 where that level has not begun). word_exact: shallower levels show the number last given.

    Paragraphs meet their document's lists by doc_id alone, so paragraphs dealt by it (store.dealt) stay where they are.
    """
    of = ["doc_id", "num_id"]
    x = paragraphs.join(_lists(levels), "doc_id", "left").withColumn("_list", F.try_element_at("_lists", F.col("num_id"))).drop("_lists")
    text = reduce(lambda a, k: a.when(F.col("ilvl") == k, F.col(f"_list.l{k}.lvl_text")), range(1, LEVELS), F.when(F.col("ilvl") == 0, F.col("_list.l0.lvl_text")))
    text = text.otherwise(F.array_max(F.filter("_list.more", lambda v: v["ilvl"] == F.col("ilvl")))["lvl_text"])
    # what windows sort has of a list its starts and the paragraph's own text only
    x = x.withColumns({f"_s{k}": F.col(f"_list.l{k}.start") for k in range(LEVELS)} | {"_text": text}).drop("_list")
    known = F.col("_text").isNotNull()
    # paragraphs of level k before, less those before the last shallower one: what a paragraph sees before it resets deeper levels
    x = carried(x, of, ["pos"], sums={f"_n{k}": F.when(known & (F.col("ilvl") == k), 1).otherwise(0) for k in range(LEVELS)}, own=False)
    x = carried(x, of, ["pos"], {f"_b{k}": F.when(known & (F.col("ilvl") < k), F.col(f"_n{k}")) for k in range(1, LEVELS)}, own=False)
    since = lambda k: F.coalesce(f"_b{k}", F.lit(0)) if k else F.lit(0)
    x = x.withColumns({f"_c{k}": F.col(f"_n{k}") - since(k) for k in range(LEVELS)})

    def shown(k: int):
        start = F.col(f"_s{k}")
        begun = (F.col(f"_c{k}") > 0) if k else F.lit(True)  # level 0 stands at its start from the first paragraph on
        here = F.coalesce(start, F.lit(1)) + F.col(f"_c{k}")
        other = here - (1 if word_exact else 0)
        if word_exact:
            other = F.greatest(other, F.coalesce(start, F.lit(1)))
        own_default = here if k == 0 else F.when(begun, here).otherwise(F.lit(1))
        return F.when(F.col("ilvl") == k, own_default if not word_exact else here).otherwise(F.when(begun, other).otherwise(F.lit(1))).cast("string")

    # a level is worked out only for texts that show it
    at = lambda k: F.when(F.col("_text").contains(f"%{k + 1}"), shown(k)).otherwise("")
    text = reduce(lambda t, k: F.replace(t, F.lit(f"%{k + 1}"), at(k)), range(LEVELS), F.col("_text"))
    own = reduce(lambda a, k: a.when(F.col("ilvl") == k, F.coalesce(F.col(f"_s{k}"), F.lit(1)) + F.col(f"_c{k}")), range(1, LEVELS), F.when(F.col("ilvl") == 0, F.col("_s0") + F.col("_c0"))).cast("string")
    # a column of its own, null where nothing is known: the whole in one expression is more code than the JVM compiles
    x = x.withColumn("_shown", text)
    number = F.when((F.col("_shown") == "") | F.col("_shown").contains("%"), own).otherwise(F.col("_shown"))
    return x.select(*[c for c in paragraphs.columns if c != CHUNK], F.coalesce(number, F.lit("")).alias("number"))
