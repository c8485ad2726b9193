"""Token counts by a sentencepiece BPE model, with a shortcut for whole-token words.

The model's normaliser only puts a `▁` in front of a text and for each space, and no vocabulary string has a `▁` after
another character, so no merge crosses from a character into a following `▁`: a text's tokens are those of its
pre-tokens, runs of `▁` with what follows. Strings of the vocabulary that the library itself gives back as one token are
proven once per worker and counted directly; only other pre-tokens are merged, each once while it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

#: Pre-tokens that a worker remembers beside the whole-token words, and the longest one remembered.
REMEMBERED, LONGEST = 300_000, 64
_MARK = "▁"
_RUN = re.compile("▁+[^▁]*")
_models: dict[str, tuple] = {}


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the tokenizer package that every worker has; anything with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_words(sp) -> dict[str, int]:
    """Words (without their `▁`) that the model gives as exactly one token, with 1."""
    found = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if len(piece) > 1 and piece[0] == _MARK and _MARK not in piece[1:] and sp.encode(piece[1:]) == [i]:
            found[piece[1:]] = 1
    return found


def _model(path: str) -> tuple:
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a vocabulary string crosses words: pre-tokens can't be counted one by one")
        whole = whole_words(sp)
        _models[path] = sp, whole, dict(whole)
    return _models[path]


def pretokens(text: str) -> list[str]:
    """Words after one `▁`, without it; other pre-tokens in full. Only runs of `▁`, the text's last one or `▁` in the text make those."""
    if not text:
        return []
    if "  " not in text and _MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    runs = _RUN.findall(_MARK + text.replace(" ", _MARK))
    return [x[1:] if len(x) > 1 and x[1] != _MARK else x for x in runs]


def _learn(sp, known: dict[str, int], new: list[str]) -> None:
    # a lone mark has no text that gives it: the empty text has no tokens at all
    texts = [x[1:] if x[0] == _MARK else x for x in new]
    for x, text, ids in zip(new, texts, sp.encode(texts, num_threads=1), strict=True):
        known[x] = len(ids) if text else 1


def _counted(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, whole, known = _model(tokenizer_path(name))
        for b in slices(batches, "text"):
            docs = [pretokens(t or "") for t in b.column("text").to_pylist()]
            new = list(set().union(*docs) - known.keys())
            if new:
                _learn(sp, known, new)
            n = [sum(map(known.__getitem__, d)) for d in docs]
            for x in new:
                if len(x) > LONGEST:
                    del known[x]
            if len(known) > REMEMBERED + len(whole):
                known.clear()
                known.update(whole)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text; others are ignored).

    Null and empty texts have no bytes and no tokens; a null doc_id is passed through; repeated rows are counted each.
    Whole texts are read, 1 MB of them at a time, or one longer text.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
