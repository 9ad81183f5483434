"""Counts over whole texts that the quality operators share, computed slice by slice with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raggedlake.llm.text import raw_texts, slices
from raggedlake.plans.session import prepare_workers

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b"!?.,;:"
WINDOW = 8

#: n_bytes and further: what op2 uses besides.
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_digits", "n_stops", "n_distinct", "n_short"]

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repeat_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows of so many words that its text holds twice or more.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes and of the document.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        h = _mixed(doc[:n].astype(np.uint64) * _MIX + np.uint64(1))
        for k in range(window):
            h = _mixed(h * _MIX + hashes[k : k + n])
    inside = doc[:n] == doc[window - 1 :]
    starts = np.flatnonzero(inside)
    h = h[inside]
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = starts[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def stats(raw: list[bytes]) -> dict[str, np.ndarray]:
    """The counts LONGS of each text."""
    n = len(raw)
    out = {k: np.zeros(n, np.int64) for k in LONGS}
    split = [t.split() for t in raw]  # at \\x20 and \\x09-\\x0D, exactly
    for k, (t, words) in enumerate(zip(raw, split)):
        out["n_words"][k] = len(words)
        out["n_bytes"][k] = len(t)
        joined = b"".join(words)
        out["word_chars"][k] = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
        size = len(joined)
        out["n_symbols"][k] = size - len(joined.translate(None, SYMBOLS))
        out["n_upper"][k] = size - len(joined.translate(None, UPPER))
        out["n_digits"][k] = size - len(joined.translate(None, DIGITS))
        out["n_stops"][k] = size - len(joined.translate(None, STOPS))
        lines = [x for x in t.split(b"\n") if x.split(None, 1)]
        out["n_lines"][k] = len(lines)
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
        out["n_distinct"][k] = len(set(words))
    sizes = out["n_words"]
    flat = [w for x in split for w in x]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
    short = np.fromiter(map(len, flat), np.int64, len(flat)) <= 3
    doc = np.repeat(np.arange(n), sizes)
    out["n_short"] = np.bincount(doc[short], minlength=n)
    out["n_repeat_words"] = repeat_words(hashes, doc, n)
    return out


def stats_of(text: Column) -> Column:
    """A struct of the counts LONGS of a text; of a null text, zeros.

    Only the text goes to Python, in batches bounded by bytes, and only counts come back; a row's other columns stay
    where they are. Marked as not deterministic so that a filter on the counts doesn't compute them twice.
    """
    kind = pa.struct([(c, pa.int64()) for c in LONGS])

    def run(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [stats(raw_texts(b)) for b in slices([batch])]
        cols = [np.concatenate([np.empty(0, np.int64), *(p[c] for p in parts)]) for c in LONGS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))

    return F.arrow_udf(run, returnType=", ".join(f"{c} long" for c in LONGS)).asNondeterministic()(text)


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs and the counts LONGS of text_col, which go before columns of the same name."""
    prepare_workers(docs.sparkSession)
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(a) for c, a in zip(keep, names)), stats_of(F.col(text_col)).alias("_stats"))
    return rows.select(*(F.col(a).alias(c) for c, a in zip(keep, names) if c not in LONGS), *(F.col(f"_stats.{c}").alias(c) for c in LONGS))
