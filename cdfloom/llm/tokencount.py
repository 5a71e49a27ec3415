"""Token counts of sections by offset-mapped attribution.

A whole text is encoded once; the byte span of every token is joined with the
spans of the text's sections.  Both lists are in order and gapless, so the
interval join is two binary searches a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import sliced
from .bpe import BytePairEncoder, encoder

#: How a token that crosses a boundary is allocated: to the section of its first
#: byte, of its last byte, or the one with most of its bytes (ties: the earlier).
RULES = ("first", "last", "most")


def attribute(ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token, and whether it crosses a boundary.

    `ends` and `section_ends`: byte offsets where tokens and sections end, ascending.
    """
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, ends - 1, "right")
    crosses = last > first
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    chosen = first.copy()
    most = np.minimum(section_ends[np.minimum(first, len(section_ends) - 1)], ends) - starts
    for step in range(1, int((last - first).max(initial=0)) + 1):
        at = np.flatnonzero(first + step <= last)
        s = first[at] + step
        inside = np.minimum(section_ends[s], ends[at]) - section_ends[s - 1]
        better = inside > most[at]
        chosen[at[better]] = s[better]
        most[at[better]] = inside[better]
    return chosen, crosses


def line_ends(data: bytes) -> np.ndarray:
    """Where the lines of a text end, each with its newline; the empty text is one empty line."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(data) else np.append(cuts, len(data))


def count_sections(enc: BytePairEncoder, texts: list[str], rule: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, tokens, crossing tokens allocated here) of every line of every text."""
    out = []
    for text, packed in zip(texts, enc.encode(texts)):
        lines = line_ends(text.encode())
        of, crosses = attribute(enc.token_ends(packed), lines, rule)
        k = len(lines)
        out.append((np.diff(lines, prepend=0), np.bincount(of, minlength=k)[:k], np.bincount(of[crosses], minlength=k)[:k]))
    return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """Per text and section (line with its newline): id, section from 0, n_bytes, n_tokens, n_crossing.

    n_tokens counts the tokens allocated to the section by `rule`; over a text
    they add up to the tokens of the whole text.  A null text counts as empty:
    one section without tokens.  Repeated ids and rows are counted row by row.
    Extra columns are not read.  An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    inner = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    arrow = pa.list_(pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in sliced(batch, "t"):
                found = count_sections(enc, part.column("t").to_pylist(), rule)
                offsets = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]).astype(np.int64))) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[c.cast(arrow) for c in columns]], names=["id", "b", "n", "x"])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([inner.schema["id"], *[T.StructField(c, longs) for c in "bnx"]])
    counted = inner.mapInArrow(count, schema)
    return counted.select("id", F.posexplode(F.arrays_zip("b", "n", "x")).alias("section", "s")).select(
        F.col("id").alias(id_col), F.col("section").cast("long").alias("section"),
        F.col("s.b").alias("n_bytes"), F.col("s.n").alias("n_tokens"), F.col("s.x").alias("n_crossing"))
