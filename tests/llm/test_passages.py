"""The substring stage of the pipeline against brute force over bytes and words."""

import collections
import random
import re

import corpus_pipeline as P
import pytest

from cdfloom.llm import suffixes
from cdfloom.llm.queries import queries

from .cases import documents
from .test_dedup import brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, length=400, words=51):
    """Texts without bytes of strings of `length` bytes, or runs of `words` words (and what follows them), that start twice."""
    strings = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    found = [[(m.start(), m[0]) for m in re.finditer(rb"[^ \t\n\x0b\f\r]+", t)] for t in texts]
    runs = collections.Counter(tuple(x for _, x in w[i:i + words]) for w in found for i in range(len(w) - words + 1))
    out = []
    for t, w in zip(texts, found):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if strings[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        for i in range(len(w) - words + 1):
            if runs[tuple(x for _, x in w[i:i + words])] > 1:
                a, b = w[i][0], w[i + words][0] if i + words < len(w) else len(t)
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(x for x, g in zip(t, gone) if not g).decode(errors="ignore"))
    return out


def stage(spark, texts):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in P.substring_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    return [out[i]["text"] for i in range(len(texts))]


def word_texts(seed=3, n=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefé", k=r.randint(1, 9)))
    shared = [[word() for _ in range(k)] for k in (49, 50, 51, 52, 90, 300)]
    out = ["", " \n", "one", "é" * 900, "x" + "é" * 900, "a b " * 60]
    for i in range(n):
        parts = [word() for _ in range(r.randint(0, 80))]
        for s in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(parts))
            parts[at:at] = s
        out.append("".join(x + r.choice([" ", " ", "\n", "  "]) for x in parts))
    return [*out, out[-1]]


def test_passage_of_51_short_words(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    passage, short = (" ".join(word() for _ in range(k)) for k in (51, 50))
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}\n{own[3]}", f"{own[4]} {short}", f"{short} {own[5]}"]
    assert stage(spark, texts) == [f"{own[0]} {own[1]}", f"{own[2]}\n{own[3]}", *texts[2:]]


@pytest.mark.parametrize("large", [2048, 1])
def test_stage_by_brute_force(spark, monkeypatch, large):
    """large=1 counts every bucket by fingerprint, the way of very large ones."""
    monkeypatch.setattr(suffixes, "LARGE_BUCKET", large)
    texts = word_texts()
    assert stage(spark, texts) == brute([t.encode() for t in texts])


def test_op7_shows_passages_apart(spark, tmp_path):
    """Runs of 51 words that take less than 400 bytes stay in the columns of the contract and go in the last two."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=3))
    own = [" ".join(word() for _ in range(60)) for _ in range(4)]
    passage = " ".join(word() for _ in range(51))
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}\n{own[3]}", *word_texts(seed=4), *[x[1] or "" for x in documents(n=40)]]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries()["op7_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    data = [t.encode() for t in texts]
    assert [(g["n_bytes"], g["n_removed"], g["n_spans"], g["n_kept"]) for g in (got[i] for i in range(len(texts)))] == [(n, gone, s, len(kept)) for n, gone, s, kept in brute_repeats(data)]
    assert [got[i]["text_without_passages"].replace("�", "") for i in range(len(texts))] == brute(data)
    assert got[0]["n_removed"] == 0 and got[0]["n_removed_with_passages"] == len(passage) + 1 and got[0]["text_without_passages"] == f"{own[0]} {own[1]}"
    assert all(g["n_removed"] <= g["n_removed_with_passages"] <= g["n_bytes"] for g in got.values())
