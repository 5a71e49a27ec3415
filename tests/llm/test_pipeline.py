"""The pipeline stage by stage against brute force on each stage's own input, and as a whole."""

import base64
import collections
import random

import corpus_pipeline as P
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cdfloom.llm.common import materialize
from cdfloom.llm.mixing import Mix, targets
from cdfloom.llm.oracles import quality_rules
from cdfloom.llm.queries import queries, vocabulary

from .test_dedup import shingles
from .test_passages import brute
from .test_tables import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=4, n=160):
    """Prose with exact and near copies, shared passages of few and many bytes, repeated rows, nulls, empties and junk."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(2, 10))) for _ in range(4000)]
    prose = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ","]) for _ in range(k))
    short = " ".join("".join(r.choices("abcd", k=2)) for _ in range(51))
    long = prose(90)
    texts = [prose(r.randint(60, 300)) for _ in range(n)]
    texts[10:14] = [texts[3]] * 4
    texts[20:24] = [texts[5] + " tail" + str(k) for k in range(4)]
    for k in range(30, 40):
        texts[k] = f"{prose(40)} {short if k % 2 else long} {prose(40)}"
    texts += [None, "", " \n ", "#$%&| " * 80, ("again and again\n" * 60), prose(8), prose(8)]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += rows[40:44] + [(None, *rows[k][1:]) for k in (44, 45, 45)] + [(None, prose(100), "en", "a", 0), (50, prose(100), "en", "b", 0)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def seen(spark, folder):
    """Name -> rows that the stage got, and rows that it gave."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        after = materialize(stage(spark, docs, folder), "test-stage")
        if name != P.STAGES[-1][0]:
            assert after.columns == columns and after.dtypes == docs.dtypes
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def rows_of(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_quality_rules(seen, folder):
    before, after = seen["quality_rules"]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    kept = con.sql(f"select doc_id, count(*) filter (kept) from ({quality_rules(P.QUALITY)}) group by 1").fetchall()
    got = collections.Counter(r["doc_id"] for r in after)
    assert {d: n for d, n in kept if n} == got and 0 < len(after) < len(before)
    assert not [r for r in after if not WORD.search(r["text"] or "")]


def test_near_dedup(seen):
    before, after = seen["near_dedup"]
    sets = [shingles(r["text"], 5) for r in before]
    group = list(range(len(before)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    of = collections.defaultdict(list)
    for i, r in enumerate(before):
        of[top(i)].append(r)
    first = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in of.values()]
    assert collections.Counter(r["doc_id"] for r in first) == collections.Counter(r["doc_id"] for r in after)
    assert len(after) < len(before) and not rows_of(after) - rows_of(before)


def test_substring_dedup(seen):
    before, after = seen["substring_dedup"]
    want = brute([(r["text"] or "").encode() for r in before], words=P.PASSAGE_WORDS)
    assert rows_of(after) == collections.Counter((r["doc_id"], t) for r, t in zip(before, want))
    assert rows_of(after) != rows_of(before) and all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing(seen):
    before, after = seen["mixing"]
    words = lambda rows: collections.Counter({s: sum(len(WORD.findall(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    size, taken = words(before), words(after)
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(sources, targets([size[s] for s in sources], Mix())):
        longest = max(len(WORD.findall(r["text"])) for r in before if r["source"] == s)
        n = sum(r["source"] == s for r in before)
        assert abs(taken[s] - t) <= 0.05 * t + 2 * longest * n ** 0.5 / 2
    many, most = rows_of(after), rows_of(before)
    assert not many - (most + most) and sum(taken.values()) > 1.2 * sum(size.values())


def test_byte_bpe(seen):
    before, after = seen["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in before)
    assert want == collections.Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in after)


def test_run_is_the_stages_in_turn(spark, folder, seen):
    key = lambda rows: collections.Counter((r["doc_id"], r["ids_sha256"], r["n_tokens"]) for r in rows)
    assert key(P.run(spark, folder).collect()) == key(seen["byte_bpe"][1])


def test_run_of_an_empty_table_and_of_nulls(spark, tmp_path):
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None), (1, None, None, None, 3), (None, "", None, None, None)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert P.run(spark, str(tmp_path / name)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
