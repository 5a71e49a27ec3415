import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdfloom.llm import neardup, suffixes
from cdfloom.llm.components import components
from cdfloom.llm.neardup import NearDup, keep_one, near_duplicates
from cdfloom.llm.shingles import shingle_sets
from cdfloom.llm.suffixes import drop_repeats, families, find_repeats, repeated_suffixes

from .cases import SCHEMA, documents, frame

SPACE = " \t\n\x0b\f\r"


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in SPACE else c for c in low).split(" ") if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


@pytest.mark.parametrize("width, percent, leaf", [(3, 85, 64), (5, 80, 64), (3, 85, 2)])
def test_components_by_brute_force(spark, width, percent, leaf):
    """leaf=2 sends all groups through the comparison of dense nodes."""
    rows = documents(n=120)
    rules = NearDup(width=width, percent=percent, leaf=leaf, block_rows=2048 if leaf > 2 else 3, first_rounds=1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), rules).collect()}
    assert got == brute_components(rows, width, percent)


def test_null_and_repeated_ids(spark):
    r = random.Random(2)
    text = " ".join("w%d" % r.randrange(9999) for _ in range(80))
    other = " ".join("v%d" % r.randrange(9999) for _ in range(80))
    rows = [(None, text), (5, text), (5, text), (7, text), (9, other), (7, other), (11, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearDup(3, 85))
    got = collections.Counter((x["doc_id"], x["component_id"], x["kept"]) for x in out.collect())
    assert got == {(None, None, True): 1, (5, 5, True): 2, (7, 5, False): 2, (9, 5, False): 1, (11, 11, True): 1}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rows = documents(n=60)
    kept = {r["doc_id"] for r in keep_one(frame(spark, rows)).collect()}
    assert kept == {d for d, (_, _, k) in brute_components(rows, 5, 80).items() if k}


def test_shingle_counts():
    texts = [r[1] or "" for r in documents(3)]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], 3)] == [len(shingles(t, 3)) for t in texts]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


# ---- repeated substrings ----

def brute_repeats(texts, length=400):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return out


def pieces(seed, n=14):
    r = random.Random(seed)
    base = bytes(r.choices(b"abcd ", k=3000)) if seed % 3 else bytes(r.choices(b"ab", k=50)) * 60
    out = []
    for _ in range(n):
        a = r.randint(0, 1500)
        t = bytearray(base[a:a + r.randint(300, 1500)])
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(b"xyz")
        out.append(bytes(t))
    return [*out, out[0], b"", b"q" * 399, b"a" * 2000]


@pytest.mark.parametrize("seed", range(6))
def test_kernel_and_families(seed):
    texts = pieces(seed)
    starts, at = [], 0
    for t in texts:
        starts += range(at, at + max(0, len(t) - 399))
        at += len(t)
    joined = b"".join(texts)
    count = collections.Counter(joined[i:i + 400] for i in starts)
    assert repeated_suffixes(np.frombuffer(joined, np.uint8), np.array(starts)).tolist() == [count[joined[i:i + 400]] > 1 for i in starts]
    text, lo, hi, *_ = families(texts)
    assert sorted((int(a), i) for a, b, c in zip(text, lo, hi) for i in range(b, c + 1)) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 399)]


@pytest.mark.parametrize("large", [2048, 1])
def test_repeats_by_brute_force(spark, monkeypatch, large):
    """large=1 sends every bucket through counting, the way of very large ones."""
    monkeypatch.setattr(suffixes, "LARGE_BUCKET", large)
    texts = [t for s in (1, 2, 3) for t in pieces(s)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    found = find_repeats(df)
    rows = found.docs.join(found.texts, ["k1", "k2"]).select("id", "n_bytes", "n_removed", F.size("spans").alias("s"), "kept").collect()
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["s"], bytes(r["kept"])) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_awkward_documents(spark):
    rows = documents(n=60)
    want = brute_repeats([(r[1] or "").encode() for r in rows])
    out = drop_repeats(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for row, w in zip(rows, want):
        assert got[row[0]] == (None if row[1] is None else w[3].decode(errors="ignore"))
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_characters_go_whole(spark):
    shared = "é" * 230
    df = spark.createDataFrame([(1, "ab" + shared + "c"), (2, "cd" + shared + "é")], "doc_id long, text string")
    for r in drop_repeats(df).collect():
        assert "�" not in r["text"]


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000 + "c" + "ab" * 20_000, "one two three " * 4_000, "x\n" * 30_000])
def test_texts_of_one_phrase_have_few_rows(spark, text):
    """A repeated character or phrase: families tie inside the text, and leave it as a few rows."""
    rows = [(1, text), (2, text[:500]), (3, "other " + text[:700])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select(F.col("doc_id").alias("k1"), F.col("doc_id").alias("k2"), F.lit(1).cast("long").alias("copies"), F.col("text").cast("binary").alias("t"))
    assert suffixes._find_families(keyed, 400, 51).count() < 60
    found = find_repeats(df)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["s"], bytes(r["kept"])) for r in found.docs.join(found.texts, ["k1", "k2"]).select("id", "n_bytes", "n_removed", F.size("spans").alias("s"), "kept").collect()}
    assert [got[i] for i, _ in rows] == brute_repeats([t.encode() for _, t in rows])


def test_a_mix_of_periods_by_brute_force(spark):
    r = random.Random(5)
    texts = []
    for _ in range(12):
        parts = ["".join(r.choices("ab", k=r.randint(1, 5))) * r.randint(20, 400) for _ in range(r.randint(1, 5))]
        texts.append("".join(x + ("" if r.random() < .5 else "".join(r.choices("xyz", k=r.randint(1, 300)))) for x in parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = find_repeats(df)
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["s"], bytes(x["kept"])) for x in found.docs.join(found.texts, ["k1", "k2"]).select("id", "n_bytes", "n_removed", F.size("spans").alias("s"), "kept").collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def links_of(sets, asked, percent):
    """For each asked id, the ids whose sets are as similar, by counting shared shingles over an index of all."""
    index = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    out = {}
    for d in asked:
        shared = collections.Counter(e for x in sets[d] for e in index[x] if e != d)
        out[d] = [e for e, k in shared.items() if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k)]
    return out


@pytest.mark.parametrize("folder, every, width, percent", [("sf0.01", 1, 3, 85), ("sf0.01", 1, 5, 80), ("sf0.1", 100, 3, 85)])
def test_no_link_is_lost(spark, folder, every, width, percent):
    """Rows whose id is divisible by `every` against all rows: both ends of every link are in one component."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, NearDup(width=width, percent=percent)).collect()}
    texts = docs.collect()
    sets = {r["doc_id"]: set(s.tolist()) for r, s in zip(texts, shingle_sets([(r["text"] or "").encode() for r in texts], width))}
    linked = links_of(sets, [d for d in sets if d % every == 0], percent)
    assert any(linked.values()) and len(got) == len(sets)
    assert not [(d, e) for d, near in linked.items() for e in near if got[d] != got[e]]


def test_large_nodes_fetch_a_member_once(spark):
    """The join that fetches minwise hashes has one row a member, however many large nodes it is in."""
    n, nodes = 40, 6
    sets = spark.createDataFrame([(i, [i] * neardup.COORDINATES) for i in range(n)], "s long, mh array<int>")
    large = spark.createDataFrame([(k, i, 0, 5) for i in range(n) for k in range(nodes)], "node long, s long, c long, n long")
    got = neardup._with_picks(large, sets)
    assert sorted((r["node"], r["s"], r["mh"][0]) for r in got.collect()) == sorted((k, i, i) for i in range(n) for k in range(nodes))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") < plan.index("collect_list")


def test_a_joined_group_meets_the_rest_only(spark):
    """A node of 40 members in blocks of 10: 30 of one component in three blocks, and ten others in one, which meets all."""
    words = [f"w{k}" for k in range(60)]
    text = {i: " ".join([*words[:-1], f"own{i}"] if i < 30 else [f"x{i}_{k}" for k in range(60)]) for i in range(40)}
    text[35] = text[3] + " more"
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    rules = NearDup(width=3, percent=85, block_rows=10)
    sets = neardup.signatures(docs, 3).withColumnRenamed("id", "s").withColumn("c", F.when(F.col("s") < 30, 0).otherwise(F.col("s")).cast("long"))
    large = sets.select(F.lit(9).cast("long").alias("node"), "s", "c", "n")
    texts = docs.select(F.col("doc_id").alias("s"), F.col("text").cast("binary").alias("t"))
    assert neardup._meetings(large, sets, texts, rules).count() == 30 + 10 * 4
    links = neardup._dense_links(large, sets, texts, rules).collect()
    assert links and {max(r["u"], r["v"]) for r in links} == {35} and all(min(r["u"], r["v"]) < 30 for r in links)


def test_families_alone_in_their_bucket_go_no_further(spark):
    """copies and times count as occurrences; a bucket of one has nothing to compare."""
    rows = [(1, 1, 1, 1, 0, 9, 5, 1, 1), (2, 2, 2, 1, 0, 9, 6, 2, 2), (3, 3, 1, 2, 0, 9, 7, 3, 3), (4, 4, 1, 1, 0, 9, 8, 4, 4), (5, 5, 1, 1, 3, 9, 8, 5, 5)]
    found = spark.createDataFrame(rows, "k1 long, k2 long, copies long, times long, lo long, hi long, bucket long, e1 long, e2 long")
    got = suffixes._met_again(found)
    assert got.columns == found.columns and sorted(tuple(r) for r in got.collect()) == rows[1:]


@pytest.mark.parametrize("large", [8, 4])
def test_large_buckets_are_split_before_strings_are_counted(spark, monkeypatch, large):
    """A string shorter than 400 bytes in many texts is one bucket; few texts of it have more in common, on either side."""
    r = random.Random(11)
    own = lambda n: "".join(r.choices("abcdefgh ", k=n))
    common, ahead, behind = own(300), own(260), own(260)
    texts = [own(300) + common + own(300) for _ in range(60)] + [own(300) + common + behind + own(9) for _ in range(3)] + [own(9) + ahead + common + own(300) for _ in range(3)]
    counted, count = [], suffixes._counted_strings
    monkeypatch.setattr(suffixes, "_counted_strings", lambda s, *a: counted.append(s.count()) or count(s, *a))
    monkeypatch.setattr(suffixes, "LARGE_BUCKET", large)
    found = find_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["id"]: (x["n_bytes"], x["n_removed"], x["s"], bytes(x["kept"])) for x in found.docs.join(found.texts, ["k1", "k2"]).select("id", "n_bytes", "n_removed", F.size("spans").alias("s"), "kept").collect()}
    want = brute_repeats([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] > 0 for w in want) == 6
    assert counted in ([], [0])
