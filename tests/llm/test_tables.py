"""Sharding, quality rules, chat formatting, mixing."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdfloom.llm import chat
from cdfloom.llm.chat import Template, canonical_turns, format_chat, format_records, masked_text, parse_chat, turn_records
from cdfloom.llm.mixing import Mix, mixed_text, permuted, plan_mix, taken_words, targets
from cdfloom.llm.quality import QualityRules, chi2_quantile, filter_quality, score_quality
from cdfloom.llm.sharding import shard_by_bytes

from .cases import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- sharding ----

@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards(spark, shards):
    rows = documents(n=200) + [(None, "x", None, None, *documents()[0][4:]), (3, "one", "en", "a", *documents()[0][4:])]
    got = shard_by_bytes(frame(spark, rows), shards).collect()
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in rows}
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["grown_shard"] is None and r["law"] == "bytes"
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    order = []
    for s in sorted(by):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= largest
        order += [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(by[s], key=lambda r: r["slot"])]
    assert order == sorted(order)
    assert next(r["text_crc32"] for r in got if r["doc_id"] == 5) == zlib.crc32(documents()[5][1].encode())
    assert shard_by_bytes(frame(spark, []), shards).count() == 0


# ---- quality ----

def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts_and_base_rules(spark):
    rows = documents(n=60) + [(999, "a a a a a b c a a a\n\n x \n x \n" * 3, None, None, *documents()[0][4:])]
    out = score_quality(frame(spark, rows), keep=["doc_id", "kept", "size"])
    assert len(out.columns) == len({c.lower() for c in out.columns})
    for r in out.collect():
        want = counts(next(x[1] for x in rows if x[0] == r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_verdicts_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = score_quality(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).join(labels, "doc_id").where("n_words >= 50").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]


def test_filter_keeps_columns_and_empty_tables(spark):
    df = frame(spark)
    out = filter_quality(df)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert filter_quality(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and QualityRules().h < 1


# ---- chat ----

LAYOUTS = {
    "messages": '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
    "conversations": '{"id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
    "prompt_completion": '{"prompt": "q", "completion": "a"}',
    "prompt_response": '{"system": null, "prompt": "q", "response": "a"}',
    "instruction": '{"instruction": "q", "input": null, "output": "a"}',
    "question_answer": '{"question": "q", "answer": "a", "id": "7"}',
    "turn_row": '{"role": "user", "text": "q"}',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    df = spark.createDataFrame([(1, LAYOUTS[name])], "k int, j string").select("k", F.parse_json("j").alias("record"))
    row = canonical_turns(df).first()
    assert row["mapping"] == name
    assert [(t["role"], t["text"]) for t in row["turns"]] == [("user", "q"), ("assistant", "a")][: 1 if name == "turn_row" else 2]


def test_two_parts_and_unknown_layouts(spark):
    df = spark.createDataFrame([(1, '{"instruction": "i", "input": "x", "output": "a"}'), (2, '{"foo": [1, 2]}'), (3, None)], "k int, j string").select("k", F.parse_json("j").alias("record"))
    got = {r["k"]: (r["mapping"], r["turns"]) for r in canonical_turns(df).collect()}
    assert got[1][1][0]["text"] == "i\n\nx" and got[2] == (None, None) and got[3][0] is None
    with pytest.raises(Exception, match="unknown record layout"):
        format_records(df.select(F.col("k").alias("conv_id"), F.lit(0).alias("turn"), "record")).collect()


NASTY = ["<|end|>", "<\\|end|>", "\\", "<", "a<\\\\", "<|turn|>user<|text|>x<|end|>", "</s>[INST] ok [/INST]", "", "é\n<|", "|>", "\\<"]


def test_round_trip(spark):
    rows = [(i % 2, i, ["user", "assistant", "we<|ird"][i % 3], t) for i, t in enumerate(NASTY)] + [(1, 99, None, None), (None, 0, "assistant", "n"), (0, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = format_records(turn_records(df))
    want = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    for r in done.select("conv_id", "formatted", "loss", parse_chat(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect():
        assert [(t["role"], t["text"]) for t in r["t"]] == want[r["conv_id"]]
        assert r["m"] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
        for span in r["loss"]:
            assert r["formatted"][span["start"] + span["length"]:].startswith("<|end|>")
    with pytest.raises(ValueError):
        Template(open="[x]")


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(50)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    got = format_records(turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select("conv_id", parse_chat(F.col("formatted")).alias("t")).collect()
    assert sorted((r["t"][0]["text"] for r in got if r["conv_id"] is None)) == sorted(f"t{i}" for i in range(50))
    assert [len(r["t"]) for r in got if r["conv_id"] == 1] == [2] and len(got) == 51
    df = spark.createDataFrame([(LAYOUTS["messages"],), (LAYOUTS["messages"],)], "j string").select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.parse_json("j").alias("record"))
    assert [len(r["t"]) for r in format_records(df).select(parse_chat(F.col("formatted")).alias("t")).collect()] == [2, 2]


def test_fingerprints_differ():
    assert len({s for m in chat.MAPPINGS for s in chat.shapes(m)}) == sum(len(chat.shapes(m)) for m in chat.MAPPINGS)
    assert format_chat is not None


def test_chat_digest(spark, data):
    from cdfloom.llm.queries import queries

    probe = queries()["op2_chat_formatting"](spark, data).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (probe["n_turns"], probe["loss_chars"], probe["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


# ---- mixing ----

def test_targets():
    mix = Mix()
    assert targets([100, 100, 100], mix) == pytest.approx([200, 250 / 3, 500 / 3])
    got = targets([10, 0, 1000, 500], mix)
    assert sum(got) == pytest.approx(1510 * 1.5) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 0, 1000, 500]))
    assert targets([0, 0], mix) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4097])
def test_permutation(n):
    key = np.full(n, 5, np.uint64)
    out = permuted(np.arange(n), n, key, 24)
    assert sorted(out.tolist()) == list(range(n)) and out.tolist() == [int(permuted(np.array([i]), n, key[:1], 24)[0]) for i in range(n)]
    assert n < 100 or (out.tolist() != list(range(n)) and out.tolist() != permuted(np.arange(n), n, key + np.uint64(1), 24).tolist())


def test_mix(spark):
    rows = documents(n=300)
    mix = Mix(block_words=16)
    plan = plan_mix(frame(spark, rows), mix)
    got = {r["id"]: r for r in taken_words(plan).collect()}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = collections.Counter()
    for r in rows:
        source[r[3]] += size[r[0]]
    taken, target = collections.Counter(), {}
    for r in rows:
        g = got[r[0]]
        assert g["size"] == size[r[0]] and g["source_size"] == source[r[3]] and g["taken"] <= 2 * g["size"]
        taken[r[3]] += g["taken"]
        target[r[3]] = g["target"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 16 for s in target)
    assert {r["id"]: r["taken"] for r in taken_words(plan_mix(frame(spark, rows), mix)).collect()} == {d: g["taken"] for d, g in got.items()}
    text = mixed_text(frame(spark, rows), plan).collect()
    assert sum(len(r["text"].split(" ")) for r in text) == sum(taken.values())
    places = collections.Counter((r["shard"], r["position"]) for r in text)
    assert max(places.values()) == 1
    assert taken_words(plan_mix(frame(spark, []))).count() == 0


def test_small_sources_come_near_their_targets(spark):
    """A source of fewer words than a block gets its share as well: blocks are shorter there."""
    rows = [(i, "w " * 40, "en", "small" if i < 3 else "tiny" if i < 4 else "large") for i in range(200)]
    got = taken_words(plan_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 1 for s in target)
