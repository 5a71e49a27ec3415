"""Every registered query of the training-data operators, with all its columns, against brute force on a small folder of awkward tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdfloom.llm.bpe import encoder
from cdfloom.llm.html import main_text, trained_model
from cdfloom.llm.media import encode_image, feature, padded
from cdfloom.llm.mixing import Mix, targets
from cdfloom.llm.queries import oracle_sql, queries, vocabulary

from .cases import documents, frame
from .test_dedup import brute_components, brute_repeats
from .test_media_html import PAGE
from .test_tables import WORD, counts

TURNS = [(1, 1, "assistant", "a <|end|> b\\"), (1, 0, "user", "q"), (2, 0, "system", None), (2, 2, "assistant", ""), (2, 1, "user", "é\n"), (3, 0, "assistant", "x"), (3, 0, "assistant", "y"), (4, 0, None, "no role")]
PAGES = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>short"), (5, "w", PAGE), (None, "n", PAGE[:200])]


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return documents(n=90)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    frame(spark, rows).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


def answer(spark, folder, name, key="doc_id"):
    (query,) = [q for n, q in queries().items() if n.startswith(f"{name}_")]
    out = query(spark, folder)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    return out.columns, {r[key]: r for r in out.collect()}


def test_op1(spark, folder):
    columns, got = answer(spark, folder, "op1", "page_id")
    assert columns[:4] == ["page_id", "url", "text", "n_chars"] and len(got) == len(PAGES)
    for i, url, html in PAGES:
        want = main_text(html, trained_model())
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, want, len(want))
    assert got[1]["text"] and not got[2]["text"]


def test_op2(spark, folder):
    columns, got = answer(spark, folder, "op2", "conv_id")
    assert columns[:6] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    text = "</s>[INST] ok [/INST]"
    want = collections.defaultdict(list)
    for c, n, role, t in [*TURNS, (-1, 0, "user", text), (-1, 1, "assistant", text)]:
        want[c].append((n, role or "", t or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns).encode())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said.encode()))
        assert got[c]["formatted_chars"] > sum(len(role) + len(t) for _, role, t in turns)


def test_op3(spark, folder, rows):
    columns, got = answer(spark, folder, "op3")
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    whole, taken = collections.Counter(), collections.Counter()
    for r in rows:
        whole[r[3]] += size[r[0]]
        taken[r[3]] += got[r[0]]["taken"]
    sources = sorted(whole, key=lambda s: (s is None, s or ""))
    target = dict(zip(sources, targets([whole[s] for s in sources], Mix())))
    for r in rows:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (size[r[0]], whole[r[3]]) and g["target"] == pytest.approx(target[r[3]]) and 0 <= g["taken"] <= 2 * g["size"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 2 for s in sources)
    assert {d: r["taken"] for d, r in answer(spark, folder, "op3")[1].items()} == {d: r["taken"] for d, r in got.items()}


def test_op4(spark, folder, rows):
    columns, got = answer(spark, folder, "op4")
    assert columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] and len(got) == len(rows)
    for r in rows:
        data = (r[1] or "").encode()
        payload, media = padded(data), encode_image(data)
        assert tuple(got[r[0]][c] for c in columns[1:8]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), feature(payload))


def test_op5(spark, folder, rows):
    columns, got = answer(spark, folder, "op5")
    assert columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(got) == len(rows)
    for r, ids in zip(rows, encoder(vocabulary()).encode([r[1] or "" for r in rows])):
        assert (got[r[0]]["n_tokens"], got[r[0]]["ids_sha256"], got[r[0]]["decoded_sha256"]) == (len(np.frombuffer(ids, "<u4")), sha(bytes(ids)), sha((r[1] or "").encode()))


def test_op6(spark, folder, rows):
    columns, got = answer(spark, folder, "op6")
    assert columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == brute_components(rows, 3, 85)


def test_op7(spark, folder, rows):
    columns, got = answer(spark, folder, "op7")
    assert columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and len(got) == len(rows)
    for r, (n, removed, spans, kept) in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows])):
        g = got[r[0]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"], g["n_kept"]) == (n, removed, spans, sha(kept), len(kept))
        assert g["text"] == kept.decode(errors="replace")


def test_op8(spark, folder, rows):
    columns, got = answer(spark, folder, "op8")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in rows:
        g, data = got[r[0]], (r[1] or "").encode()
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None) and 0 <= g["shard"] < 24
        by[g["shard"]].append(g)
    largest, total = max(g["size"] for g in got.values()), sum(g["size"] for g in got.values())
    for s in by.values():
        assert sorted(g["slot"] for g in s) == list(range(len(s))) and abs(sum(g["size"] for g in s) - total / 24) <= largest


def test_op9(spark, folder, rows):
    (query,) = [q for n, q in queries().items() if n.startswith("op9_")]
    tokens = dict(zip([r[0] for r in rows], (len(np.frombuffer(p, "<u4")) for p in encoder(vocabulary()).encode([r[1] or "" for r in rows]))))
    sums = {r["doc_id"]: r for r in query(spark, folder).groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_bytes").alias("b")).collect()}
    assert {d: r["t"] for d, r in sums.items()} == tokens and all(sums[r[0]]["b"] == len((r[1] or "").encode()) for r in rows)


def test_op10(spark, folder, rows):
    columns, got = answer(spark, folder, "op10")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and len(got) == len(rows)
    for r in rows:
        want, g = counts(r[1]), got[r[0]]
        assert tuple(g[c] for c in columns[1:6]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g["base_failed"] and g["kept"])


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op10_quality_rules"])
def test_sql_forms(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    out = queries()[name](spark, data)
    columns = sorted(out.columns)
    want = con.sql(oracle_sql()[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, out.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, tmp_path_factory, name, folder):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "conversations", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    out = queries()[name](spark, str(d)).collect()
    assert [r["conv_id"] for r in out] == [-1] if name.startswith("op2") else not out
