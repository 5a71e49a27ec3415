import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cdfloom.llm.bpe import PreTokenizer, decode_documents, encode_documents, encoder
from cdfloom.llm.queries import vocabulary
from cdfloom.llm.tokencount import attribute, token_counts

from .cases import documents, frame


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = list("strevlmda'S 1!-\t\n\r\x1c\x85\xa0́ ​é日½ⅷ😀") + ["'ll", "'re", "  ", "\r\n"]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(library, texts):
    packed = encoder(vocabulary()).encode(texts)
    for t, p in zip(texts, packed):
        assert np.frombuffer(p, "<u4").tolist() == library.encode_ordinary(t)
        assert encoder(vocabulary()).decode(p) == t.encode()


def test_every_code_point(library):
    points = [chr(c) for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c}x" for c in points]
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder(vocabulary()).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(library):
    texts = ["a" * 5000, " " * 3000, "ab" * 3000 + "'s", "\n" * 2000 + "x"]
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder(vocabulary()).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_automaton():
    from cdfloom.llm.bpe import S_START, _step

    pre, r = PreTokenizer(), np.random.default_rng(0)
    classes = r.integers(0, 12, 70_000).astype(np.uint8)
    state, want = S_START, []
    for c in classes.tolist():
        want.append(state := _step(state, c))
    assert pre.states(classes).tolist() == want


def test_documents_round_trip(spark, library):
    rows = documents()
    encoded = encode_documents(frame(spark), vocabulary(), keep=["doc_id", "text"])
    back = {r["doc_id"]: (r["text"], bytes(r["packed"]), bytes(r["decoded"])) for r in decode_documents(encoded.withColumnRenamed("ids", "packed"), vocabulary(), "packed", keep_ids=True).collect()}
    assert len(back) == len(rows)
    for row in rows:
        text = row[1] or ""
        assert np.frombuffer(back[row[0]][1], "<u4").tolist() == library.encode_ordinary(text) and back[row[0]][2] == text.encode()
    assert encode_documents(frame(spark, []), vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_attribution_by_brute_force(rule):
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(0, 40)
        ends = np.array(sorted(r.sample(range(1, n), min(n - 1, r.randint(0, 8))) + [n])) if n else np.zeros(0, int)
        lines = np.array(sorted(r.sample(range(1, n), min(n - 1, r.randint(0, 6))) + [n])) if n else np.array([0])
        of, crosses = attribute(ends, lines, rule)
        line_of = np.searchsorted(lines, np.arange(n), "right")
        for k, (a, b) in enumerate(zip([0, *ends.tolist()[:-1]], ends.tolist())):
            inside = line_of[a:b].tolist()
            want = {"first": inside[0], "last": inside[-1], "most": max(sorted(set(inside)), key=lambda s: (inside.count(s), -s))}[rule]
            assert of[k] == want and crosses[k] == (len(set(inside)) > 1)


def test_counts_add_up(spark, library):
    rows = documents()
    got = {}
    for r in token_counts(frame(spark), vocabulary()).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["n_bytes"], r["n_tokens"]))
    for row in rows:
        text = row[1] or ""
        sections = sorted(got[row[0]])
        assert [s[0] for s in sections] == list(range(len(sections)))
        assert sum(s[1] for s in sections) == len(text.encode()) and sum(s[2] for s in sections) == len(library.encode_ordinary(text))


def test_digest(spark, data):
    from cdfloom.llm.queries import queries

    row = queries()["op5_byte_level_bpe"](spark, data).orderBy("doc_id").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
