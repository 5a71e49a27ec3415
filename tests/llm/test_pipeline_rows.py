"""The pipeline's stages on repeated rows, null ids and shared ids."""

import collections
import random

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 9))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d, e = (text(k) for k in range(5))
    near = a.rsplit(" ", 1)[0] + " zz"
    rows = [(5, a), (5, a), (7, near), (None, a),  # repeated rows, a near copy and a copy of a null id
            (None, b), (None, b), (None, b + " zz"),  # null ids only
            (7, c), (9, c), (9, d), (3, d),  # ids with several texts
            (11, e), (12, None), (12, None), (13, None), (None, None), (None, " "), (None, " ")]
    got = pairs(P.near_dedup(spark, frame(spark, [(i, t, "a") for i, t in rows]), ""))
    of_b = [k for k in got if k[0] is None and k[1] and k[1].startswith(b)]
    assert len(of_b) == 1 and got.pop(of_b[0]) == 1
    assert got == {(5, a): 1, (7, c): 1, (3, d): 1, (11, e): 1, (12, None): 1, (13, None): 1, (None, None): 1, (None, " "): 1}


def test_mixing_takes_every_row_by_itself(spark):
    """One source owes 1.5 times its words: every row comes once or twice, null and shared ids as well."""
    rows = [(None, text(k)) for k in range(40)] + [(k // 4, text(100 + k)) for k in range(40)]
    got = pairs(P.mix(spark, frame(spark, [(i, t, "a") for i, t in rows]), ""))
    assert set(got) == set(rows) and set(got.values()) == {1, 2}


def test_repeated_rows_survive_from_near_dedup_to_mixing(spark):
    rows = [(k, text(k)) for k in range(12)] + [(None, text(50 + k)) for k in range(12)]
    docs = frame(spark, [(i, t, "a") for i, t in rows * 3])
    for stage in (P.near_dedup, P.substring_dedup, P.mix):
        docs = P.materialize(stage(spark, docs, ""), "test-rows")
    got = pairs(docs)
    assert set(got) == set(rows) and set(got.values()) <= {1, 2}
