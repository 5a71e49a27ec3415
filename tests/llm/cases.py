"""Documents with awkward rows, shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard int, k1 long, row string, t string, c long"


def words(r, n, pool=300):
    return " ".join("w%d" % r.randrange(pool) for _ in range(n))


def documents(seed=1, n=60):
    """Texts of many lengths, copies, near copies, shared passages, nulls, empties, ties; extra columns clash with the operators' own names."""
    r = random.Random(seed)
    shared = words(r, 130)
    texts = [None, "", "   \n\t ", "one", "one two", "ß日本 \U0001f600's don't", "a" * 3000, ("x y z\n" * 400)]
    base = words(r, 200, 5000)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(words(r, r.randint(1, 400), 5000))
        elif kind == 1:
            texts.append(base)
        elif kind == 2:
            w = base.split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(words(r, 40, 5000) + " " + shared + " " + words(r, 40, 5000))
        elif kind == 4:
            texts.append("\n".join(words(r, 8) for _ in range(r.randint(1, 30))))
        else:
            texts.append(words(r, 60, 5000) + " é€ " + words(r, 30))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], None, 1, True, 7, 3, "row", "t", 9))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
