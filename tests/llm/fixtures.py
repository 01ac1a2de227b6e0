"""Documents that hold every edge case, and random ones."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    if extra:
        full = [(*r, "x", 1.0, 7) for r in full]
        return spark.createDataFrame(full, COLUMNS + ", id string, score double, length int").repartition(3)
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edge_rows():
    rng = random.Random(5)
    base = words(rng, 60)
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:-1], "changed"])), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (8, "one two"), (8, "three four five six seven"), (8, "three four five six seven"), (None, "no id here but words enough to count as text"), (None, None),
        (9, " ".join(words(rng, 20_000, 5000))), (10, "ünïcödé ÀÉ 日本語 텍스트 🙂 don't <|endoftext|>  double  space\n\nlines\r\nmore"), (11, "x" * 50_000),
    ]
