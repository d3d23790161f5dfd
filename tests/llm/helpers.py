"""Small tables with the awkward cases every operator must take."""

import random

SYLLABLES = "ka lo mi ter an su vor ple dit ose ram gu".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(seed=1):
    """Null and empty texts, a null id, repeated rows, a long text, no letters."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(30)]
    return rows + [(30, None), (31, ""), (None, "alone"), (32, rows[3][1]), (33, "123 ... !!"), (3, rows[3][1]), (34, words(rng, 30_000)), (35, "\n \t")]


def frame(spark, rows=None, parts=3):
    """The table with extra columns whose names clash with results and temporaries."""
    rows = awkward() if rows is None else rows
    full = [(i, t, "x", 1.5, 7, "s", i) for i, t in rows]
    schema = "doc_id bigint, text string, lang_pred string, score double, size int, spans string, _text bigint"
    return spark.createDataFrame(full, schema).repartition(parts)


def empty(spark):
    return frame(spark, []).limit(0)
