"""Small tables with the cases that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, score double, id long, rate string, component_id int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    base = [" ".join(words(rng, 60)) + ".\n" + " ".join(words(rng, 70)) for _ in range(6)]
    near = base[0].split(" ")
    near[5] = "changed"
    return [
        *base,
        base[0],  # an exact copy
        " ".join(near),
        None,
        "",
        " \n\t ",
        "One",
        "é Ünï\x00 日本語\n日本語 ÀB",
        "\n".join([" ".join(words(rng, 55))] * 4),
        " ".join(words(rng, 30_000, 5000)),  # very long
        "a " * 300,
    ]


def frame(spark, rows=None):
    """Documents with extra columns whose names clash with those of results, a null id and a repeated row."""
    if rows is None:
        rows = list(enumerate(texts())) + [(None, "no id"), (3, texts()[3])]
    return spark.createDataFrame([(i, t, None, 1.5, 7, "x", 2) for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
