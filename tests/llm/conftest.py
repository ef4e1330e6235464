import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, digest string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    """Texts with nulls, empties, exact and near copies, repeated rows, one long text, and hidden insults."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(90), []
    base = text(120)
    for i in range(60):
        t = text(rng.randint(5, 150))
        if i % 6 == 0:
            t = t + "\n" + passage + "\n" + text(20)
        if i % 4 == 0:
            t = t + " you stupid clown"
        rows.append((i, t))
    rows += [(100, base), (101, base), (102, base.replace(base.split()[60], "changed", 1)), (103, None), (104, ""), (105, " \n\t "), (106, "one two"), (107, "Sh " * 900), (108, text(4000) + " é漢字😀 ende"), (109, "ÀÉ straße " * 60), (None, text(30)), (110, base.upper()), (5, rows[5][1]), (5, rows[5][1]), (111, "such a stup1d c l o w n he is"), (112, "a STUUUPID idea")]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or ""), 1.0, 2, "x", "y") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (1, None, None), (2, 0, 0), (900, 1, 1)]
    return spark.createDataFrame(made, LABELS)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)
