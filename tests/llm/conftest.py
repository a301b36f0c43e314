import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs_of(spark):
    """A documents table with extra columns whose names the operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, schema).repartition(parts)
        for extra in ("size", "key", "row", "kept", "_key", "shard", "root", "first"):
            frame = frame.selectExpr("*", f"1 as {extra}")
        return frame

    return make


def prose(rng, n, words=400):
    """Random text of n words from a vocabulary of invented words."""
    vocabulary = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in range(words // 20)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture
def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, shared passages."""
    import random

    rng = random.Random(5)
    passage, other = prose(rng, 130), prose(rng, 70)
    rows = [(None, None), (1, None), (2, ""), (3, "   \n\t "), (None, passage), (4, "one"), (5, "two words"), (6, "naïve ñandú " * 40)]
    rows += [(10 + i, prose(rng, rng.randint(20, 200))) for i in range(25)]
    rows += [(40 + i, f"{prose(rng, 30)} {passage}\n{prose(rng, 25)}") for i in range(6)]
    rows += [(60 + i, f"{other} {prose(rng, 10)} {other}") for i in range(4)]
    rows += [(80 + i, passage + " end") for i in range(5)] + [(90, passage + " end"), (90, passage + " end"), (91, other)]
    near = prose(rng, 220).split()
    for i in range(8):
        changed = list(near)
        changed[20 * i + 5] = "changed"
        rows.append((100 + i, " ".join(changed)))
    rows += [(120, prose(rng, 6000)), (121, "a " * 3000), (122, "x" * 5000), (123, prose(rng, 2000) + " " + " ".join(near))]
    return rows
