import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names the operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("id", "key", "score", "size", "class_id", "kept", "label", "__id", "n", "lang"):
                df = df.withColumn(name, F.lit(None).cast("string"))
        return df
    return make


WORDS = ("amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean "
         "plain quarry ridge shoal tundra upland valley willow yarrow zephyr").split()


def prose(seed: int, n: int) -> str:
    """A repeatable text of n words."""
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ed", ","]) for _ in range(n)) + "."


# nulls, empty and very long texts, ties, repeated rows, null ids
EDGE_ROWS = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "One"), (6, prose(1, 60)), (7, prose(1, 60).upper()),
             (7, prose(1, 60).upper()), (8, prose(2, 30_000)), (None, prose(3, 40)), (9, prose(3, 40)), (10, "two words"),
             (11, "x" * 50_000), (12, prose(4, 50) + "\n" + prose(5, 50)), (13, prose(4, 50) + "\n" + prose(6, 50))]
