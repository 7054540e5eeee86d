import pytest
from pyspark.sql import functions as F

#: Texts that every text operator must take.
ODD = [None, "", "   ", "!!! ???", "word", "Ärger über Öl", "a b c d e f g h i j k l m n",
       "x" * 50_000, "tick tock " * 9_000]


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame (doc_id, text, and columns whose names clash with outputs)."""
    def make(rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return (df.withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1))
                .withColumn("class_id", F.lit(-1)).withColumn("block", F.lit("b"))
                .withColumn("n_words", F.lit("n")).withColumn("fp", F.lit(0)))
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Odd texts, a repeated row, a repeated id, and a null id."""
    rows = list(enumerate(ODD))
    return rows + [(4, "word"), (4, "other word"), (None, "no id here")]
