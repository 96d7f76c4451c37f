import pytest

SF = "/root/testdata/sf0.001"

#: rows every operator must survive: null ids and texts, blank, repeated, long and odd texts
ODD = [
    (None, "a b c d e f", "en", "s"), (9001, None, "en", "s"), (9002, "", None, None), (9003, "   \n\t ", "en", "s"),
    (9004, "one", "en", "s"), (9005, "one", "en", "s"), (9006, "two words", "de", "s"), (9006, "two words", "de", "s"),
    (9007, "x " * 20_000, "en", "s"), (9008, "ÀÉK K ß 漢字 \U0001f600 \x1c\x85　 end", "fr", "s"),
    (9009, "line\nline\n\nline \nother", "en", "s"), (-5, "negative id text " * 10, "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents table plus odd rows, with extra columns whose names clash with results."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, SCHEMA)
    return (real.unionByName(odd).withColumn("shard", F.lit("x")).withColumn("n_words", F.lit(-1))
            .withColumn("score", F.lit(0.5)).withColumn("fp", F.lit("f")).repartition(5).cache())


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
