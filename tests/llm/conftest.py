import pytest

WORDS = "the of and river stone market window letter garden music paper silver engine winter bridge north circle candle forest window".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with null, empty, tied, repeated and long rows, and with more columns, some with names that operators use inside."""
    import random

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 120)), "en") for i in range(40)]
    rows += [(40, None, "en"), (41, "", "de"), (42, " \n\t ", None), (None, text(20), "en"), (None, None, None), (43, "one", "en"), (44, text(6000), "en")]
    rows += [(45, rows[3][1], "en"), (46, rows[3][1], "fr"), (7, rows[7][1], "en"), (7, "another text of the same id", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return frame.select("*", F.lit(1).alias("part"), F.lit("x").alias("shard"), F.lit(0.5).alias("score"), F.lit("y").alias("fp"), F.lit(2).alias("block"), F.lit("z").alias("row"), F.lit(3).alias("at"))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
