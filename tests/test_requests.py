"""Request batches (R08) and request keys."""

from pyspark.sql import functions as F

from docket.config import Config
from docket.operators.requests import batches, numbered, request_key


def test_batches_with_empty_partitions(spark):
    rows = [(f"{i:03d}.docx",) for i in (7, 3, 22, 0, 15, 9, 1, 18, 4, 11, 20, 2, 13, 6, 17, 5, 21, 8, 14, 10, 19, 12, 16)]
    df = spark.createDataFrame(rows, "filename string").repartition(3)
    got = {r["filename"]: (r["batch_no"], r["n_batches"]) for r in batches(df, 5).collect()}
    assert len(got) == 23
    for fn, (b, n) in got.items():
        assert n == 5 and b == int(fn[:3]) // 5 + 1


def test_numbered_more_partitions_than_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "filename string")
    got = sorted((r["filename"], r["idx"], r["n_rows"]) for r in numbered(df, "filename", partitions=8).collect())
    assert got == [("a", 0, 3), ("b", 1, 3), ("c", 2, 3)]


def test_request_key_depends_on_text_model_and_template(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    k1 = [r[0] for r in df.select(request_key(Config(), F.col("text"))).collect()]
    assert k1[0] == k1[1] != k1[2]
    k2 = df.select(request_key(Config(model_name="gpt-4o"), F.col("text"))).first()[0]
    k3 = df.select(request_key(Config(template_id="v2"), F.col("text"))).first()[0]
    assert len({k1[0], k2, k3}) == 3
