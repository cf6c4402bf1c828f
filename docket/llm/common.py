"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.session import shared_dir
from docket.sinks.tables import materialize

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def long_array(values) -> Column:
    """A constant array of longs (parsed as one SQL literal list, folded once)."""
    return F.expr("array(" + ",".join(f"{int(v)}L" for v in values) + ")") if len(values) else F.expr(
        "cast(array() as array<bigint>)"
    )


def unit_interval(*cols: Column) -> Column:
    """A deterministic uniform draw in [0, 1) from the hash of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


class Scratch:
    """Written tables that only lead to another written table, and go when that one stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, name))
        return materialize(df, name, self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()
