"""The training-data pipeline: quality rules, line dedup, near dedup, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` with docs in the columns of ``documents`` and
works on all that its predecessor kept; all but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import lines, mixture, rules, segment, simhash
from docket.sinks.tables import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Add ``a`` and ``b``, 128 bits of hash over a whole row; rows alike in all columns share them."""
    row = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]
    return docs.select(*COLUMNS, F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b"))


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (or, by ``left_anti``, without) their key in ``keys``; null ids are equal."""
    k = keys.select(F.col("doc_id").alias("i"), F.col("a").alias("ka"), F.col("b").alias("kb"))
    return docs.join(k, docs.doc_id.eqNullSafe(k.i) & (docs.a == k.ka) & (docs.b == k.kb), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the base test or a learned rule rejects go.

    Every row is judged by its own text: other rows of its id, or other rows without an id, stay.
    """
    docs = _keyed(docs)
    stats = rules.statistics(docs.withColumn("row_key", F.struct("doc_id", "a", "b")), id_col="row_key")
    stats = materialize(stats.withColumnRenamed("doc_id", "row_key").withColumn("doc_id", F.col("row_key.doc_id")),
                        "quality-stats")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    learned = rules.learn(materialize(rules.labelled_statistics(stats, labels), "quality-labelled"))
    verdict = rules.judge(stats, learned).filter("not kept").select("row_key.*").distinct()
    return _documents(_matched(docs, verdict, "left_anti"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document or line go, near copies too; texts made of them alone go whole."""
    return _documents(lines.dedup_texts(docs, similarity=0.8))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by fingerprints one row stays: the one of least id.

    Null ids come last; rows of one id go by the hash of the row, and of rows alike in all
    columns one stays. A row goes for its own text only, whatever other rows its id has.
    """
    docs = _keyed(docs)
    found = materialize(simhash.near_duplicates(docs, shingle=3, bits=3, keep=("a", "b")), "near-rows")
    rows = materialize(found.groupBy("root", "doc_id", "a", "b").agg(F.count("*").alias("n")), "near-distinct")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "a", "b")
    least = materialize(rows.groupBy("root").agg(F.min(place).alias("least")), "near-least")
    # both sides are read from files, so the adaptive plan can split a large group
    judged = materialize(rows.join(least, "root").select("doc_id", "a", "b", "n", (place == F.col("least")).alias("stays"))
                         .filter("not stays or n > 1"), "near-verdicts")
    one = _matched(docs, judged.filter("stays"), "left_semi").groupBy("doc_id", "a", "b").agg(
        F.first(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return _documents(_matched(docs, judged, "left_anti").select(*COLUMNS).unionByName(one))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and as much of them, as their source's quota takes."""
    return _documents(mixture.mixed_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every text, with whether they decode to it."""
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    encoded = segment.encode(hashed, samples=2, keep=("text_hash",))
    back = segment.decode(encoded)
    return back.select("doc_id", "rank", "ids", "log_prob", "log_inclusion",
                       (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Learned rules, XXH64 fingerprints and sampled segmentations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
