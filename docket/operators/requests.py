"""Request projection (R06-R08): prompt rendering, model parameters, numbered batches."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.config import Config


@dataclass(frozen=True)
class PromptTemplate:
    """Two-message request: a fixed developer message and a user message around ``{text}``.

    Only ``{text}`` is substituted, so braces inside a document stay inert.
    """

    template_id: str = "default-v1"
    developer: str = (
        "Answer with one JSON record about the opinion below. Its fields: blue_book_citation; summary, two to"
        " four sentences; relevance_level, High if the opinion decides the question, Medium if it discusses it,"
        " Low otherwise; reasoning for that level; key_points, citations and quotes with their star pages, as lists"
        " of strings; argument, each sentence cited; support_level, one of Strongly Supports, Supports and"
        " Does not Support."
    )
    user: str = "Opinion:\n\n{text}\n"

    def user_parts(self) -> list[str]:
        return self.user.split("{text}")

    def render_user(self, text: str) -> str:
        return text.join(self.user_parts())

    def user_column(self, text: Column) -> Column:
        parts = self.user_parts()
        pieces: list[Column] = [F.lit(parts[0])]
        for p in parts[1:]:
            pieces += [text, F.lit(p)]
        return F.concat(*pieces)

    def messages(self, text: str) -> list[dict]:
        return [
            {"role": "developer", "content": self.developer},
            {"role": "user", "content": self.render_user(text)},
        ]


def request_key(config: Config, text: Column, template: PromptTemplate | None = None) -> Column:
    """Idempotency key of a request: model, template id and content, and text (not the file name)."""
    template = template or PromptTemplate(template_id=config.template_id)
    fixed = (config.model_name, template.template_id, template.developer, template.user)
    prompt = hashlib.sha256(json.dumps(fixed).encode()).hexdigest()
    return F.sha2(F.concat_ws("\u0000", F.lit(prompt), text), 256)


def model_params(model: Column) -> Column:
    """The reasoning model gets a high reasoning effort, others temperature 0."""
    return F.struct(
        F.when(model == "o1", F.lit("high")).alias("reasoning_effort"),
        F.when(model != "o1", F.lit(0.0)).alias("temperature"),
    )


def render(docs: DataFrame, template: PromptTemplate) -> DataFrame:
    """The two-message request as a column (for export; inference renders in-task)."""
    msgs = F.array(
        F.struct(F.lit("developer").alias("role"), F.lit(template.developer).alias("content")),
        F.struct(F.lit("user").alias("role"), template.user_column(F.col("text")).alias("content")),
    )
    return docs.withColumn("messages", msgs)


def requests_table(docs: DataFrame, config: Config, template: PromptTemplate | None = None) -> DataFrame:
    """``(filename, text, request_key)`` -- the constant prompt is not stored per row."""
    return docs.select("*", request_key(config, F.col("text"), template).alias("request_key"))


def numbered(df: DataFrame, order_by: str, partitions: int | None = None) -> DataFrame:
    """Global 0-based position ``idx`` in ``order_by`` order without a one-partition window.

    Range-partition and sort, checkpoint (so the two passes see the same rows),
    count rows per partition, turn the counts into offsets (one row per
    partition, so the broadcast is bounded by the partition count) and add the
    position inside the partition.
    """
    spark = df.sparkSession
    ranges = (partitions, order_by) if partitions else (order_by,)  # else the session's shuffle partitions
    ordered = (
        df.repartitionByRange(*ranges)
        .sortWithinPartitions(order_by)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    from docket.session import shared_dir

    shared_dir(spark, "numbered")  # makes sure a checkpoint location exists
    ordered = ordered.checkpoint(eager=True)
    sizes = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        ordered.join(F.broadcast(offsets), "_pid")
        .withColumn("idx", (F.col("_off") + local).cast("bigint"))
        .withColumn("n_rows", F.col("_total").cast("bigint"))
        .drop("_pid", "_mid", "_off", "_total")
    )


def batches(requests: DataFrame, batch_size: int, order_by: str = "filename") -> DataFrame:
    """Fixed-size batches numbered from 1 in ``order_by`` order, with the batch total."""
    num = numbered(requests, order_by)
    return num.select(
        "*",
        (F.floor(F.col("idx") / F.lit(batch_size)).cast("bigint") + 1).alias("batch_no"),
        F.ceil(F.col("n_rows") / F.lit(batch_size)).cast("bigint").alias("n_batches"),
    ).drop("idx", "n_rows")
