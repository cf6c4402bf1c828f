"""Sharding by sampled splitters: range partitions of near equal bytes.

Records are ordered by (hash of the text, id), so equal texts stand side by side. A
sample drawn in proportion to size gives quantile boundaries on the hash; the exact
bytes of every range are then counted, and ranges found overfull (one hot text, or an
uneven draw) are subdivided at boundaries on the whole key, drawn from a second sample
of those ranges alone. Shards are runs of consecutive ranges.

What reaches the driver is bounded by parameters: about ``sample`` drawn keys, and one
row per range. Everything per record stays narrow (no text is shuffled).

Results for odd input: a null text counts one byte and hashes as empty; a null id sorts
first; rows equal in text and id share a range and get different slots; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docket.llm.common import long_array, unit_interval
from docket.sinks.tables import materialize

_LOWEST = -(1 << 63) + 1


def record_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"),
    )


def weighted_sample(records: DataFrame, draws_per_byte: float, seed: int, *keys: str) -> list:
    """Keys drawn in proportion to size, as sorted ``(key..., draws)`` rows."""
    wanted = F.col("size") * F.lit(draws_per_byte)
    drawn = F.floor(wanted) + (unit_interval(F.lit(seed), "h", "k") < wanted - F.floor(wanted)).cast("long")
    rows = (records.select(*keys, drawn.alias("draws")).filter("draws > 0")
            .groupBy(*keys).agg(F.sum("draws").alias("draws")).collect())
    return sorted(tuple(r) for r in rows)


def quantile_keys(drawn: list, parts: int) -> list:
    """Up to ``parts - 1`` boundaries that cut the drawn weight into equal parts."""
    total, seen, out = sum(r[-1] for r in drawn), 0, []
    for row in drawn:
        if out.__len__() < parts - 1 and seen >= total * (len(out) + 1) / parts:
            out.append(row[:-1])
            while len(out) < parts - 1 and seen >= total * (len(out) + 1) / parts:
                out.append(row[:-1])
        seen += row[-1]
    return sorted(set(out))


def range_index(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters ``(h, k)`` are at or below the record: a binary search as a fold."""
    if not splitters:
        return F.lit(0)
    steps = max(1, len(splitters)).bit_length()
    hs, ks = long_array([s[0] for s in splitters]), long_array([s[1] for s in splitters])
    n = len(splitters)

    def step(lo, width):
        at = lo + width
        h, k = F.get(hs, at - 1), F.get(ks, at - 1)
        passed = (at <= n) & ((h < F.col("h")) | ((h == F.col("h")) & (k <= F.col("k"))))
        return F.when(passed, at).otherwise(lo)

    widths = F.array(*[F.lit(1 << b) for b in reversed(range(steps))])
    return F.aggregate(widths, F.lit(0), step)


def range_sizes(records: DataFrame, splitters: list) -> list[tuple[int, int, int]]:
    rows = records.groupBy(range_index(splitters).alias("r")).agg(F.sum("size"), F.count("*")).collect()
    return sorted(tuple(r) for r in rows)


def splitters_for(records: DataFrame, ranges: int, draws_per_range: int, overfull: float, seed: int):
    """Splitters and, per non-empty range, its exact bytes and rows."""
    total = records.agg(F.sum("size")).first()[0]
    if not total:
        return [], []
    rate = ranges * draws_per_range / total
    coarse = [(h, _LOWEST) for (h,) in quantile_keys(weighted_sample(records, rate, seed, "h"), ranges)]
    sizes = range_sizes(records, coarse)
    ideal = total / ranges
    heavy = {r: size for r, size, _ in sizes if size > overfull * ideal}
    if heavy:
        tagged = records.withColumn("r", range_index(coarse)).filter(F.col("r").isin(list(heavy)))
        drawn = weighted_sample(tagged, rate, seed + 1, "r", "h", "k")
        extra = []
        for r, size in heavy.items():
            own = [(h, k, draws) for rr, h, k, draws in drawn if rr == r]
            extra += quantile_keys(own, max(2, round(size / ideal))) if own else []
        coarse = sorted(set(coarse) | set(extra))
        sizes = range_sizes(records, coarse)
    return coarse, sizes


def shard(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 128, draws_per_range: int = 32,
          overfull: float = 1.5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: shards of near equal bytes, gapless slots."""
    records = materialize(record_keys(docs, id_col, text_col), "shard-keys")
    splitters, sizes = splitters_for(records, shards * ranges_per_shard, draws_per_range, overfull, seed)
    total, before = sum(s for _, s, _ in sizes) or 1, 0
    shard_of, first_slot, rows_in = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1), [0] * shards
    for r, size, rows in sizes:
        own = min(shards - 1, int(shards * (before + size / 2) / total))
        shard_of[r], first_slot[r] = own, rows_in[own]
        rows_in[own] += rows
        before += size
    place = F.row_number().over(W.partitionBy("r").orderBy("h", "k")) - 1
    return (records.withColumn("r", range_index(splitters))
            .withColumn("slot", F.get(long_array(first_slot), F.col("r")) + place)
            .select("doc_id", "size", "text_crc32", F.get(long_array(shard_of), F.col("r")).cast("int").alias("shard"),
                    F.col("slot").cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write whole rows under ``shard=<n>`` folders, each task's rows in key order."""
    records = materialize(record_keys(docs, **{k: v for k, v in options.items() if k.endswith("_col")}), "shard-keys")
    splitters, sizes = splitters_for(records, shards * 128, 32, 1.5, options.get("seed", 42))
    total, before, shard_of = sum(s for _, s, _ in sizes) or 1, 0, [0] * (len(splitters) + 1)
    for r, size, _ in sizes:
        shard_of[r] = min(shards - 1, int(shards * (before + size / 2) / total))
        before += size
    text = F.coalesce(F.col(options.get("text_col", "text")).cast("string"), F.lit(""))
    named = docs.withColumns({"h": F.xxhash64(text),
                              "k": F.coalesce(F.col(options.get("id_col", "doc_id")).cast("long"), F.lit(_LOWEST))})
    ranged = named.withColumn("_range", range_index(splitters))
    out = ranged.withColumn("shard", F.get(long_array(shard_of), F.col("_range")).cast("int"))
    (out.repartition("_range").sortWithinPartitions("shard", "h", "k").drop("h", "k", "_range")
        .write.mode("overwrite").partitionBy("shard").parquet(path))
