"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get word targets in proportion to their weights, none above ``max_epochs`` times
its size (the excess is shared out again by weight). The whole mix is cut into blocks of
equally many words, at most ``block_words`` and at most a 64th of the least target, so that
every source gets near its own; the blocks are apportioned to sources by highest quotients
``votes / (2 seats + 1)``, and each source's blocks to its shards the same way. A source
has as many shards as its size asks for, so a hot source is spread and no shard grows
with the corpus. In a shard the documents stand in seeded order and its word stream is
cut into blocks; a quota of ``e`` full passes and ``r`` blocks takes everything ``e``
times and a seeded run of ``r`` blocks, so documents stay whole except at a run's ends.

All of it is DataFrame code on narrow rows. Tables of sources and shards stay distributed:
their order is a range sort with an offset per partition, the level of the targets comes from
a few sums over all sources, and only the window over the documents of one shard remains.

Results for odd input: a null text has size 0 and is taken 0 times; a null source is a
source of its own, ordered last; a null id keeps its row; repeated rows count as often as
they occur; an empty table gives an empty table; other columns are ignored. Equal quotients go to the
source first by code point and to the lower shard. A very long text is one narrow row, and may
be cut by a run like any other; a shard is then as long as that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docket.llm.common import word_count, words
from docket.operators.requests import numbered
from docket.sinks.tables import materialize

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Every source gets ``level * weight`` or its cap, whichever is less. The level is found by
    sharing the excess again and again: each round is two sums over all sources, and a round
    that adds no capped source is the last. Sizes and weights are whole numbers, so the sums do
    not depend on the order of the rows.
    """
    sizes = materialize(sizes.select("source", "source_size"), "mix-sizes-of-sources")
    named = numbered(sizes.where("source is not null"), "source").select("source", "source_size", "idx")
    total, n_named = sizes.agg(F.sum("source_size"), F.count("source")).first()
    nameless = sizes.where("source is null").select("source", "source_size", F.lit(n_named).cast("long").alias("idx"))
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights)).cast("int"))
    ranked = materialize(named.unionByName(nameless).select(
        "source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")),
        "mix-weights")
    level, wanted = 0.0, float(share) * (total or 0)
    while True:
        at = F.lit(level) * F.col("w")
        capped, free = ranked.agg(F.sum(F.when(F.col("cap") < at, F.col("cap")).otherwise(0.0)),
                                  F.sum(F.when(F.col("cap") >= at, F.col("w")).otherwise(0.0))).first()
        higher = (wanted - capped) / free if free else float("inf")
        if not higher > level:
            break
        level = higher
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def apportion(votes: DataFrame, group: list[str], seats: Column, tie: list[str]) -> DataFrame:
    """Seats by highest quotients ``votes / (2 s + 1)`` in each group; adds ``quota`` (long).

    ``votes`` has one row per party with ``votes``; ``seats`` is the group's seat count and
    ``tie`` names the columns that tell parties of a group apart, lower and non-null ones first.
    Most seats are certain: a divisor safely too large gives every party
    a sure number, one safely too small the most it may get, and only the few seats
    between the two (at most about four per party) are ranked, by one range sort for all groups.
    """
    votes = votes.withColumn("_seats", seats.cast("long"))
    named = [F.col(c) for c in group] or [F.lit(0)]
    votes = materialize(votes.withColumn("_group", F.struct(*[c.alias(f"g{i}") for i, c in enumerate(named)])), "mix-votes")
    sums = materialize(votes.groupBy("_group").agg(F.sum("votes").alias("all"), F.count("*").alias("n")), "mix-sums")

    def with_group(df: DataFrame, table: DataFrame) -> DataFrame:  # one row per group on that side
        table = table.withColumnRenamed("_group", "_of")
        return df.join(table, F.col("_group").eqNullSafe(F.col("_of"))).drop("_of")

    v, n_seats = with_group(votes, sums), F.col("_seats")
    hi = F.col("all") / F.greatest(n_seats - F.col("n"), F.lit(0))
    low = F.when(n_seats > F.col("n"), F.floor(F.col("votes") / hi + 0.5)).otherwise(0).cast("long")
    high = F.ceil(F.col("votes") / (F.col("all") / (n_seats + F.col("n"))) + 0.5).cast("long")
    v = v.withColumn("sure", F.when(F.col("all") > 0, low).otherwise(0)).withColumn(
        "most", F.when(F.col("votes") > 0, F.greatest(high, F.col("sure"))).otherwise(F.col("sure")))
    v = materialize(v.drop("all", "n"), "mix-bounds")
    tried = v.withColumn("s", F.explode(F.expr("if(most > sure, sequence(sure, most - 1), array(cast(null as bigint)))")))
    quotient = F.coalesce(F.col("votes") / (2 * F.col("s") + 1), F.lit(-1.0))
    place = F.struct("_group", (-quotient).alias("q"), *[x for c in tie for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], "s")
    tried = materialize(numbered(tried.withColumn("_place", place), "_place").drop("_place", "n_rows"), "mix-quotients")
    firsts = tried.groupBy("_group").agg(F.min("idx").alias("first"))
    opens = v.groupBy("_group").agg((F.max("_seats") - F.sum("sure")).alias("open")).withColumnRenamed("_group", "_g")
    firsts = firsts.join(opens, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    tried = with_group(tried, materialize(firsts, "mix-firsts"))
    won = F.count_if(F.col("s").isNotNull() & (F.col("idx") - F.col("first") < F.col("open")))
    kept = [c for c in votes.columns if not c.startswith("_")]
    return (tried.groupBy(*kept, "sure").agg(won.alias("extra"))
            .withColumn("quota", F.col("sure") + F.col("extra")).drop("sure", "extra"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, block_words: int = 32,
        shard_words: int = 1 << 17, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, and its place:
    ``at`` (first word in its shard's stream), ``passes``, ``run_from``, ``run_words``, ``stream``.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sized = materialize(sized, "mix-sizes")
    sources = materialize(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs),
        "mix-sources")
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))).cast("long")
    lookup = sources.select(F.col("source").alias("s"), "source_size", "target", shards_of.alias("shards"))
    # one row per source: the join is planned by its measured size
    placed = sized.join(lookup, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("shards")))

    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block_words = max(1, min(block_words, int((least or 0) // 64)))
    seats = int(min(share, max_epochs) * (total or 0) / block_words + 0.5)
    by_source = materialize(
        apportion(sources.select("source", F.col("target").alias("votes")), [], F.lit(seats), ["source"]).select(
            F.col("source").alias("s"), F.col("quota").alias("blocks")), "mix-quotas")
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    cells = cells.join(by_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "shard", "words", "blocks", F.col("words").cast("double").alias("votes"))
    cells = apportion(cells, ["source"], F.col("blocks"), ["shard"])
    count = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(block_words))).cast("long")
    cells = cells.withColumn("n_blocks", count)
    passes = F.least(F.floor(F.col("quota") / F.col("n_blocks")), F.lit(int(max_epochs))).cast("long")
    rest = F.when(passes >= int(max_epochs), 0).otherwise(F.col("quota") - passes * F.col("n_blocks"))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("n_blocks"))
    cells = materialize(cells.select(
        F.col("source").alias("s"), F.col("shard").alias("c"), F.col("words").alias("stream"), passes.alias("passes"),
        (start * block_words).alias("run_from"), (rest * block_words).cast("long").alias("run_words"),
        (F.col("n_blocks") * block_words).alias("ring")), "mix-cells")

    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"),
                                                     "doc_id", "text_hash")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    laid = placed.withColumn("at", before)
    laid = laid.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("c"))).drop("s", "c")
    lead, tail = run_overlap()
    taken = F.col("passes") * F.col("size") + lead + tail
    return laid.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
                       "at", "passes", "run_from", "run_words", "ring")


def run_overlap() -> tuple[Column, Column]:
    """Words of a document inside its shard's run, and inside the part that wraps around."""
    a, b = F.col("at"), F.col("at") + F.col("size")
    end = F.col("run_from") + F.col("run_words")
    inside = F.greatest(F.lit(0), F.least(b, end) - F.greatest(a, F.col("run_from")))
    wrapped = F.greatest(F.lit(0), F.least(b, end - F.col("ring")) - a)
    return inside, F.when(end > F.col("ring"), wrapped).otherwise(0)


def mixed_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with column ``epoch``.

    Whole passes repeat the text unchanged. A document that a run enters or leaves
    contributes the words inside it, joined by single blanks; one that the run holds whole
    keeps its text. Columns are those of ``docs`` and ``epoch`` (0 first). Rows equal in id and
    text share the place of one of them.
    """
    plan = mix(docs, text_col=text_col, id_col=id_col, **options)
    inside, wrapped = run_overlap()
    a = F.col("at")
    skip = F.greatest(F.lit(0), F.col("run_from") - a)
    plan = plan.select(
        F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("size").alias("n"), "passes",
        skip.alias("skip"), inside.alias("inside"), wrapped.alias("wrapped"),
    ).dropDuplicates(["i", "h"]).filter("passes > 0 or inside > 0 or wrapped > 0")
    # the row travels as one struct, so no column name of the caller's can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"))
    both = rows.join(plan, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    whole = F.col("inside") + F.col("wrapped") >= F.col("n")
    piece = lambda lo, n: F.array_join(F.slice(words(F.col("text")), (lo + 1).cast("int"), n.cast("int")), " ")
    parts = F.concat_ws("\n", *[F.when(n > 0, piece(lo, n)) for lo, n in
                                ((F.lit(0), F.col("wrapped")), (F.col("skip"), F.col("inside")))])
    both = both.withColumn("epoch", F.explode(F.expr("sequence(0, cast(passes as int))"))).filter(
        "epoch < passes or inside > 0 or wrapped > 0")
    text = F.when((F.col("epoch") < F.col("passes")) | whole, F.col("row")[text_col]).otherwise(parts)
    return both.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
                       F.col("epoch").cast("int").alias("epoch"))
