"""SimHash near-duplicate detection by segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so it is a lossless filter. Splitting the segments into ``bits // 2 + 1``
parts leaves at least one part at Manhattan distance 0 or 1 for every pair within the
bound (pigeonhole); a grid join whose cells are the counts of one part finds those:
every fingerprint stands in its own cell and in the cells one count above it. Candidates
are then verified on the exact bits, and links are contracted to components.

Only distinct fingerprints take part, so copies cost nothing beyond the fingerprint
itself. Cells are keyed by 16 counts (24 bits of entropy for bound 3).

Results for odd input: a null or wordless text has fingerprint zero and links like any
other; a null id keeps its row (its component is the least non-null id of the group, or
null); repeated rows give repeated rows; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.session import ship_package
from docket.sinks.tables import materialize

_ONES = 0x5555555555555555
_SEGMENTS = 32
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_OFFSET = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, ASCII letters lower-cased."""
    ws = (text or "").encode("utf-8").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(ws) - size + 1].tolist()
    stops = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    byte_values = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET
    per_byte = np.bincount(byte_values.ravel(), minlength=2048).reshape(8, 256)
    set_bits = (2 * (per_byte @ _BYTE_BITS) > len(hashes)).ravel()
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fingerprint, *keep)``: the signed 64-bit SimHash of every whole text; ``keep`` columns are carried along."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            values = np.fromiter(
                (majority_bits(shingle_hashes(t.as_py(), shingle)) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]],
                                             names=["doc_id", "fingerprint", *keep])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, "doc_id long, fingerprint long" + kept)


def embed(fingerprint: str) -> str:
    """SQL: bit counts of the 32 two-bit segments, packed into the same two-bit fields."""
    a, b = f"({fingerprint} & {_ONES}L)", f"(shiftrightunsigned({fingerprint}, 1) & {_ONES}L)"
    return f"(({a} ^ {b}) | shiftleft({a} & {b}, 1))"


def links(points: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in 1 to ``bits`` bits."""
    parts = bits // 2 + 1
    edges = [_SEGMENTS * p // parts for p in range(parts + 1)]
    embedded = points.select("fingerprint", F.expr(embed("fingerprint")).alias("counts"))
    structs = []
    for p in range(parts):
        mask = sum(3 << (2 * s) for s in range(edges[p], edges[p + 1]))
        mask -= (1 << 64) if mask >> 63 else 0
        structs.append(f"struct({p} as part, {edges[p]} as lo, {edges[p + 1] - 1} as hi, "
                       f"counts & cast('{mask}' as bigint) as cell)")
    cells = embedded.select("fingerprint", F.expr(f"explode(array({', '.join(structs)})) as c")).select(
        "fingerprint", "c.*")
    # the cell itself, and each cell with one more bit in one segment
    field = "(shiftrightunsigned(cell, 2 * i) & 3L)"
    above = (f"transform(filter(sequence(lo, hi), i -> {field} < 2L), "
             f"i -> cell ^ shiftleft(if({field} = 0L, 1L, 3L), 2 * i))")
    reach = cells.select(F.col("fingerprint").alias("a"), "part",
                         F.expr(f"explode(concat(array(cell), {above})) as cell"))
    home = cells.select(F.col("fingerprint").alias("b"), "part", "cell")
    near = F.expr(f"a <> b and bit_count(a ^ b) <= {int(bits)}")
    return reach.join(home, ["part", "cell"]).filter(near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge list ``(a, b)`` but the roots; root is the least node reachable.

    Alternating star contraction: each round hangs a node's larger neighbours, then its
    smaller ones, on its least neighbour. Neighbour sets are never gathered (a minimum
    and a join per half round), and each round is written, which cuts the lineage.
    """

    def hang(pairs: DataFrame, upward: bool) -> DataFrame:
        if upward:
            near = pairs.union(pairs.select("b", "a"))
            least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            return near.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        least = pairs.groupBy("b").agg(F.min("a").alias("m"))
        joined = pairs.join(least, "b")
        return joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(
            joined.select(F.col("m").alias("a"), "b")).distinct()

    current, seen = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc"), None
    for _ in range(rounds):
        current = materialize(hang(hang(current, True), False), "cc")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``(doc_id, fingerprint, component_id)``, fingerprint as a long.

    With ``keep`` these columns and ``root`` follow, a fingerprint that names the group. Only
    that tells groups apart when ids are null or repeated.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col, keep), "simhash")
    points = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-points")
    roots = components(links(points, bits))
    rooted = materialize(
        points.join(roots, points.fingerprint == roots.node, "left").select(
            "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")), "simhash-roots")
    # Joins without a shared parent, so a hot fingerprint can be split by the adaptive plan.
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = (*keep, "root") if keep else ()
    ids = materialize(rooted.join(least, "root").select("fingerprint", "component_id", *named[-1:]), "simhash-ids")
    return prints.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id", *named)
