"""Merkle manifest of a document table with incremental witnesses.

A row's leaf is the SHA-256 of its five columns. Per source the leaves stand in id order; runs
of three become their parent's hash until one node is left, the source's subroot, and
the subroots make the root the same way.

A leaf's witness is the list of hashes that lead from it to the root. It grows while the
tree does: :class:`Appender` takes leaves in order and keeps one short run of open
subtrees per level. When a sibling completes a run, the run's hashes are attached to the
partial witnesses of all leaves below it, and the parent is appended one level up.
Blocks of ``3 ** levels`` leaves are aligned with the tree, so they are appended to in
different tasks; the roots of a source's blocks are further appends, in blocks again, until one
block holds them. A task holds one block at a time, whatever the size of a source.

Leaves are ranked by a range sort on narrow rows (a hot source is spread over many
tasks); only the root, one hash, reaches the driver. Texts are read once and not shuffled.

Results for odd input: a null column is hashed as ``-``; a null id comes first in its
source and is never tampered with; a null source is a source of its own, the first; equal ids stand in
leaf-hash order; repeated rows are leaves of their own (with proofs of their own); a
very long text costs one hash; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.operators.requests import numbered
from docket.session import ship_package
from docket.sinks.tables import materialize

RUN = 3  # children of a node
WIDTH = 32  # bytes of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = 4096  # rows sent on at once


def parent(run: list[bytes]) -> bytes:
    """Hash of the hex texts of a run of nodes."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


class Appender:
    """A growing sequence of leaves: open subtrees by level and the witnesses as far as known."""

    def __init__(self):
        self.open: list[list[tuple[bytes, int]]] = [[]]  # (node, its first leaf)
        self.witness: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        self.witness.append(bytearray())
        self._push(0, leaf, len(self.witness) - 1)

    def _push(self, level: int, node: bytes, first: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, first))
        if len(self.open[level]) == RUN:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run is complete: every leaf below learns the run's other nodes."""
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        ends = [first for _, first in run[1:]] + [len(self.witness)]
        for i, ((_, first), end) in enumerate(zip(run, ends)):
            others = b"".join(nodes[:i] + nodes[i + 1:])
            for leaf in range(first, end):
                self.witness[leaf] += others
        self._push(level + 1, parent(nodes), run[0][1])

    def finish(self, levels: int | None = None) -> bytes:
        """Close the runs cut short, up to ``levels`` (or until one node is left); that node."""
        level = 0
        while True:
            here = self.open[level]
            done = level == levels if levels is not None else len(here) == 1 and not any(self.open[level + 1:])
            if done:
                return here[0][0]
            if here:
                self._close(level)
            level += 1


def fold(node: bytes, place: int, size: int, witness: bytes) -> tuple[bytes, bytes]:
    """The top node that a node at ``place`` of ``size`` leads to, and the witness that is left."""
    at = 0
    while size > 1:
        run = min(RUN, size - place // RUN * RUN)
        siblings = [witness[at + WIDTH * k: at + WIDTH * (k + 1)] for k in range(run - 1)]
        siblings.insert(place % RUN, node)
        at += WIDTH * (run - 1)
        node, place, size = parent(siblings), place // RUN, -(-size // RUN)
    return node, witness[at:]


def _append_blocks(levels: int, schema: pa.Schema):
    """Per-task function over rows in (key, block, idx) order: adds ``witness``, and ``head`` to a block's first row."""
    size = RUN ** levels

    def finished(held):
        table = pa.Table.from_batches(held).combine_chunks()
        one = Appender()
        for leaf in table["digest"].to_pylist():
            one.append(leaf)
        top = one.finish(levels if table["n"][0].as_py() > size else None)
        heads = [top] + [None] * (len(table) - 1)
        return table.append_column("witness", pa.array([bytes(w) for w in one.witness], pa.binary())).append_column(
            "head", pa.array(heads, pa.binary()))

    def run(batches):
        held, block, out = [], None, []

        def ready():
            table = pa.concat_tables(out).cast(schema).combine_chunks()
            out.clear()
            return table.to_batches()

        for batch in batches:
            keys, places = batch.column("key").to_pylist(), batch.column("idx").to_pylist()
            start = 0
            for i, now in enumerate((k, p // size) for k, p in zip(keys, places)):
                if now != block:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        out.append(finished(held))
                        if sum(map(len, out)) >= _ROWS:
                            yield from ready()
                    held, block, start = [], now, i
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            out.append(finished(held))
        if out:
            yield from ready()

    return run


def forest(nodes: DataFrame, levels: int = 7, name: str = "merkle") -> tuple[DataFrame, DataFrame]:
    """Nodes with their ``witness`` up to their key's top node, and that node as ``(key, root)``.

    ``nodes`` has key (string), idx (from 0 without gaps in each key), n (rows of the key) and
    digest (binary); other columns are carried along.
    """
    ship_package(nodes.sparkSession)
    size = RUN ** levels
    block = F.expr(f"idx div {size}")
    ordered = nodes.repartition("key", block).sortWithinPartitions("key", "idx")
    fields = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in nodes.schema] + [
        pa.field("witness", pa.binary()), pa.field("head", pa.binary())]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", witness binary, head binary"
    done = materialize(ordered.mapInArrow(_append_blocks(levels, pa.schema(fields)), ddl), name)
    heads = done.filter("head is not null").select("key", block.alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
                                                   F.col("head").alias("digest"))
    done = done.drop("head")
    if (done.agg(F.max("n")).first()[0] or 0) <= size:
        return done, heads.select("key", F.col("digest").alias("root"))
    above, roots = forest(heads, levels, f"{name}-up")
    above = above.select(F.col("key").alias("k"), F.col("idx").alias("b"), F.col("witness").alias("more"))
    whole = done.join(above, (F.col("key") == F.col("k")) & (block == F.col("b")))
    return whole.withColumn("witness", F.concat("witness", "more")).drop("k", "b", "more"), roots


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def field(value: Column) -> Column:
    """A column as it enters the leaf: ``-`` or its bytes after their number."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column, columns=COLUMNS) -> Column:
    """SHA-256 of a row, with ``text`` in place of its text."""
    parts = [field(text if c == columns[-1] else F.col(c)) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, digest, tampered)``: leaves, and what they become if the line breaks go (null where nothing changes)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:3], F.col("n_chars").cast("long").alias("n_chars"),
                    F.col("text").cast("string").alias("text"))
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    # null sources sort first, and keys are never null
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    return d.select(key.alias("key"), "doc_id", leaf_hash(F.col("text")).alias("digest"),
                    F.when(chosen, leaf_hash(bare)).alias("tampered"))


def manifest(docs: DataFrame, levels: int = 7) -> tuple[DataFrame, bytes | None]:
    """One row per document and the root: ``doc_id, digest, tampered, idx, n, witness``, and the place of its
    source among the sources (``s_idx, s_n, s_witness, subroot``)."""
    told = materialize(leaves(docs).withColumn("copy", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(told.select(F.struct("key", "doc_id", "digest", "copy").alias("place"), "tampered"), "place").select(
        "place.key", "place.doc_id", "place.digest", "tampered", "idx")
    sources = materialize(placed.groupBy("key").agg(F.min("idx").alias("first"), F.count("*").alias("n")), "merkle-sources")
    nodes = placed.join(sources.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select(
        "key", "doc_id", "digest", "tampered", (F.col("idx") - F.col("first")).alias("idx"), "n")
    known, subroots = forest(nodes, levels, "merkle")
    tops = numbered(subroots.select(F.struct("key", "root").alias("place")), "place").select(
        F.lit("").alias("key"), "idx", F.col("n_rows").alias("n"), F.col("place.root").alias("digest"),
        F.col("place.key").alias("source_key"))
    tops, root = forest(tops, levels, "merkle-top")
    tops = materialize(tops.select(
        "source_key", F.col("idx").alias("s_idx"), F.col("n").alias("s_n"), F.col("witness").alias("s_witness"),
        F.col("digest").alias("subroot")), "merkle-subroots")
    found = root.first()
    whole = known.join(tops, known.key == tops.source_key).drop("key", "source_key")
    return whole, bytes(found.root) if found else None


_PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
           "n_siblings long")


def prove(documents: DataFrame, root: bytes) -> DataFrame:
    """Digest of every row's witness, and the root that it leads to from the row as it is now."""
    top = root.hex()

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                witness = r["witness"] + r["s_witness"]
                node, rest = fold(r["tampered"] or r["digest"], r["idx"], r["n"], witness)
                node, _ = fold(node, r["s_idx"], r["s_n"], rest)
                rows.append((r["doc_id"], r["digest"].hex(), r["subroot"].hex(), top,
                             hashlib.sha256(witness.hex().encode()).hexdigest(), node.hex(), node == root, len(witness) // WIDTH))
            if rows:
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=[c.split()[0] for c in _PROVED.split(", ")])

    return documents.mapInArrow(run, _PROVED)


def verified_manifest(docs: DataFrame, levels: int = 7) -> DataFrame:
    """The manifest's digests per document, each proof folded from the row as it is now."""
    rows, root = manifest(docs, levels)
    if root is None:
        return docs.sparkSession.createDataFrame([], _PROVED)
    return prove(rows, root)
