"""LM scoring by context-tree weighting over bytes, beside a word unigram base score.

Every byte is eight binary decisions, one of 255 decision nodes each, and every decision
has its own context tree over the preceding bytes. A context's Krichevsky-Trofimov
estimate is mixed half and half with what its longer contexts give, at every depth; the
mixing weights follow in closed form from the training counts. The counts are sums over
the whole training part of the corpus.

All contexts of up to three bytes are in the tree, each with its own estimates. ``contexts``
only says where a leaf's table is looked up: a three-byte context that holds at least one in
``contexts`` training bytes (at most ``contexts`` can) is sent to every task; the tables of
the others stay a table of rows, worked out per two-byte parent (at most 65,536 rows of counts
each) and joined with what the documents hold of them. What reaches driver and tasks is
bounded: 256 numbers for each of at most ``contexts + 65,793`` leaves, 510 for each two-byte
context, and the numbers of the other contexts seen (at most 2^24).

Base score: the ``head`` most frequent words (of at most 64 bytes) are sent to every task;
the others are counted per document, joined with the table of word counts and summed.

Results for odd input: a null text is empty and scores as its end alone; a null id counts
as training; repeated rows are trained on and scored each; without training rows every
estimate is the uninformed one; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.session import ship_package
from docket.sinks.tables import materialize

PAD = b"\0\0\0"
_PIECE = 1 << 22  # bytes worked on at once
_FLUSH = 1 << 19  # words held before partial counts are sent on


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and each text's end (0) after its three predecessors, as 32-bit codes, and
    where every text's codes start. Texts begin after three zeros."""
    buffer = np.frombuffer(b"".join(PAD + t + b"\0" for t in texts), np.uint8).astype(np.uint32)
    codes = buffer[3:] | buffer[2:-1] << 8 | buffer[1:-2] << 16 | buffer[:-3] << 24
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes[:-1])))
    if len(texts) > 1:  # the codes that predict the padding between texts
        wanted = np.ones(len(codes), bool)
        ends = np.cumsum(sizes + 3)[:-1] - 3
        for k in range(3):
            wanted[ends + k] = False
        codes = codes[wanted]
    return codes, starts


def pieces(texts):
    """Lists of texts of some megabytes together; a longer text stands alone."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def lowered(column) -> list[bytes]:
    """UTF-8 of each text with ASCII letters in lower case; null is empty."""
    return [(t.as_py() or "").encode("utf-8").lower() for t in column]


def partial_counts(batches):
    """Rows ``(word, gram, n)``: counts of words (gram null) and of byte grams (word null)."""
    words, grams, total = Counter(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def rows(found):
        ws, ns = list(found.keys()), list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(ws, pa.string()), pa.nulls(len(ws), pa.int64()), pa.array(ns, pa.int64())], names=["word", "gram", "n"])

    for batch in batches:
        for texts in pieces(lowered(batch.column(0))):
            for t in texts:
                words.update(t.split())
            if len(words) >= _FLUSH:
                yield rows(words)
                words = Counter()
            codes, n = np.unique(byte_grams(texts)[0], return_counts=True)
            both, where = np.unique(np.concatenate((grams, codes)), return_inverse=True)
            grams, total = both, np.bincount(where, np.concatenate((total, n))).astype(np.int64)
    if words:
        yield rows(words)
    if len(grams):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(total)],
                                         names=["word", "gram", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decision nodes from counts by next byte ``(contexts, 256)``."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """ln probability of each byte from the probability of a one at each decision node."""
    out, at = np.zeros((len(one), 1)), 0
    for level in range(8):
        p = one[:, at:at + (1 << level)]
        at += 1 << level
        out = np.stack((out + np.log1p(-p), out + np.log(p)), axis=2).reshape(len(one), 2 << level)
    return out


class Node:
    """Contexts of one depth: KT estimates and the mixture's weights at all decision nodes."""

    def __init__(self, counts: np.ndarray):
        zeros, ones = decisions(counts)
        self.kt = log_kt(zeros, ones)
        self.one = (ones + 0.5) / (zeros + ones + 1)
        self.weighted = self.kt  # of a leaf
        self.stop = np.ones_like(self.kt)

    def mix(self, longer: np.ndarray) -> "Node":
        """Mix with the sum of the children's ln weighted probabilities."""
        difference = np.clip(longer - self.kt, -700, 700)
        self.weighted = self.kt + np.logaddexp(0, difference) - math.log(2)
        self.stop = 1 / (1 + np.exp(difference))
        return self

    def predict(self, longer: np.ndarray) -> np.ndarray:
        return self.stop * self.one + (1 - self.stop) * longer


def above(top, c: int, p: np.ndarray) -> np.ndarray:
    """Mix estimates under the last byte ``c`` with those of that byte and of no context."""
    root_stop, root_one, stop, one = top
    return root_stop * root_one + (1 - root_stop) * (stop[c] * one[c] + (1 - stop[c]) * p)


def by_context(t: pa.Table) -> tuple[np.ndarray, Node]:
    """Three-byte contexts of byte-gram counts ``(gram, n)`` and their estimates."""
    codes, n = t["gram"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.float64)
    contexts, at = np.unique(codes >> 8, return_inverse=True)
    counts = np.zeros((len(contexts), 256))
    counts[at, codes & 255] = n
    return contexts, Node(counts)


def rest_sums(t: pa.Table) -> pa.Table:
    """Of one parent's contexts that are not sent to the tasks: their numbers, and the sum of their ln estimates."""
    contexts, node = by_context(t)
    return pa.table({"parent": pa.array([int(contexts[0]) & 0xFFFF], pa.int64()), "contexts": pa.array([contexts], pa.list_(pa.int64())),
                     "longer": pa.array([node.kt.sum(0).tobytes()], pa.binary())})


def rest_logs(top, parents):
    """Per-parent function: ``(context, logs)``, a leaf table for each context that is not sent to the tasks."""

    def run(t: pa.Table) -> pa.Table:
        contexts, node = by_context(t)
        parent = int(contexts[0]) & 0xFFFF
        stop, one = parents.value[parent]
        logs = byte_logs(above(top.value, parent & 255, stop * one + (1 - stop) * node.one)).astype(np.float32)
        return pa.table({"context": pa.array(contexts, pa.int64()), "logs": pa.array(list(logs), pa.list_(pa.float32()))})

    return run


class Model:
    """Leaf tables of the weighted context tree.

    ``table[leaf, byte]`` is ln of the predictive probability; ``leaf`` is found by the last
    three bytes. The contexts not in ``three`` are ``rest``: sorted parents, and the sum of their
    children's ln estimates at all decision nodes; their own tables come from ``rest_logs``.
    Without ``rest`` those of a parent share one leaf.
    """

    def __init__(self, two: np.ndarray, two_n: np.ndarray, three: np.ndarray, three_n: np.ndarray, rest=None):
        """Sorted codes (context bytes, then next byte) and counts at depth two and three."""
        by_last = np.zeros((256, 256))
        np.add.at(by_last, ((two >> 8) & 255, two & 255), two_n)
        root, last = Node(by_last.sum(0, keepdims=True)), Node(by_last)
        tables, self.three, self.leaf3, self.leaf2 = [], [], [], np.full(1 << 16, -1, np.int64)
        staged, n_leaves, self.parents = [], 0, {}
        for c in range(256):  # all contexts that end in byte c
            mine, mine3 = (two >> 8) & 255 == c, (three >> 8) & 255 == c
            ctx2, at2 = np.unique(two[mine] >> 8, return_inverse=True)
            if not len(ctx2):
                continue
            counts2 = np.zeros((len(ctx2), 256))
            counts2[at2, two[mine] & 255] = two_n[mine]
            ctx3, at3 = np.unique(three[mine3] >> 8, return_inverse=True)
            counts3 = np.zeros((len(ctx3), 256))
            counts3[at3, three[mine3] & 255] = three_n[mine3]
            parent = np.searchsorted(ctx2, ctx3 & 0xFFFF)
            rest_counts = counts2.copy()
            np.subtract.at(rest_counts, parent, counts3)
            leaves, other = Node(counts3), Node(rest_counts)
            if rest is None:
                longer, unlisted = other.weighted.copy(), other.one
            else:
                longer, unlisted = np.zeros((len(ctx2), 255)), np.full((1, 255), 0.5)
                own = rest[0] & 255 == c
                longer[np.searchsorted(ctx2, rest[0][own])] = rest[1][own]
            np.add.at(longer, parent, leaves.weighted)
            middle = Node(counts2).mix(longer)
            if rest is not None:
                own = np.searchsorted(ctx2, rest[0][own])
                self.parents.update(zip(ctx2[own].tolist(), zip(middle.stop[own], middle.one[own])))
            staged.append((c, ctx2, ctx3, parent, middle.predict(unlisted),
                           middle.stop[parent] * middle.one[parent] + (1 - middle.stop[parent]) * leaves.one,
                           middle.weighted.sum(0)))
        sums = np.zeros_like(last.kt)
        for c, *_, total in staged:
            sums[c] = total
        last.mix(sums)
        root.mix(last.weighted.sum(0, keepdims=True))
        self.top = (root.stop, root.one, last.stop, last.one)
        up = lambda c, p: above(self.top, c, p)
        for c, ctx2, ctx3, _, p2, p3, _ in staged:
            tables += [byte_logs(up(c, p2)), byte_logs(up(c, p3))]
            self.leaf2[ctx2] = n_leaves + np.arange(len(ctx2))
            self.three.append(ctx3)
            self.leaf3.append(n_leaves + len(ctx2) + np.arange(len(ctx3)))
            n_leaves += len(ctx2) + len(ctx3)
        half = np.full((1, 255), 0.5)  # a context never seen: its own estimate is even
        for c in range(256):
            unseen = np.flatnonzero(self.leaf2[np.arange(256) << 8 | c] < 0) << 8 | c
            tables.append(byte_logs(up(c, half)))
            self.leaf2[unseen] = n_leaves
            n_leaves += 1
        self.table = np.concatenate(tables).astype(np.float32)
        self.three = np.concatenate(self.three) if self.three else np.zeros(0, np.int64)
        self.leaf3 = np.concatenate(self.leaf3) if self.leaf3 else np.zeros(0, np.int64)
        self.joined = np.zeros(0, np.int64)

    def leaves(self) -> np.ndarray:
        """Leaf of every three-byte context; -1 for those whose table is joined."""
        out = np.tile(self.leaf2.astype(np.int32), 256)
        out[self.three] = self.leaf3
        out[self.joined] = -1
        return out


def fit(grams: DataFrame, contexts: int) -> tuple[Model, DataFrame]:
    """The model from byte-gram counts ``(gram, n)`` of the whole training part, and the table ``(context, logs)`` of the rest."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    kept = (grams.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("n").alias("all"))
            .filter(F.col("all") * contexts >= total).select("context"))
    is_kept = F.shiftrightunsigned("gram", 8) == F.col("context")
    three = grams.join(kept, is_kept, "left_semi")
    rest = materialize(grams.join(kept, is_kept, "left_anti").select(
        F.shiftrightunsigned("gram", 8).bitwiseAND(0xFFFF).alias("parent"), "gram", "n"), "lm-rest").groupBy("parent")
    two = grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n"))

    def arrays(df):
        t = df.select("gram", "n").toArrow()
        return t["gram"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.float64)

    sums = rest.applyInArrow(rest_sums, "parent long, contexts array<long>, longer binary").toArrow().sort_by("parent")
    longer = np.array([np.frombuffer(x.as_py()) for x in sums["longer"]]).reshape(-1, 255)
    model = Model(*arrays(two), *arrays(three), (sums["parent"].to_numpy().astype(np.int64), longer))
    model.joined = np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in sums["contexts"])])
    sc = grams.sparkSession.sparkContext
    logs = rest_logs(sc.broadcast(model.top), sc.broadcast(model.parents))
    model.parents = {}
    return model, materialize(rest.applyInArrow(logs, "context long, logs array<float>"), "lm-rest-tables")


_LOADED: dict[str, tuple] = {}


def scorer(model, head, key: str):
    """Per-task function over batches ``(row, doc_id, text)``: model score and head words, and what is to be joined."""

    def run(batches):
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = (model.value.leaves(), model.value.table.ravel(), head.value)
        leaves, table, known = _LOADED[key]
        for batch in batches:
            done = 0
            for texts in pieces(lowered(batch.column(2))):
                codes, starts = byte_grams(texts)
                at = leaves[codes >> np.uint32(8)].astype(np.int64)
                there = np.flatnonzero(at < 0)  # their leaf tables are joined: a document's grams with counts
                in_doc = np.searchsorted(starts, there, "right") - 1
                own, gram_ns = np.unique(in_doc.astype(np.uint64) << np.uint64(32) | codes[there], return_counts=True)
                cuts = pa.array(np.searchsorted(own, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32)).astype(np.int32))
                rest = pa.ListArray.from_arrays(cuts, pa.array((own & np.uint64(0xFFFFFFFF)).astype(np.int64)))
                rest_n = pa.ListArray.from_arrays(cuts, pa.array(gram_ns.astype(np.int32)))
                found = table[np.where(at < 0, 0, at) << 8 | (codes & np.uint32(255))].astype(np.float64)
                found[there] = 0
                logs = np.add.reduceat(found, starts) / math.log(10)
                sums, tokens, seen, tails, tail_ns = [], [], [], [], []
                for t in texts:
                    own = Counter(t.split())
                    total, n, rare = 0.0, 0, []
                    for w, k in own.items():
                        if (value := known.get(w)) is None:
                            rare.append(w)
                        else:
                            total += k * value
                            n += k
                    sums.append(total)
                    tokens.append(sum(own.values()) + 1)
                    seen.append(n)
                    tails.append(rare)
                    tail_ns.append([own[w] for w in rare])
                rows = slice(done, done + len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(tokens, pa.int64()), pa.array(logs),
                     pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(sums, pa.float64()),
                     pa.array(seen, pa.int64()), pa.array(tails, pa.list_(pa.string())),
                     pa.array(tail_ns, pa.list_(pa.int32())), rest, rest_n], names=[c.split()[0] for c in _SCORED.split(", ")])

    return run


_SCORED = ("row long, doc_id long, n_tokens long, score double, n_bytes long, head_sum double, head_known long, "
           "tail array<string>, tail_n array<int>, rest array<long>, rest_n array<int>")


def score(docs: DataFrame, contexts: int = 1 << 16, head: int = 1 << 16, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Held-out flag, token counts, base score, model score and bits per byte of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = d.filter(~held_out(F.col("doc_id")))
    partial = materialize(train.select("text").mapInArrow(partial_counts, "word string, gram long, n long"), "lm-partial")
    counts = materialize(partial.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    grams = materialize(partial.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    docs_in, (total, distinct) = train.count(), counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total + docs_in, distinct + (docs_in > 0)  # with the end tokens
    floor = math.log10(tokens + kinds + 1)
    top = (counts.filter(F.octet_length("word") <= 64).orderBy(F.desc("c"), "word").limit(head)
           .select(F.col("word").cast("binary"), "c").toArrow())
    known = {w: math.log10(c + 1) - floor for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist())}

    fitted, tables = fit(grams, contexts)
    model, values = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast(known)
    numbered = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = materialize(numbered.mapInArrow(scorer(model, values, str(id(model)) + str(model._jbroadcast.id())), _SCORED),
                         "lm-scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select(
        "row", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("k"))
    tail = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(floor))).alias("tail_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known"))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select(
        "row", F.shiftrightunsigned("x.rest", 8).alias("context"), F.col("x.rest").bitwiseAND(255).cast("int").alias("byte"), "x.rest_n")
    rest = rest.join(tables, "context").groupBy("row").agg(
        F.sum(F.col("rest_n") * F.get("logs", F.col("byte")).cast("double")).alias("rest_sum"))
    end = math.log10(docs_in + 1) - floor
    scored = scored.drop("tail", "tail_n", "rest", "rest_n").join(tail, "row", "left").join(rest, "row", "left").withColumn(
        "score", F.col("score") + F.coalesce("rest_sum", F.lit(0.0)) / math.log(10))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(docs_in > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
