"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two bases modulo the prime 2^31 - 1, the polynomial hash
of every prefix. Any span's hash follows from two entries, so span equality is one comparison and
the longest common extension of two positions is a binary search. The fingerprint of a
text is its length, its whole hash and a bottom-k sketch of the hashes of all its spans
of ``width`` code points; the likeness of two fingerprints is the Jaccard estimate of
their sketches. A text assembled from parts of two others takes its span hashes from
their prefix arrays; only spans across the seam are new.

Neighbours in id order meet by range: rows go to buckets of consecutive ids, the first row
of each bucket also to the bucket before (the very first to the last), and each bucket is
streamed in order. Only one boundary id per bucket reaches the driver.

Results for odd input: a null text is empty; a null id comes first; equal ids stand in
text-hash order; a lone document is followed by itself; two empty texts are alike (1.0),
an empty and a non-empty one are not (0.0); an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.common import long_array
from docket.session import ship_package

PRIME = (1 << 31) - 1
BASES = (1000003, 998244353)
_LOWEST = -(1 << 63) + 1
SIZE = 128  # hashes in a sketch: likeness has a standard error of at most 0.5 / sqrt(SIZE), 0.044
_ROWS = 128  # rows sent on at once, some kilobytes each
INVERSES = tuple(pow(base, -1, PRIME) for base in BASES)
_P, _BITS, _LIFT = np.uint64(PRIME), np.uint64(31), np.uint64(4 * PRIME)


def folded(x: np.ndarray) -> np.ndarray:
    """``x`` made smaller modulo 2^31 - 1, in place: the high bits are added to the low ones."""
    high = x >> _BITS
    x &= _P
    x += high
    return x


def canonical(x: np.ndarray) -> np.ndarray:
    """The least residue of values below twice the prime, in place (a wrapped difference is larger)."""
    return np.minimum(x, x - _P, out=x)


class PrefixHash:
    """Prefix arrays of one text. Spans are half-open ``[start, start + length)``."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes += np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for base in BASES:
            # sum of code[i] * base^i: folded terms are below 2^32, so the plain sum fits
            pre = np.zeros(self.n + 1, np.uint64)
            np.cumsum(folded(codes * powers(base, self.n)), out=pre[1:])
            self.prefix.append(folded(folded(pre)))  # below 2^32

    def windows(self, width: int) -> np.ndarray:
        """62-bit hashes of all spans of ``width``."""
        count = self.n - width + 1
        out = np.zeros(max(0, count), np.uint64)
        if count > 0:
            for base, pre in zip(INVERSES, self.prefix):
                raw = pre[width:] + _LIFT
                raw -= pre[:count]
                raw = folded(raw)
                raw *= powers(base, count)
                out <<= _BITS
                out |= canonical(folded(folded(raw)))
        return out

    def span(self, start: int, length: int) -> int:
        """The same hash for one span."""
        out = 0
        for base, pre in zip(INVERSES, self.prefix):
            raw = int(pre[start + length]) - int(pre[start])
            out = out << 31 | raw * int(powers(base, start + 1)[start]) % PRIME
        return out

    def whole(self) -> int:
        return self.span(0, self.n)


def joined(left: int, length: int, right: int) -> int:
    """Hash of a span of ``length`` with hash ``left`` followed by one with hash ``right``."""
    out = 0
    for i, base in enumerate(BASES):
        shift = 31 * (len(BASES) - 1 - i)
        out = out << 31 | ((left >> shift & PRIME) + (right >> shift & PRIME) * pow(base, length, PRIME)) % PRIME
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base^0 .. base^(n-1)`` modulo the prime, grown by doubling and kept up to a bound."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.ones(1, np.uint64)
        while len(table) < n:
            more = table * np.uint64(pow(base, len(table), PRIME))
            table = np.concatenate((table, canonical(folded(folded(more)))))
        if len(table) <= 1 << 20:
            _POWERS[base] = table
    return table[:n]


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common prefix of ``a[i:]`` and ``b[j:]``: gallop, then binary search."""
    most, reach = min(a.n - i, b.n - j), 1
    while reach <= most and equal_spans(a, i, b, j, reach):
        reach *= 2
    low, high = reach // 2, min(reach - 1, most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal_spans(a, i, b, j, middle) else (low, middle - 1)
    return low


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread hashes evenly over 64 bits, so that the least of them are a fair sample."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def sketch(mixed: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` least distinct of some mixed hashes."""
    share = 4 * size / max(1, len(mixed))
    while share < 1:  # even hashes: about four times as many as wanted; repeats may need more
        least = np.unique(mixed[mixed < np.uint64(int(share * 2.0**64))])
        if len(least) >= size:
            return least[:size]
        share *= 4
    return np.unique(mixed)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Jaccard estimate from two sketches: of the least of both, the part in both."""
    first, second = set(a.tolist()), set(b.tolist())
    union = sorted(first | second)[:size]
    return sum(x in first and x in second for x in union) / len(union) if union else 1.0


def encode(n: int, whole: int, least: np.ndarray) -> str:
    return f"{n:x}-{whole:016x}-" + least.astype(">u8").tobytes().hex()


def span_hashes(p: PrefixHash, width: int) -> np.ndarray:
    """Mixed hashes of all spans of ``width``; a shorter text is its own only span."""
    if 0 < p.n < width:
        return mix64(np.array([p.whole()], np.uint64))
    return mix64(p.windows(width))


def fingerprint(text: str, width: int = 24, size: int = SIZE) -> str:
    p = PrefixHash(text)
    return encode(p.n, p.whole(), sketch(span_hashes(p, width), size))


class _Document:
    __slots__ = ("id", "text", "hashes", "spans", "least")

    def __init__(self, doc_id, text, width, size):
        self.id, self.text = doc_id, text
        self.hashes = PrefixHash(text)
        self.spans = span_hashes(self.hashes, width)
        self.least = sketch(self.spans, size)


def edit(text: str, following: str) -> tuple[str, int, int]:
    """The text with its last half replaced by as much of the next one's head, and both lengths."""
    half = len(text) // 2
    kept, taken = len(text) - half, min(half, len(following))
    return text[:kept] + following[:taken], kept, taken


def compare(doc: _Document, following: _Document, width: int, size: int) -> tuple:
    """The output row of a document whose successor is known."""
    changed, kept, taken = edit(doc.text, following.text)
    if kept + taken < width:
        spans = span_hashes(PrefixHash(changed), width)
    else:  # spans left of the seam, right of it, and across it
        seam = PrefixHash(changed[max(0, kept - width + 1):kept + width - 1])
        left = doc.spans[:max(0, kept - width + 1)] if doc.hashes.n >= width else doc.spans[:0]
        right = following.spans[:max(0, taken - width + 1)] if following.hashes.n >= width else doc.spans[:0]
        spans = np.concatenate((left, right, mix64(seam.windows(width))))
    least = sketch(spans, size)
    whole = joined(doc.hashes.span(0, kept), kept, following.hashes.span(0, taken))
    same = kept + min(taken, common_extension(doc.hashes, kept, following.hashes, 0))
    return (doc.id, doc.hashes.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            encode(doc.hashes.n, doc.hashes.whole(), doc.least), encode(kept + taken, whole, least),
            likeness(doc.least, least, size), likeness(doc.least, following.least, size), same)


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_prefix long")
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def fingerprints(docs: DataFrame, width: int = 24, size: int = SIZE, bucket_chars: int = 1 << 21,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    ``common_prefix`` is the longest common extension of both from the start.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = d.withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("h", F.xxhash64("text"))
    chars, rows = keyed.agg(F.sum(F.char_length("text")), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], _SCHEMA)
    buckets = max(1, min(-(-(chars + 1) // bucket_chars), rows))
    cuts = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(keyed.agg(F.percentile_approx("k", at, 100 * buckets)).first()[0]))
    # the bucket is the number of boundary ids below the row's id
    bucket = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        bounds = long_array(cuts)
        bucket = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(
            (lo + step <= len(cuts)) & (F.get(bounds, lo + step - 1) < F.col("k")), lo + step).otherwise(lo))
    keyed = keyed.withColumn("bucket", bucket)
    # every bucket's first row, by id and text hash; it also ends the bucket before
    heads = keyed.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("head")).orderBy("bucket").collect()
    boundary = spark.createDataFrame(
        [(row.head.k, row.head.h, heads[i - 1].bucket) for i, row in enumerate(heads)], "k long, h long, to int")
    # one boundary row per bucket: bounded by the number of buckets
    tails = (keyed.drop("bucket").join(F.broadcast(boundary), ["k", "h"]).dropDuplicates(["to"])
             .select("doc_id", "text", "k", "h", F.col("to").alias("bucket"), F.lit(True).alias("tail")))
    dealt = keyed.select("doc_id", "text", "k", "h", "bucket", F.lit(False).alias("tail")).unionByName(tails)
    ordered = dealt.repartition(len(heads), "bucket").sortWithinPartitions("bucket", "tail", "k", "h")

    def run(batches):
        earlier, bucket, out = None, None, []
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            ids, texts, _, _, where, tails_ = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                b, current = where[i].as_py(), _Document(ids[i].as_py(), texts[i].as_py(), width, size)
                if earlier is not None and b == bucket:
                    out.append(compare(earlier, current, width, size))
                earlier, bucket = (None if tails_[i].as_py() else current), b
                if len(out) >= _ROWS or out and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)
                    out = []

    return ordered.mapInArrow(run, _SCHEMA)
