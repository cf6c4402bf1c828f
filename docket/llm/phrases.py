"""Phrase collocation mining with exact n-gram counts from HAT-tries.

A task numbers the words it meets and counts word-id sequences in a HAT-trie: a shallow
trie over ids whose leaves are hash containers of the remaining ids, packed into one
integer. Below the root a container is hybrid: it serves 64 first ids. A container that
outgrows ``burst`` entries becomes a trie node with one container per next id. When a
task's tries hold more than ``entries`` sequences, the largest subtrees are spilled whole,
each as a run of phrases sorted by words. Runs are merged per prefix partition: rows are dealt by
the hash of all words but the last and of a 64th of the last words, so that the subtree of a
very common prefix is merged in 64 places.

A phrase cannot be more frequent than its parts. Words are counted first, then pairs of
frequent words, then longer sequences whose pairs are all frequent, told by a bit table
of hashes of the frequent ones: a filter of fixed size (``filter_bits``) that never misses
one. The more the corpus has of them, the less it saves; results stay the same.

Scores, the least cut of a candidate, candidates inside a longer one, and the ranking are
joins and aggregates on the frequent phrases.

Results for odd input: a null text has no words; a null language is ``und``; a text of one
word is one word; repeated rows are counted as often as they occur; equal scores are
ordered by count, then phrase; a very long text is worked on in chunks, each with the last
words before it; an empty table gives an empty table; ids and other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docket.session import ship_package
from docket.sinks.tables import materialize

STEPS = ((1,), (2,), (3, 4))  # lengths counted in one pass over the texts
_ID_BITS = 19  # three ids and a place among 64 are packed into one integer
_HYBRID = 6  # bits of the first id in a hybrid container
_WINDOW = 1 << 18  # words worked on at once
_IDS = 200_000  # words numbered before a task starts its numbering anew; with a window's below 2 ** _ID_BITS
_SEEN = 1 << 20  # words remembered, those that cannot be in a phrase too
_CHUNK = 1 << 20  # bytes of text worked on at once
_OUT = 1 << 16  # rows sent on at once
_BREAK = b"\xff"  # never part of UTF-8
_FOLD = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\n\v\f\r":
    _FOLD[_c] = 0xFF
_FOLD = bytes(_FOLD)
_U = np.uint64


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, ASCII letters in lower case, with ``_BREAK`` between pieces."""
    return text.translate(_FOLD).replace(_BREAK, b" " + _BREAK + b" ").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sequence_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences from the hashes of their words (one array per place)."""
    out = words[0]
    for w in words[1:]:
        out = mixed(out * _U(0x9E3779B97F4A7C15) + w)
    return out


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class Filter:
    """Bit table of hashes: tells which sequences may be frequent."""

    def __init__(self, table: np.ndarray):
        self.shift = 64 - (len(table) * 64).bit_length() + 1
        self.table, self.bytes = table, memoryview(table.view(np.uint8))  # little-endian words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> _U(self.shift)
        return (self.table[slot >> _U(6)] >> (slot & _U(63))) & _U(1) == 1

    def has_one(self, h: int) -> bool:
        slot = h >> self.shift
        return self.bytes[slot >> 3] >> (slot & 7) & 1 == 1


class Ids(dict):
    """Numbers of the words of one language, from 1; 0 for breaks and words that cannot be in a phrase."""

    def __init__(self, lang: str, known: Filter | None):
        super().__init__({_BREAK: 0})
        self.seed, self.known = language_seed(lang), known
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if self.known is not None and not self.known.has_one(h):
            self[word] = 0
            return 0
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > len(self.words) + _SEEN:  # forget the others
            for w in [w for w, n in self.items() if not n and w != _BREAK]:
                del self[w]
        found = itemgetter(*words)(self) if len(words) > 1 else [self[w] for w in words]
        return np.array(found, np.int64)


class Node(dict):
    """A trie node: next id -> node or hash container (a plain dict: packed remaining ids -> count)."""


class HatTrie:
    """Counts of id sequences. Below the root, hybrid containers serve ``2 ** _HYBRID`` first ids each."""

    def __init__(self, rest: int, burst: int, bits: int = _ID_BITS):
        self.rest, self.burst, self.bits = rest, burst, bits  # rest: ids after the first
        self.shifts = [bits * (rest - level) for level in range(rest + 1)]
        self.root, self.size = Node(), 0

    def add(self, first: np.ndarray, packed: np.ndarray) -> None:
        """Count sequences given by their first id and their other ids packed."""
        if not len(first):
            return
        shift = self.shifts[0]
        if shift + self.bits <= 62:
            whole, counts = np.unique(first << shift | packed, return_counts=True)
            edges, keys = whole >> (shift + _HYBRID), whole & ((1 << shift + _HYBRID) - 1)
        else:
            edges, keys = first >> _HYBRID, (first & ((1 << _HYBRID) - 1)) << shift | packed
            order = np.lexsort((keys, edges))
            edges, keys = edges[order], keys[order]
            new = np.flatnonzero(np.concatenate(([True], (edges[1:] != edges[:-1]) | (keys[1:] != keys[:-1]))))
            counts = np.diff(np.append(new, len(edges)))
            edges, keys = edges[new], keys[new]
        heads = np.flatnonzero(np.concatenate(([True], edges[1:] != edges[:-1]))).tolist() + [len(edges)]
        keys, counts = keys.tolist(), counts.tolist()
        for lo, hi, edge in zip(heads[:-1], heads[1:], edges[heads[:-1]].tolist()):
            self._insert(self.root, edge, keys[lo:hi], counts[lo:hi], 0)

    def _insert(self, above: Node, edge: int, keys: list[int], counts: list[int], level: int) -> None:
        below = above.get(edge)
        if below is None:
            below = above[edge] = {}
        shift = self.shifts[level]
        if isinstance(below, Node):
            low, start = (1 << shift) - 1, 0
            for i in range(1, len(keys) + 1):  # keys are sorted: runs of one next id
                if i == len(keys) or keys[i] >> shift != keys[start] >> shift:
                    self._insert(below, keys[start] >> shift, [k & low for k in keys[start:i]], counts[start:i], level + 1)
                    start = i
            return
        before, get = len(below), below.get
        for k, n in zip(keys, counts):
            below[k] = get(k, 0) + n
        self.size += len(below) - before
        if len(below) > self.burst and shift:
            node, low = Node(), (1 << shift) - 1
            for k, n in below.items():
                node.setdefault(k >> shift, {})[k & low] = n
            above[edge] = node

    def _entries(self, below, level: int) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(below, Node):
            return np.fromiter(below, np.int64, len(below)), np.fromiter(below.values(), np.int64, len(below))
        keys, counts = [], []
        for edge, deeper in below.items():
            k, n = self._entries(deeper, level + 1)
            keys.append(k | edge << self.shifts[level])
            counts.append(n)
        return np.concatenate(keys), np.concatenate(counts)

    def _weight(self, below) -> int:
        return sum(map(self._weight, below.values())) if isinstance(below, Node) else len(below)

    def spill(self, leave: int):
        """Take out the largest subtrees until ``leave`` entries are left: ``(first, packed, counts)`` of each, sorted."""
        shift = self.shifts[0]
        for edge in sorted(self.root, key=lambda e: -self._weight(self.root[e])):
            if self.size <= leave:
                break
            keys, counts = self._entries(self.root.pop(edge), 0)
            self.size -= len(keys)
            order = np.argsort(keys)
            keys = keys[order]
            yield edge << _HYBRID | keys >> shift, keys & ((1 << shift) - 1), counts[order]


class Counts:
    """The numbered words and the tries (one per length) of one language in one task."""

    def __init__(self, lang: str, lengths: tuple[int, ...], known: Filter | None, burst: int):
        self.lang, self.lengths, self.known, self.burst = lang, lengths, known, burst
        self.tail: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.ids = Ids(self.lang, self.known if self.lengths == (2,) else None)
        self.words: Counter = Counter()  # lengths (1,): one container of words, without numbers
        self.tries = {n: HatTrie(n - 1, self.burst) for n in self.lengths if n > 1}
        self.hashes = np.zeros(1, np.uint64)

    def size(self) -> int:
        return len(self.words) + sum(t.size for t in self.tries.values())

    def add(self, text: bytes, continued: bool = False):
        """Count a text (or the next part of one), yielding what has to be spilled for it."""
        most = max(self.lengths)
        if most == 1:
            self.words.update(tokens(text))
            return
        carried = len(self.tail) if continued else 0
        ws = self.tail + tokens(text) if continued else tokens(text)
        self.tail = ws[max(0, len(ws) - most + 1):]
        for i in range(0, len(ws), _WINDOW):
            if len(self.ids.words) > _IDS:
                yield from self.spill()
            self._count(self.ids.numbers(ws[i:i + _WINDOW + most - 1]), 0 if i else carried)

    def _count(self, ids: np.ndarray, carried: int) -> None:
        """Count the sequences that start in this window, but those within the first ``carried`` words."""
        starts = np.flatnonzero(ids[:_WINDOW])
        padded = np.append(ids, [0] * max(self.lengths))
        pairs = starts[padded[starts + 1] > 0]
        if 2 in self.tries:
            self.tries[2].add(ids[pairs], ids[pairs + 1])
            return
        if len(self.hashes) < len(self.ids.hashes):
            self.hashes = np.array(self.ids.hashes, np.uint64)
        every = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))  # pairs that start beyond the window too
        frequent = np.zeros(len(padded), bool)
        frequent[every] = self.known.has(sequence_hash([self.hashes[ids[every]], self.hashes[ids[every + 1]]]))
        at = pairs[frequent[pairs]]
        for n in self.lengths:
            at = at[frequent[at + n - 2]]
            new = at[at + n > carried]
            packed = np.zeros(len(new), np.int64)
            for k in range(1, n):
                packed = packed << _ID_BITS | ids[new + k]
            self.tries[n].add(ids[new], packed)

    def spill(self, leave: int = 0):
        """Runs ``(part, key, n)`` of the subtrees spilled, until ``leave`` entries are left; a key is ``lang``, a line end, phrase."""
        lead = pa.scalar(self.lang.encode() + b"\n", pa.binary())

        def rows(part, phrase, counts):
            key = pc.binary_join_element_wise(lead, phrase, b"").cast(pa.string())
            part, counts = pa.array((part >> _U(33)).astype(np.int32)), pa.array(counts)
            for i in range(0, len(key), _OUT):
                each = slice(i, i + _OUT)
                yield pa.RecordBatch.from_arrays([part[each], key[each], counts[each]], names=["part", "key", "n"])

        if self.words:
            self.words.pop(_BREAK, None)
            seed = language_seed(self.lang)
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)
            yield from rows(hashes, pa.array(list(self.words), pa.binary()), list(self.words.values()))
            self.words = Counter()
        words, hashes, rank = pa.array(self.ids.words, pa.binary()), np.array(self.ids.hashes, np.uint64), None
        for n, trie in self.tries.items():
            runs = list(trie.spill(leave * trie.size // max(1, self.size())))
            if not runs:
                continue
            if rank is None:  # places of the words in their order
                rank = np.empty(len(words), np.int64)
                rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            first, packed, counts = (np.concatenate(x) for x in zip(*runs))
            path = [first, *(packed >> (_ID_BITS * k) & ((1 << _ID_BITS) - 1) for k in reversed(range(n - 1)))]
            order = np.argsort(rank[path[0]] << _ID_BITS | rank[path[1]])
            path, counts = [x[order] for x in path], counts[order]
            part = mixed(sequence_hash([hashes[x] for x in path[:-1]]) + (hashes[path[-1]] >> _U(58)))
            phrase = words.take(pa.array(path[0]))
            for ids in path[1:]:
                phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(ids)), b" ")
            yield from rows(part, phrase, counts)
        if not leave:
            self._start()


def chunks(text: bytes):
    """A text in parts of about ``_CHUNK`` bytes, cut at blanks or line ends."""
    start = 0
    while len(text) - start > _CHUNK:
        found = [i for i in (text.find(c, start + _CHUNK, start + 2 * _CHUNK) for c in (b" ", b"\n")) if i >= 0]
        cut = min(found) if found else max(text.find(b" ", start + _CHUNK), text.find(b"\n", start + _CHUNK))
        if cut < 0:
            break
        yield text[start:cut + 1]
        start = cut + 1
    yield text[start:]


def count_sequences(lengths: tuple[int, ...], table, entries: int, burst: int):
    """Per-task function over ``(lang, text)``: partial rows of all phrases of these lengths."""
    def run(batches):
        known = Filter(table.value) if table is not None else None
        held: dict[str, Counts] = {}

        def add(lang, text, continued=False):
            mine = held.setdefault(lang, Counts(lang, lengths, known, burst))
            yield from mine.add(text, continued)
            while sum(c.size() for c in held.values()) > entries:
                most = max(held.values(), key=Counts.size)
                yield from most.spill(most.size() // 2)

        waiting: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if len(raw) > _CHUNK:
                    for i, part in enumerate(chunks(raw)):
                        yield from add(lang, part, i > 0)
                    continue
                waiting.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= _CHUNK:
                    for x, texts in waiting.items():
                        yield from add(x, b"\n".join(texts))
                    waiting, size = {}, 0
        for x, texts in waiting.items():
            yield from add(x, b"\n".join(texts))
        for mine in held.values():
            yield from mine.spill()

    return run


def filter_table(frequent: DataFrame, n: int, bits: int) -> np.ndarray:
    """Bit table of the hashes of frequent phrases of ``n`` words; at most ``2 ** bits / 64`` rows reach the driver."""
    shift = 64 - bits

    def slots(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = language_seed(lang)
                hashes += [xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")]
            each = np.array(hashes, np.uint64).reshape(-1, n)
            slot = sequence_hash([each[:, k] for k in range(n)]) >> _U(shift)
            word, one = slot >> _U(6), _U(1) << (slot & _U(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(one.view(np.int64))], names=["word", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(slots, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def frequent_phrases(docs: DataFrame, min_count: int = 30, entries: int = 1 << 20, burst: int = 1 << 13,
                     filter_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, a)`` of all phrases of up to four words that occur ``min_count`` times, and ``(lang, n)``: words per language.

    ``docs`` has columns lang (not null) and text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    found, table, totals = [], None, None
    for lengths in STEPS:
        runs = docs.select("lang", "text").mapInArrow(
            count_sequences(lengths, table, entries, burst), "part int, key string, n long")
        merged = runs.repartition("part").groupBy("part", "key").agg(F.sum("n").alias("a"))
        lang = F.regexp_extract("key", r"(?s)^(.*)\n", 1)  # a phrase has no line end
        phrase = F.substring_index("key", "\n", -1)
        gaps = F.octet_length("phrase") - F.octet_length(F.replace("phrase", F.lit(" "), F.lit("")))
        merged = merged.select(lang.alias("lang"), phrase.alias("phrase"), "a").select("lang", "phrase", (gaps + 1).alias("words"), "a")
        if lengths == (1,):
            every = materialize(merged, "phrase-words")
            totals = materialize(every.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-totals")
            merged = every
        found.append(materialize(merged.filter(F.col("a") >= min_count), f"phrases-{lengths[0]}"))
        if lengths != STEPS[-1]:
            table = spark.sparkContext.broadcast(filter_table(found[-1], lengths[0], filter_bits))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union, totals


def cut_scores(phrases: DataFrame) -> DataFrame:
    """Candidates (two words and more) with their least cut: ``(lang, phrase, words, a, l, r, score)``."""
    parts = phrases.select("lang", "phrase", "a")
    cuts = phrases.filter("words > 1").select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    side = lambda name, count: parts.select(F.col("lang"), F.col("phrase").alias(name), F.col("a").alias(count))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    # whole-number division of decimals: exact beyond 64 bits
    score = F.expr("(cast(2000000 as decimal(8, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    both = both.select("lang", "phrase", "words", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    return both.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut")).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outside_longer(candidates: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates not inside a longer one that has ``percent`` of their count.

    One word more is enough to look at: a phrase between the two is at least as frequent
    as the longer, so it is a candidate too.
    """
    longer = phrases.filter("words > 2").select(
        "lang", "a", F.explode(F.expr("array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))")).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    covered = F.col("within").isNotNull() & (100 * F.col("within") >= F.lit(percent) * F.col("a"))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~covered).drop("within")


def mine(docs: DataFrame, min_count: int = 30, top: int = 2000, percent: int = 80, salts: int = 64, **counting) -> DataFrame:
    """The ``top`` collocations of each language: ``(lang, rank, phrase, a, l, r, n, score)``."""
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    phrases, totals = frequent_phrases(d, min_count, **counting)
    scored = outside_longer(cut_scores(phrases), phrases, percent)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within salted parts of a language, so that no task ranks all of its candidates
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    best = scored.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
