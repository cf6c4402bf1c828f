"""Language ID by unigram piece probabilities, summed over all segmentations.

Every language has its own probabilities for the pieces of one fixed public vocabulary. A
word's probability in a language is the sum, over all its segmentations into pieces, of the
products of their probabilities: a forward pass over the word's lattice. A text's
probability is the product over its words, and the language of highest probability (with
the languages' shares as prior) is predicted.

The piece probabilities are learned by expectation maximisation: the expected number of
uses of each piece over all segmentations (forward and backward pass), summed over the
distinct words of a language with their counts. Word counts are combined in each task,
then by a shuffle; lattices are built once per distinct word of a batch, all words of one length in
the same array operations (:class:`Grid`; in logarithms, :class:`Lattice`, for long words, for
characters outside the vocabulary, and where a product would underflow). What reaches the driver and the tasks is one number per piece and
language, whatever the size of the corpus.

Characters outside the vocabulary are spelled by the vocabulary's byte pieces.

Results for odd input: a null text, or one without a letter, is ``und`` with score 0; a text
of letters never seen still gets a language (of equal ones the first by code points); a
null id counts as training; null languages are not learned; repeated rows are learned
and predicted each; a word of more than ``_WORD`` characters is taken as words of that many
(so its cost is in proportion to its length); without training rows every text is
``und``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.segment import MODEL, SPACE, Vocabulary as _Model
from docket.session import ship_package
from docket.sinks.tables import materialize

UNKNOWN = "und"
_WORD = 256  # characters of a word that are scored together
_CELLS = 1 << 21  # numbers (lattice nodes x languages) worked on at once
_TOGETHER = 1 << 17  # words whose lattices are built together
_TEXT = 1 << 22  # bytes of text worked on at once
_GRID = 33  # characters of a word, with its blank, up to which its lattice is a table
_LEAST = 1e-280  # of a probability not in logarithms
_FLUSH = 1 << 19  # words held before partial counts are sent on


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class Pieces:
    """The vocabulary as a trie over characters."""

    def __init__(self, pieces: list[str], kinds: list[str]):
        normal = [i for i, k in enumerate(kinds) if k == "normal" and pieces[i]]
        self.size = len(pieces)
        self.byte = np.zeros(256, np.int64)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte[int(pieces[i][1:-1], 16)] = i
        single = sorted(pieces[i] for i in normal if len(pieces[i]) == 1)
        number = {c: j + 1 for j, c in enumerate(single)}
        self.char = np.zeros(0x110000, np.int32)  # 0: spelled by bytes
        for c, j in number.items():
            self.char[ord(c)] = j
        edges, ends = {}, {}
        for i in normal:
            if all(c in number for c in pieces[i]):
                node = 0
                for c in pieces[i]:
                    node = edges.setdefault((node, number[c]), len(edges) + 1)
                ends[node] = i
        self.width = len(number) + 1
        keys = np.array([node * self.width + j for node, j in edges], np.int64)
        # open addressing: a key stands in its slot or one of the few after it
        self.bits = max(4, 2 * len(keys)).bit_length() + 1
        self.keys, self.child, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        waiting, children = keys, np.array(list(edges.values()), np.int64)
        while len(waiting):
            at = self._slot(waiting, self.probes)
            free = np.flatnonzero(self.keys[at] < 0)
            taken, one = np.unique(at[free], return_index=True)
            self.keys[taken], self.child[taken] = waiting[free[one]], children[free[one]]
            left = self.keys[at] != waiting
            waiting, children, self.probes = waiting[left], children[left], self.probes + 1
        self.roots = np.zeros(self.width, np.int64)
        for (node, j), child in edges.items():
            if not node:
                self.roots[j] = child
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        for node, i in ends.items():
            self.piece[node] = i

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Children of trie nodes (0: none)."""
        keys = nodes * self.width + chars
        at = self._slot(keys, 0)
        out = np.where(self.keys[at] == keys, self.child[at], 0)
        open_ = np.flatnonzero((out == 0) & (self.keys[at] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], probe)
            found = self.keys[at] == keys[open_]
            out[open_[found]] = self.child[at[found]]
            open_ = open_[~found & (self.keys[at] >= 0)]
        return out


class Lattice:
    """The lattices of some words, each as a row of nodes between its characters (a word starts with a blank)."""

    def __init__(self, v: Pieces, words: list[str]):
        self.v = v
        codes = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in its word
        left = sizes[word] - at
        node = np.arange(len(codes)) + word  # a word has one node more than characters
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        self.n_nodes = len(codes) + len(words)
        chars = v.char[codes].astype(np.int64)

        other = np.flatnonzero(chars == 0)
        self.spelled, kind = np.unique(codes[other], return_inverse=True)
        found = [(other, v.size + kind, 1)]
        live = np.flatnonzero(chars)
        tries = np.zeros(len(live), np.int64)
        length = 0
        while len(live):
            length += 1
            tries = v.step(tries, chars[live + length - 1])
            live, tries = live[tries > 0], tries[tries > 0]
            ends = v.piece[tries] >= 0
            found.append((live[ends], v.piece[tries[ends]], length))
            more = left[live] > length
            live, tries = live[more], tries[more]
        start = np.concatenate([s for s, _, _ in found])
        steps = np.concatenate([np.full(len(s), k) for s, _, k in found])
        piece = np.concatenate([p for _, p, _ in found])
        self.word, self.piece = word[start], piece
        self.start, self.end = node[start], node[start] + steps
        self.from_at, self.to_at = at[start], at[start] + steps

    def logs(self, log_p: np.ndarray) -> np.ndarray:
        """``log_p`` (pieces, languages) with a row for each character spelled by bytes."""
        if not len(self.spelled):
            return log_p
        more = [log_p[self.v.byte[list(chr(c).encode("utf-8", "surrogatepass"))]].sum(0) for c in self.spelled]
        return np.concatenate((log_p, np.array(more)))

    def _sweep(self, weights: np.ndarray, at: np.ndarray, into: np.ndarray, out_of: np.ndarray, back: bool) -> np.ndarray:
        """Log-sums into every node from the nodes before it, all words one step at a time."""
        total = np.zeros((self.n_nodes, weights.shape[1]))
        order = np.lexsort((into, at))
        bounds = np.searchsorted(at[order], np.arange(at.max(initial=0) + 2))
        steps = [(a, b) for a, b in zip(bounds[:-1], bounds[1:]) if a < b]
        for a, b in reversed(steps) if back else steps:
            edges = order[a:b]
            values = total[out_of[edges]] + weights[self.piece[edges]]
            target = into[edges]
            heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            most = np.maximum.reduceat(values, heads)
            spread = np.repeat(most, np.diff(np.append(heads, len(edges))), axis=0)
            total[target[heads]] = most + np.log(np.add.reduceat(np.exp(values - spread), heads))
        return total

    def forward(self, weights: np.ndarray) -> np.ndarray:
        return self._sweep(weights, self.to_at, self.end, self.start, False)

    def word_logs(self, log_p: np.ndarray) -> np.ndarray:
        """ln of each word's probability in each language."""
        return self.forward(self.logs(log_p))[self.last]

    def expected(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``counts`` times (one language)."""
        weights = self.logs(log_p[:, None])
        ahead = self.forward(weights)[:, 0]
        behind = self._sweep(weights, self.from_at, self.start, self.end, True)[:, 0]
        share = np.exp(ahead[self.start] + weights[self.piece, 0] + behind[self.end] - ahead[self.last][self.word])
        uses = np.bincount(self.piece, share * counts[self.word], self.v.size + len(self.spelled))
        out = uses[:self.v.size]
        for c, n in zip(self.spelled, uses[self.v.size:]):
            np.add.at(out, self.v.byte[list(chr(c).encode("utf-8", "surrogatepass"))], n)
        return out


class Grid:
    """The lattices of words of one length in characters of the vocabulary: for each start and
    end, the words with a piece there and its number."""

    def __init__(self, v: Pieces, chars: np.ndarray):
        self.n, self.size = chars.shape
        columns = np.ascontiguousarray(chars.T)
        self.pieces: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for start in range(self.size):
            words, nodes, found = np.arange(self.n), v.roots[columns[start]], []
            for end in range(start + 1, self.size + 1):
                if end > start + 1:
                    nodes = v.step(nodes, columns[end - 1][words])
                    on = np.flatnonzero(nodes)
                    words, nodes = words[on], nodes[on]
                if not len(words):
                    break
                here = v.piece[nodes]
                at = np.flatnonzero(here >= 0)
                if len(at):
                    found.append((end, words[at], here[at]))
            self.pieces.append(found)

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """Sums over the ways to each place, from ``p`` (pieces, languages)."""
        ways = [np.ones((self.n, p.shape[1]))] + [np.zeros((self.n, p.shape[1])) for _ in range(self.size)]
        for start, found in enumerate(self.pieces):
            for end, words, here in found:
                if len(words) == self.n:
                    ways[end] += ways[start] * p[here]
                else:
                    ways[end][words] += ways[start][words] * p[here]
        return ways

    def expected(self, p: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of the pieces in one language (of words that do not underflow), and those words."""
        ways = [x[:, 0] for x in self.forward(p[:, None])]
        fine = ways[-1] > _LEAST
        scale = np.where(fine, counts, 0) / np.where(fine, ways[-1], 1)
        rest = [np.zeros(self.n) for _ in range(self.size)] + [np.ones(self.n)]
        used, shares = [], []
        for start in reversed(range(self.size)):
            for end, words, here in self.pieces[start]:
                onward = p[here] * rest[end][words]
                rest[start][words] += onward
                used.append(here)
                shares.append(ways[start][words] * onward * scale[words])
        return np.bincount(np.concatenate(used), np.concatenate(shares), size), fine


def by_length(v: Pieces, words: list[str]):
    """``(places, chars)`` of the words of each length; chars null for words that a grid cannot hold."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    chars = v.char[np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    plain = (np.minimum.reduceat(chars, first) > 0) & (sizes <= _GRID) if len(words) else np.zeros(0, bool)
    for size in np.unique(sizes[plain]).tolist():
        at = np.flatnonzero(plain & (sizes == size))
        yield at, chars[first[at][:, None] + np.arange(size)]
    if not plain.all():
        yield np.flatnonzero(~plain), None


def word_logs(v: Pieces, words: list[str], log_p: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of each word's probability in each language; ``p`` is exp(log_p)."""
    out = np.zeros((len(words), log_p.shape[1]))
    slow = []
    for at, chars in by_length(v, words):
        if chars is None:
            slow.append(at)
            continue
        sums = Grid(v, chars).forward(p)[-1]
        fine = (sums > _LEAST).all(1)
        out[at[fine]] = np.log(sums[fine])
        slow.append(at[~fine])
    rest = np.concatenate(slow) if slow else np.zeros(0, np.int64)
    for part in groups([words[i] for i in rest], log_p.shape[1]):
        out[rest[part]] = Lattice(v, [words[i] for i in rest[part]]).word_logs(log_p)
    return out


def expected_uses(v: Pieces, words: list[str], counts: np.ndarray, log_p: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur ``counts`` times, in one language."""
    uses, slow = np.zeros(v.size), []
    for at, chars in by_length(v, words):
        if chars is None:
            slow.append(at)
            continue
        found, fine = Grid(v, chars).expected(p, counts[at], v.size)
        uses += found
        slow.append(at[~fine])
    rest = np.concatenate(slow) if slow else np.zeros(0, np.int64)
    for part in groups([words[i] for i in rest], 1):
        uses += Lattice(v, [words[i] for i in rest[part]]).expected(log_p, counts[rest[part]])
    return uses


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts (a null is empty; a word of more than ``_WORD`` characters is several),
    and the number of words of each text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    sizes = pc.utf8_length(flat).to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if len(sizes) and sizes.max() > _WORD:
        parts = [[w[i:i + _WORD] for i in range(0, len(w), _WORD)] for w in flat.to_pylist()]
        text = np.repeat(text, [len(p) for p in parts])
        flat = pa.array([x for p in parts for x in p], pa.string())
    else:
        flat, text = flat.filter(pa.array(sizes > 0)), text[sizes > 0]
    return flat, np.bincount(text, minlength=len(texts))


def groups(words: list[str], languages: int):
    """Runs of words whose lattices fit the bound (their places)."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += (len(w) + 2) * max(1, languages)
        if held >= _CELLS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def count_words(batches):
    """Partial rows ``(lang, word, n)``; ``word`` null counts documents."""
    words, docs = {}, Counter()

    def rows(lang, found):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()),
                                           pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        langs = batch.column(0)
        docs.update(langs.to_pylist())
        for lang in pc.unique(langs).to_pylist():
            mine = batch.column(1).filter(pc.equal(langs, lang))
            for part in runs_of(mine):
                found = text_words(part)[0].value_counts()
                held = words.setdefault(lang, Counter())
                for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                    held[w] += n
                if sum(map(len, words.values())) >= _FLUSH:
                    yield from itertools.starmap(rows, words.items())
                    words = {}
    yield from itertools.starmap(rows, words.items())
    yield from (rows(lang, {None: n}) for lang, n in docs.items())


def runs_of(texts: pa.Array):
    """Runs of texts of some megabytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > _TEXT:
            yield texts[start:i]
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield texts[start:]


_PIECES: dict[str, Pieces] = {}


def built(model: tuple) -> Pieces:
    """The trie of a vocabulary, made once per Python worker."""
    key = xxhash.xxh64_hexdigest("\0".join(itertools.chain(*model)).encode("utf-8", "surrogatepass"))
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(*model)
    return _PIECES[key]


def expectation(model, log_p, langs: list[str]):
    """Per-task sums ``(lang, piece, uses)`` over rows ``(lang, word, n)``."""
    def run(batches):
        v, logs = built(model.value), log_p.value
        total = np.zeros((len(langs), v.size))
        place = {lang: i for i, lang in enumerate(langs)}
        held: dict[str, tuple[list, list]] = {}

        def settle():
            for lang, (ws, ns) in held.items():
                mine = np.ascontiguousarray(logs[:, place[lang]])
                total[place[lang]] += expected_uses(v, ws, np.array(ns, np.float64), mine, np.exp(mine))
            held.clear()

        for batch in batches:
            for lang, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                mine = held.setdefault(lang, ([], []))
                mine[0].append(w)
                mine[1].append(n)
            if sum(len(ws) for ws, _ in held.values()) >= _TOGETHER:
                settle()
        settle()
        row, piece = np.nonzero(total)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(piece), pa.array(total[row, piece])],
                                             names=["lang_no", "piece", "uses"])

    return run


class Model:
    """Languages in code point order, ln of their shares, and ln of their piece probabilities."""

    def __init__(self, langs: list[str], log_prior: np.ndarray, log_p: np.ndarray):
        self.langs, self.log_prior, self.log_p = langs, log_prior, log_p


def learn(docs: DataFrame, vocabulary: str = MODEL, rounds: int = 2, smoothing: float = 50.0) -> tuple[Model, tuple]:
    """The model from training rows ``(lang, text)``, and the vocabulary that it speaks of.

    ``rounds`` of expectation maximisation from even probabilities; a language's pieces are
    smoothed by ``smoothing`` uses at the rates of all languages together.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces, kinds, _ = _Model.read(vocabulary)
    partial = materialize(docs.filter("lang is not null").select("lang", "text").mapInArrow(
        count_words, "lang string, word string, n long"), "langid-partial")
    shares = dict(partial.filter("word is null").groupBy("lang").agg(F.sum("n")).collect())
    langs = sorted(shares)
    size = len(pieces)
    n_docs = np.array([shares[x] for x in langs], np.float64)
    words = materialize(partial.filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    model = spark.sparkContext.broadcast((tuple(pieces), tuple(kinds)))
    log_p = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(log_p)
        sums = words.mapInArrow(expectation(model, shared, langs), "lang_no long, piece long, uses double")
        found = sums.groupBy("lang_no", "piece").agg(F.sum("uses").alias("uses")).toArrow()  # one number per piece and language
        uses = np.zeros((size, len(langs)))
        uses[found["piece"].to_numpy(), found["lang_no"].to_numpy()] = found["uses"].to_numpy()
        rate = (uses.sum(1) + 1) / (uses.sum() + size)
        log_p = np.log((uses + smoothing * rate[:, None]) / (uses.sum(0) + smoothing))
    return Model(langs, np.log(n_docs / n_docs.sum()) if langs else n_docs, log_p), (tuple(pieces), tuple(kinds))


def posteriors(v: Pieces, model: Model, p: np.ndarray, texts: pa.Array) -> np.ndarray:
    """P(language | text) of each text; ``p`` is exp of the model's logarithms."""
    flat, sizes = text_words(texts)
    coded = flat.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    table = np.concatenate([word_logs(v, words[i:i + _TOGETHER], model.log_p, p) for i in range(0, len(words), _TOGETHER)] or
                           [np.zeros((0, len(model.langs)))])
    logs = np.tile(model.log_prior, (len(texts), 1))
    some = np.flatnonzero(sizes)
    if len(some):
        logs[some] += np.add.reduceat(table[at], (np.cumsum(sizes) - sizes)[some])
    logs -= logs.max(1, keepdims=True)
    shares = np.exp(logs)
    return shares / shares.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, vocabulary: tuple, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, lang_pred, score)`` of every row; only ``text`` is looked at."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model, vocabulary))

    def run(batches):
        model, vocabulary = shared.value
        v, p, langs = built(vocabulary), np.exp(model.log_p), np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            done = 0
            for texts in runs_of(batch.column(0)):
                told = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                best, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
                if model.langs and told.any():
                    shares = posteriors(v, model, p, texts.filter(pa.array(told)))
                    best[told], score[told] = shares.argmax(1), shares.max(1)
                rows = slice(done, done + len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*[c[rows] for c in batch.columns[1:]], pa.array(langs[best], pa.string()),
                                                  pa.array(score)], names=[*keep, "lang_pred", "score"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col("text").cast("string").alias("text"), *keep).mapInArrow(
        run, kept + "lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str = MODEL, rounds: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from the rows not held out, predicted for all."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                    F.col("text").cast("string").alias("text"))
    model, pieces = learn(d.filter(~held_out(F.col("doc_id"))), vocabulary, rounds)
    return predict(d, model, pieces, keep=("doc_id",)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
