"""SentencePiece encoding and decoding with distinct sampled segmentations.

All segmentations of a text into vocabulary pieces form a lattice. A segmentation's
probability is the product of its pieces' (Zipf by vocabulary rank, flattened by the power
``alpha``, normalised over the lattice by a backward pass). Gumbel top-k draws ``k`` of them without replacement: the
best of Gumbel-perturbed log-probabilities, found by a perturbed A-star search that
splits regions of the lattice. A region is a path prefix and the edges already used at
its end; its exact bound is the Gumbel maximum of its probability mass, truncated by its
parent's. Popping the best region completes it by ancestral sampling and splits off one
region per edge of the new path, so no more than ``k`` paths are ever expanded. The best
region left gives the threshold for the inclusion scores.

The text is cut where no vocabulary piece crosses; equal units of a batch share one
lattice, and all passes run as array operations over the batch. Draws are hashes of (seed,
row key, sample, position), so results do not depend on partitions, batches or retries.

Characters outside the vocabulary (a literal U+2581 among them) become byte pieces, so
decoding gives back every text exactly.

Results for odd input: a null or empty text has one segmentation, without pieces; a text
with fewer than ``k`` segmentations gives them all (log inclusion 0); a null key counts as
0; rows with equal keys draw alike; an empty table gives an empty table; columns named in
``keep`` are carried along, others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BATCH = 3 << 17  # characters (or ids) worked on at once
_SHORT = 200  # characters of a unit up to which plain sums stay in range
_BYTES = -2  # in place of a piece: the character's UTF-8 bytes
_NONE = -1e30
_U = np.uint64


def piece_bytes(pieces: list[str], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece's bytes start, how many they are, and all of them together."""
    raw = [b""] * len(pieces)
    for i, k in enumerate(kinds):
        if k == "normal":
            raw[i] = pieces[i].replace(SPACE, " ").encode()
        elif k == "byte":
            raw[i] = bytes([int(pieces[i][1:-1], 16)])
    sizes = np.array([len(r) for r in raw], np.int64)
    return np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, np.frombuffer(b"".join(raw), np.uint8)


class Vocabulary:
    """Pieces of a SentencePiece model as arrays: trie, cuts, log-probabilities, bytes."""

    def __init__(self, pieces: list[str], kinds: list[str], scores: list[float], alpha: float = 0.3,
                 offset: float = 10.0):
        self.normal = [i for i, k in enumerate(kinds) if k == "normal" and pieces[i]]
        self.byte_id = np.zeros(256, np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        order = sorted(self.normal, key=lambda i: (-scores[i], i))
        weights = 1 / (np.arange(len(order)) + offset)
        self.log_p = np.full(len(pieces), _NONE)
        self.log_p[order] = alpha * np.log(weights / weights.sum())
        self.longest = max((len(pieces[i]) for i in self.normal), default=1)

        chars = sorted({c for i in self.normal for c in pieces[i]})
        self.n_chars = n = len(chars) + 1
        number = {c: j + 1 for j, c in enumerate(chars)}
        self.char = np.zeros(0x110000, np.uint16)
        for c, j in number.items():
            if c != SPACE:
                self.char[ord(c)] = j
        self.char[ord(" ")] = number.get(SPACE, 0)  # blanks are written as U+2581, which itself goes by bytes
        self.char[ord(SPACE)] = 0

        joins = np.zeros((n, n), bool)
        edges, terminal = {}, {}
        for i in self.normal:
            node, before = 0, 0
            for c in pieces[i]:
                j = number[c]
                if before:
                    joins[before, j] = True
                before = j
                node = edges.setdefault((node, j), len(edges) + 1)
            terminal[node] = i
        self.joins = joins
        self.first = np.zeros(n, np.int32)
        self.second = np.zeros((n, n), np.int32)
        deeper = []
        depth_one = {}
        for (node, j), child in edges.items():
            if node == 0:
                self.first[j] = child
                depth_one[child] = j
        for (node, j), child in edges.items():
            if node in depth_one:
                self.second[depth_one[node], j] = child
            elif node:
                deeper.append((node * n + j, child))
        deeper.sort()
        self.keys = np.array([k for k, _ in deeper] or [-1], np.int64)
        self.children = np.array([c for _, c in deeper] or [0], np.int32)
        self.piece = np.full(len(edges) + 1, -1, np.int32)
        for node, i in terminal.items():
            self.piece[node] = i

        self.raw_at, self.raw_len, self.raw = piece_bytes(pieces, kinds)

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = 0.3) -> "Vocabulary":
        return cls(*cls.read(path), alpha)

    @staticmethod
    def read(path: str) -> tuple[list[str], list[str], list[float]]:
        """Pieces, kinds and scores of a model file: all that tasks need to build the tables."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kind = lambda i: ("byte" if sp.is_byte(i) else
                          "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal")
        return [sp.id_to_piece(i) for i in ids], [kind(i) for i in ids], [sp.get_score(i) for i in ids]

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Trie children of nodes at depth two or more (0: none)."""
        keys = nodes.astype(np.int64) * self.n_chars + chars
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.children[at], 0)


_BUILT: dict[str, Vocabulary] = {}


def built(shared, key: str) -> Vocabulary:
    """The vocabulary of a broadcast model, its tables built once per Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Vocabulary(*shared.value)
    return _BUILT[key]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of counters into independent-looking bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def draws(seeds: np.ndarray, sample: int, stream: int, position: np.ndarray) -> np.ndarray:
    return scrambled(seeds + _U((sample * 4 + stream + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                     + position.astype(np.uint64) * _U(0xD1342543DE82EF95))


def uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated_gumbel(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of a region of given mass, known to be below ``bound``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = log_mass - np.log(np.exp(log_mass - bound) - np.log(u))
    return np.where(np.isneginf(log_mass), -np.inf, g)


class Lattices:
    """The lattices of all distinct units of a batch, and where each character stands in them."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, doc_starts: np.ndarray):
        self.v, n = v, len(codes)
        ids = v.char[codes]
        cut = np.ones(n, bool)
        cut[1:] = ~v.joins[ids[:-1], ids[1:]]
        cut[doc_starts] = True
        self.starts = starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, n))
        offset = np.arange(n) - np.repeat(starts, lengths)
        most = int(lengths.max())
        power = np.ones(most, np.uint64)
        np.multiply.accumulate(np.full(most - 1, 0x5851F42D4C957F2D, np.uint64), out=power[1:])
        letters = scrambled((ids.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        hashes = scrambled(np.add.reduceat(letters * power[offset], starts))
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        size = lengths[first]
        # one slot per character and one for the end of each distinct unit
        slot_start = np.concatenate(([0], np.cumsum(size + 1)))
        self.n_slots = s = int(slot_start[-1])
        slot_unit = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        self.left = np.repeat((slot_start[1:] - 1).astype(np.int32), size + 1) - np.arange(s, dtype=np.int32)
        inside = np.flatnonzero(self.left)
        chars = np.zeros(s + 1, np.uint16)
        chars[inside] = ids[(starts[first] - slot_start[:-1])[slot_unit[inside]] + inside]
        self.slot = np.repeat((slot_start[kind] - starts).astype(np.int32), lengths) + np.arange(n, dtype=np.int32)
        self._edges(chars, inside)
        self._backward(size[slot_unit])

    def _edges(self, chars: np.ndarray, live: np.ndarray) -> None:
        """Edges by slot, shortest first: ``length``, ``piece`` and a weight at ``start[slot] + rank``."""
        v = self.v
        other = live[chars[live] == 0]
        found = [(other, np.full(len(other), _BYTES, np.int32), 1)]
        live = live[chars[live] != 0]
        nodes = v.first[chars[live]]
        for length in range(1, v.longest + 1):
            if length == 2:
                nodes = v.second[chars[live], chars[live + 1]]
            elif length > 2:
                nodes = v.step(nodes, chars[live + length - 1])
            keep = np.flatnonzero(nodes)
            live, nodes = live[keep], nodes[keep]
            pieces = v.piece[nodes]
            ends = np.flatnonzero(pieces >= 0)
            found.append((live[ends], pieces[ends], length))
            more = np.flatnonzero(self.left[live] > length)
            live, nodes = live[more], nodes[more]
            if not len(live):
                break
        self.degree = np.zeros(self.n_slots, np.int8)
        for slots, _, _ in found:
            self.degree[slots] += 1
        self.start = np.concatenate(([0], np.cumsum(self.degree, dtype=np.int64))).astype(np.int32)
        n = int(self.start[-1])
        self.length, self.piece, rank = np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(self.n_slots, np.int8)
        for slots, pieces, length in found:
            at = self.start[slots] + rank[slots]
            rank[slots] += 1
            self.length[at], self.piece[at] = length, pieces

    def _backward(self, unit_size: np.ndarray) -> None:
        """Conditional probability ``p`` of each edge at its slot, from the weight of all ways on.

        Weights are scaled by a constant per character, which cancels; that keeps sums in
        range up to ``_SHORT`` characters. Longer units are summed as logarithms.
        """
        log_w = np.where(self.piece == _BYTES, 0.0, self.v.log_p[np.maximum(self.piece, 0)]) + self.length
        self.p = np.exp(log_w)
        beta = np.ones(self.n_slots + 1)
        for short in (True, False):
            of = np.flatnonzero((self.left > 0) & ((unit_size <= _SHORT) == short))
            if not len(of):
                continue
            if not short:
                beta = np.zeros(self.n_slots + 1)  # logarithms from here on
            left = self.left[of]
            order = of[np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")]
            bounds = np.searchsorted(self.left[order], np.arange(int(left.max()) + 2))
            for level in range(1, len(bounds) - 1):
                slots = order[bounds[level]:bounds[level + 1]]
                total = np.full(len(slots), 0.0 if short else -np.inf)
                rows, r = np.arange(len(slots)), 0
                while len(rows):
                    edge = self.start[slots[rows]] + r
                    onward = beta[slots[rows] + self.length[edge]]
                    if short:
                        self.p[edge] *= onward
                        total[rows] += self.p[edge]
                    else:
                        self.p[edge] = log_w[edge] + onward
                        total[rows] = np.logaddexp(total[rows], self.p[edge])
                    r += 1
                    rows = rows[self.degree[slots[rows]] > r]
                beta[slots] = total
            edges = np.flatnonzero(np.repeat((self.left > 0) & ((unit_size <= _SHORT) == short), self.degree))
            owner = np.repeat(np.arange(self.n_slots), self.degree)[edges]
            self.p[edges] = self.p[edges] / beta[owner] if short else np.exp(self.p[edges] - beta[owner])
        np.minimum(self.p, 1.0, out=self.p)
        self.p[self.start[:-1][self.degree == 1]] = 1.0
        # draws at or above an edge's limit go on to the next edge; the last takes the rest
        self.limit, rows = np.zeros(len(self.p)), np.flatnonzero(self.degree)
        upto, r = np.zeros(self.n_slots), 0
        while len(rows):
            edge = self.start[rows] + r
            upto[rows] += self.p[edge]
            self.limit[edge] = upto[rows]
            r += 1
            last = self.degree[rows] == r
            self.limit[edge[last]] = 2.0
            rows = rows[~last]


class Search:
    """Gumbel top-k over the texts of one batch. A path is the edge taken at each character
    where one of its pieces starts (else -1)."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: np.ndarray, seed: int):
        self.v, self.sizes = v, np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.docs = np.flatnonzero(self.sizes)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes[self.docs])))[:-1]
        self.seeds = scrambled(keys.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))[self.docs]
        n = len(self.codes)
        self.doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.sizes[self.docs])
        self.place = np.arange(n, dtype=np.int32) - np.repeat(self.begin.astype(np.int32), self.sizes[self.docs])
        self.lattice = Lattices(v, self.codes, self.begin) if n else None
        self.paths, self.regions, self.used, self.logs = [], [], [], []

    def walk(self, sample: int, at: np.ndarray, path: np.ndarray) -> None:
        """Ancestral sampling from the given characters to the ends of their units."""
        la = self.lattice
        while len(at):
            slots = la.slot[at]
            edge = la.start[slots]
            many = np.flatnonzero(la.degree[slots] > 1)
            u = uniform(draws(self.seeds[self.doc[at[many]]], sample, 0, self.place[at[many]]))
            while len(many):
                on = np.flatnonzero(la.limit[edge[many]] <= u)
                many, u = many[on], u[on]
                edge[many] += 1
            path[at] = edge
            took = la.length[edge]
            more = np.flatnonzero(la.left[slots] > took)
            at = at[more] + took[more]

    def by_text(self, at: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(at, self.begin), len(at))

    def add(self, sample: int, path: np.ndarray, bound: np.ndarray, after: np.ndarray, live: np.ndarray) -> None:
        """Keep a path and split off its regions: at each piece that starts after ``after``, the other edges."""
        at = np.flatnonzero(path >= 0)
        p = self.lattice.p[path[at]]
        logs, before = np.log(p), np.zeros(len(at))
        bounds = self.by_text(at)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # text by text: sums must not depend on the batch
            if b - a > 1:
                np.cumsum(logs[a:b - 1], out=before[a + 1:b])
        total = np.zeros(len(self.docs))
        some = bounds[1:] > bounds[:-1]
        total[some] = before[bounds[1:][some] - 1] + logs[bounds[1:][some] - 1]
        region = np.full(len(path), -np.inf)
        d = self.doc[at]
        open_ = np.flatnonzero(live[d] & (at > after[d]) & (p < 1))
        where, d = at[open_], d[open_]
        u = uniform(draws(self.seeds[d], sample, 1, self.place[where]))
        region[where] = truncated_gumbel(before[open_] + np.log1p(-p[open_]), bound[d], u)
        used = np.zeros(len(path), np.int32)
        used[at] = 1 << (path[at] - self.lattice.start[self.lattice.slot[at]])
        self.paths.append(path)
        self.regions.append(region)
        self.used.append(used)
        self.logs.append((at, before, total))

    def run(self, k: int):
        """``(path, log_prob, log_inclusion, live)`` per rank over the non-empty texts."""
        n_docs = len(self.docs)
        everywhere = np.ones(n_docs, bool)
        path = np.full(len(self.codes), -1, np.int32)
        self.walk(0, self.lattice.starts, path)
        root = -np.log(-np.log(uniform(draws(self.seeds, 0, 2, np.zeros(n_docs, np.int64)))))
        self.add(0, path, root, np.full(n_docs, -1), everywhere)
        lives = [everywhere]
        for sample in range(1, k):
            lives.append(self._pop(sample))
        threshold = np.stack([np.maximum.reduceat(r, self.begin) for r in self.regions]).max(axis=0)
        out = []
        for path, (_, _, total), live in zip(self.paths, self.logs, lives):
            with np.errstate(over="ignore", divide="ignore"):
                x = total - threshold
                inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
            out.append((path, total, np.where(np.isneginf(threshold), 0.0, inclusion), live))
        return out

    def _pop(self, sample: int) -> np.ndarray:
        """Take each text's best region, complete it to a new path, split what is left."""
        la, n_docs = self.lattice, len(self.docs)
        tops = np.stack([np.maximum.reduceat(r, self.begin) for r in self.regions])
        source, best = tops.argmax(axis=0), tops.max(axis=0)
        live = ~np.isneginf(best)
        path, after = np.full(len(self.codes), -1, np.int32), np.full(n_docs, len(self.codes))
        for s, (region, used) in enumerate(zip(self.regions, self.used)):
            chosen = live & (source == s)
            if not chosen.any():
                continue
            hit = np.flatnonzero((region == np.where(chosen, best, np.nan)[self.doc]))
            d, where = np.unique(self.doc[hit], return_index=True)
            at = hit[where]
            after[d] = at
            # an edge that the region still has, in proportion to its probability
            slots, rank = la.slot[at], np.arange(self.v.longest)
            edges = np.minimum(la.start[slots][:, None] + rank, len(la.p) - 1)
            has = (rank < la.degree[slots][:, None]) & ((used[at, None] >> rank & 1) == 0)
            p = np.where(has, la.p[edges], 0.0)
            upto = np.cumsum(p, axis=1)
            u = uniform(draws(self.seeds[d], sample, 3, self.place[at])) * upto[:, -1]
            edge = np.minimum((upto <= u[:, None]).sum(axis=1), p.shape[1] - 1)
            on_prefix = np.flatnonzero(chosen[self.doc] & (np.arange(len(path)) < after[self.doc]))
            path[on_prefix] = self.paths[s][on_prefix]
            path[at] = la.start[slots] + edge
            # what the region still holds
            used[at] |= (1 << edge).astype(np.int32)
            p[np.arange(len(at)), edge] = 0.0
            with np.errstate(divide="ignore"):
                mass = self.logs[s][1][np.searchsorted(self.logs[s][0], at)] + np.log(p.sum(axis=1))
            region[at] = truncated_gumbel(mass, best[d], uniform(draws(self.seeds[d], sample, 1, self.place[at])))
        # go on from the new edges to their units' ends, and through all later units
        last = after[live]
        inside = la.left[la.slot[last]] > la.length[path[last]]
        inner = last[inside] + la.length[path[last[inside]]]
        later = la.starts[live[self.doc[la.starts]] & (la.starts > after[self.doc[la.starts]])]
        self.walk(sample, np.concatenate((inner, later)), path)
        self.add(sample, path, best, after, live)
        return live

    def piece_ids(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of a path over the batch, and how many belong to each text."""
        at = np.flatnonzero(path >= 0)
        ids = self.lattice.piece[path[at]]
        by_bytes, code = ids == _BYTES, self.codes[at]
        n = np.where(by_bytes, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        out, ends = np.repeat(ids, n), np.cumsum(n)
        for width in (1, 2, 3, 4):
            which = np.flatnonzero(by_bytes & (n == width))
            if len(which):
                c, to = code[which].astype(np.int64), ends[which] - width
                lead = (0, 0, 0xC0, 0xE0, 0xF0)[width]
                for j in range(width):
                    part = c >> (6 * (width - 1 - j))
                    byte = part | lead if j == 0 else part & 0x3F | 0x80
                    out[to + j] = self.v.byte_id[byte]
        counts = np.bincount(self.doc[at], n, len(self.docs)).astype(np.int64)
        return out, counts


def text_batches(texts, keys: np.ndarray):
    """Runs of texts of bounded length, taken from Arrow one run at a time; null is empty."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    size, begin = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        size += n + 1
        if size >= _BATCH or i == len(column) - 1:
            yield begin, [t or "" for t in column[begin:i + 1].to_pylist()], keys[begin:i + 1]
            size, begin = 0, i + 1


def segmentations(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int, seed: int):
    """``(rows, rank, ids, counts, log_prob, log_inclusion)`` per rank: ids flat, counts per row."""
    search = Search(v, texts, keys, seed)
    empty = np.flatnonzero(search.sizes == 0)
    if len(empty):
        yield empty, 0, np.zeros(0, np.int32), np.zeros(len(empty), np.int64), np.zeros(len(empty)), np.zeros(len(empty))
    if not len(search.docs):
        return
    for rank, (path, total, inclusion, live) in enumerate(search.run(k)):
        ids, counts = search.piece_ids(path)
        yield search.docs[live], rank, ids, counts[live], total[live], inclusion[live]


def encode(docs: DataFrame, samples: int = 2, seed: int = 42, alpha: float = 0.3, model_file: str = MODEL,
           id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, keep..., rank, ids, log_prob, log_inclusion)``: ``samples`` segmentations per text, best first."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((*Vocabulary.read(model_file), alpha))
    key = f"{model_file} {alpha}"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep,
                       F.col(text_col).cast("string").alias("text to encode"))
    extra = slim.schema.fields[1:-1]
    schema = T.StructType([slim.schema["doc_id"], *extra, T.StructField("rank", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("log_prob", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])
    names, width = schema.names, len(extra) + 1

    def run(batches):
        v = built(shared, key)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for begin, part, part_keys in text_batches(batch.column(width), keys):
                for rows, rank, ids, counts, log_prob, inclusion in segmentations(v, part, part_keys, samples, seed):
                    take = pa.array(rows + begin)
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in range(width)),
                         pa.array(np.full(len(rows), rank, np.int32)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                         pa.array(log_prob), pa.array(inclusion)], names=names)

    return slim.mapInArrow(run, schema)


def decoded(table: tuple, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of consecutive id lists: the pieces' bytes (:func:`piece_bytes`) without the blank put before each text."""
    raw_at, raw_len, raw = table
    sizes = raw_len[ids]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(raw_at[ids] - ends[:-1], sizes) + np.arange(ends[-1])
    data, bounds = raw[source], ends[offsets]
    lead = bounds[:-1][bounds[1:] > bounds[:-1]]
    data = np.delete(data, lead)
    bounds = np.concatenate(([0], np.cumsum(np.maximum(0, np.diff(bounds) - 1))))
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def decode(encoded: DataFrame, model_file: str = MODEL, out: str = "decoded") -> DataFrame:
    """Add the text of every ``ids`` array."""
    spark = encoded.sparkSession
    ship_package(spark)
    table = piece_bytes(*Vocabulary.read(model_file)[:2])  # under a megabyte
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    at = encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            ids = batch.column(at)
            lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
            values, cuts = ids.flatten().to_numpy(zero_copy_only=False), [0]
            while cuts[-1] < len(lengths):  # some megabytes at a time
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + _BATCH, "right")) - 1))
            for a, b in zip(cuts, cuts[1:]):
                own = values[offsets[a]:offsets[b]]
                texts = decoded(table, own, offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), texts], names=schema.names)

    return encoded.mapInArrow(run, schema)
