import math
import random
import zlib
from collections import Counter

import numpy as np

from docket.llm import ctw


def counted(texts):
    codes, _ = ctw.byte_grams(texts)
    return np.unique(codes.astype(np.int64), return_counts=True)


def model_of(texts, contexts):
    grams, n = counted(texts)
    two, at = np.unique(grams & 0xFFFFFF, return_inverse=True)
    two_n = np.bincount(at, n)
    by = Counter()
    for g, k in zip(grams, n):
        by[g >> 8] += k
    keep = np.array([by[g >> 8] * contexts >= n.sum() for g in grams], bool)
    return ctw.Model(two, two_n, grams[keep], n[keep].astype(float)), {c for c, k in by.items() if k * contexts >= n.sum()}


def reference(texts, kept, context, byte):
    """ln probability of a byte after a three-byte context, by the recursive definition."""
    grams, n = counted(texts)
    data = [(int(g) >> 8, int(g) & 255, int(k)) for g, k in zip(grams, n)]

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def counts(match, bits):
        at = [0, 0]
        for c, b, k in data:
            if match(c) and b >> (8 - len(bits)) == (int(bits, 2) if bits else 0):
                at[b >> (7 - len(bits)) & 1] += k
        return at

    contexts = {c for c, _, _ in data}
    total = 0.0
    for level in range(8):
        bits = format(byte, "08b")[:level]
        bit = byte >> (7 - level) & 1
        leaf = {}
        for c in contexts:  # depth three: a context in the tree, or the rest of its parent
            leaf.setdefault((c & 0xFFFF, c if c in kept else None), []).append(c)
        weighted = {2: {}, 1: {}, 0: {}}
        child = {}
        for (p, own), group in leaf.items():
            child.setdefault(p, []).append(kt(*counts(lambda c, g=set(group): c in g, bits)))
        for depth, mask, below in ((2, 0xFFFF, None), (1, 0xFF, 2), (0, 0, 1)):
            groups = {c & mask for c in contexts}
            for s in groups:
                own = kt(*counts(lambda c, s=s, m=mask: c & m == s, bits))
                if depth == 2:
                    longer = sum(child[s])
                else:
                    wide = {2: 0xFFFF, 1: 0xFF}[below]
                    longer = sum(v[1] for q, v in weighted[below].items() if q & mask == s or depth == 0) if wide else 0
                weighted[depth][s] = (own, own + math.log(0.5 + 0.5 * math.exp(min(700, longer - own))), longer)

        def estimate(match):
            z, o = counts(match, bits)
            return ((z if bit == 0 else o) + 0.5) / (z + o + 1)

        group = {c for c in contexts if c & 0xFFFF == context & 0xFFFF and c not in kept}
        p = estimate((lambda c: c == context) if context in kept else (lambda c: c in group))
        for depth, mask in ((2, 0xFFFF), (1, 0xFF), (0, 0)):
            s = context & mask
            if s in weighted[depth]:
                own, _, longer = weighted[depth][s]
                stop = 1 / (1 + math.exp(min(700, longer - own)))
                p = stop * estimate(lambda c, s=s, m=mask: c & m == s) + (1 - stop) * p
        total += math.log(p)
    return total


def test_leaf_tables_match_the_recursive_definition():
    texts = [b"abracadabra", b"abc abd abc", b"", b"banana band"]
    model, kept = model_of(texts, 12)
    leaves = model.leaves()
    assert kept and len(kept) <= 12
    rng = random.Random(1)
    seen = sorted({int(g) >> 8 for g in counted(texts)[0]})
    for context in rng.sample(seen, 10):
        for byte in (ord("a"), ord("n"), 0, 200):
            assert abs(model.table[leaves[context], byte] - reference(texts, kept, context, byte)) < 1e-4
    unseen = ord("z") << 16 | ord("z") << 8 | ord("a")
    assert abs(model.table[leaves[unseen], 98] - reference(texts, kept, unseen, 98)) < 1e-4


def test_every_leaf_is_a_distribution():
    model, _ = model_of([b"some text to learn from, some more text"] * 3, 1 << 16)
    assert np.allclose(np.exp(model.table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    empty = ctw.Model(*(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)))
    assert np.allclose(np.exp(empty.table), 1 / 256)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1e3, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_grams_skip_the_padding_between_texts():
    codes, starts = ctw.byte_grams([b"ab", b"", b"c"])
    assert [c & 255 for c in codes.tolist()] == [97, 98, 0, 0, 99, 0]
    assert starts.tolist() == [0, 3, 4] and codes[4] >> 8 == 0


def base(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2:
            train.update((t or "").encode().lower().split())
            train[None] += 1
    total, kinds = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), None]
        out.append((i, len(ws), sum(train[w] > 0 for w in ws), total,
                    round(sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in ws), 6)))
    return sorted(out, key=str)


def test_base_score_matches_definition(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for head in (1 << 16, 3):  # all words sent to every task, and nearly none
        got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
               for r in ctw.score(odd_docs, head=head).collect()]
        assert sorted(got, key=str) == base(rows)


def test_model_learns(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(300)]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r.bits_per_byte for r in got if r.held_out]
    assert held and sum(held) / len(held) < 2.0  # uniform letters and blanks would cost about 2.7


def test_scores_do_not_depend_on_partitions(spark, odd_docs):
    key = lambda d: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in ctw.score(d).collect())
    assert key(odd_docs) == key(odd_docs.repartition(5))


def test_empty_table(no_docs):
    assert ctw.score(no_docs).collect() == []


def test_every_context_counts_wherever_its_table_is_looked_up(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 40))) for _ in range(28)] + [None, "zzz", "abc abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some, one = ({r.doc_id: r for r in ctw.score(df, contexts=c).collect()} for c in (1 << 16, 1))  # all sent; all joined
    train = [(t or "").encode() for i, t in enumerate(texts) if not some[i].held_out]
    seen = {int(g) >> 8 for g in counted(train)[0]}
    assert any(some[i].held_out for i in some) and len(train) < len(texts)
    for i in some:
        assert abs(some[i].score - one[i].score) < 1e-4
    for i in (29, 30):
        codes, _ = ctw.byte_grams([texts[i].encode()])
        want = sum(reference(train, seen, int(g) >> 8, int(g) & 255) for g in codes.tolist())
        assert abs(some[i].score * math.log(10) - want) < 1e-3
