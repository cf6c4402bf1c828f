import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm import segment

TEXTS = ["", "a b", "  a  b ", "hello\nworld ▁ x", "日本𐍈 é", "tokenization of invented words", "x" * 700, "the " * 300]


@pytest.fixture(scope="module")
def vocabulary():
    return segment.Vocabulary.load()


def sampled(v, texts, k, seed=42, keys=None):
    out = defaultdict(dict)
    keys = np.arange(len(texts)) if keys is None else keys
    for begin, part, own in segment.text_batches(texts, keys):
        for rows, rank, ids, counts, log_prob, inclusion in segment.segmentations(v, part, own, k, seed):
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
            back = segment.decoded((v.raw_at, v.raw_len, v.raw), ids, ends).to_pylist()
            for r, a, b, text, lp, inc in zip(rows, ends, ends[1:], back, log_prob, inclusion):
                out[r + begin][rank] = (tuple(ids[a:b].tolist()), text, lp, inc)
    return out


def every(v, text):
    """All segmentations and their probabilities, for text of vocabulary characters."""
    t = " " + text
    by_text = {}
    for i in v.normal:
        raw = v.raw[v.raw_at[i]:v.raw_at[i] + v.raw_len[i]].tobytes().decode()
        by_text[raw] = i

    def ways(at):
        if at == len(t):
            yield ()
        for n in range(1, v.longest + 1):
            if at + n <= len(t) and t[at:at + n] in by_text:
                for rest in ways(at + n):
                    yield (by_text[t[at:at + n]], *rest)

    found = {w: math.exp(sum(v.log_p[i] for i in w)) for w in ways(0)}
    total = sum(found.values())
    return {w: p / total for w, p in found.items()}


def test_round_trip_and_distinct(vocabulary):
    got = sampled(vocabulary, TEXTS, 4)
    for i, text in enumerate(TEXTS):
        assert all(s[1] == text for s in got[i].values())
        assert len({s[0] for s in got[i].values()}) == len(got[i]) >= 1
    assert len(got[0]) == 1 and got[0][0][0] == () and got[0][0][3] == 0.0


def test_all_segmentations_when_k_exceeds_them(vocabulary):
    want = every(vocabulary, "cat")
    got = sampled(vocabulary, ["cat"], 60)[0]
    assert {s[0] for s in got.values()} == set(want)
    for ids, _, lp, inc in got.values():
        assert abs(lp - math.log(want[ids])) < 1e-9 and inc == 0.0


def test_frequencies_without_replacement(vocabulary):
    want = every(vocabulary, "ab c")
    n = 6000
    got = sampled(vocabulary, ["ab c"] * n, 2, seed=3)
    first, second = Counter(g[0][0] for g in got.values()), Counter(g[1][0] for g in got.values())
    for w, p in want.items():
        assert abs(first[w] / n - p) < 4 * math.sqrt(p / n) + 2e-3
        q = sum(o * p / (1 - o) for x, o in want.items() if x != w)
        assert abs(second[w] / n - q) < 4 * math.sqrt(q / n) + 2e-3


def test_inclusion_scores_are_unbiased(vocabulary):
    """Sums of p / inclusion over a sample estimate 1."""
    n = 4000
    got = sampled(vocabulary, ["cat"] * n, 3, seed=9)
    estimate = [sum(math.exp(s[2] - s[3]) for s in g.values()) for g in got.values()]
    assert abs(sum(estimate) / n - 1) < 0.05


def test_long_units_match_short_sums(vocabulary):
    """Units summed as logarithms give the probabilities that plain sums give."""
    text = "ab" * 60
    plain = sampled(vocabulary, [text], 3)[0]
    limit = segment._SHORT
    try:
        segment._SHORT = 10
        logs = sampled(vocabulary, [text], 3)[0]
    finally:
        segment._SHORT = limit
    assert [s[0] for s in plain.values()] == [s[0] for s in logs.values()]
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(plain.values(), logs.values()))


def test_results_do_not_depend_on_the_batch(vocabulary):
    alone = [sampled(vocabulary, [t], 3, keys=np.array([i]))[0] for i, t in enumerate(TEXTS)]
    together = sampled(vocabulary, TEXTS, 3)
    assert all({k: v[0] for k, v in alone[i].items()} == {k: v[0] for k, v in together[i].items()} for i in range(len(TEXTS)))
    turned = sampled(vocabulary, TEXTS[::-1], 3, keys=np.arange(len(TEXTS))[::-1])
    assert turned[0][0][0] == together[len(TEXTS) - 1][0][0]


def test_seeds_change_samples(vocabulary):
    a, b = (sampled(vocabulary, ["several words to segment here"] * 5, 2, seed=s) for s in (1, 2))
    assert any(a[i][0][0] != b[i][0][0] for i in range(5))


def test_encode_and_decode_frames(odd_docs, no_docs):
    back = segment.decode(segment.encode(odd_docs, samples=2, keep=("text", "source")))
    assert back.filter(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    ranks = Counter((r.doc_id, r["rank"]) for r in back.collect())
    assert ranks[(5, 0)] == 3 and ranks[(0, 1)] == 0
    assert segment.encode(no_docs).collect() == []


def test_a_vocabulary_of_its_own():
    pieces = ["a", "b", "ab", segment.SPACE, segment.SPACE + "a"] + [f"<0x{i:02X}>" for i in range(256)]
    v = segment.Vocabulary(pieces, ["normal"] * 5 + ["byte"] * 256, [-float(i) for i in range(5 + 256)])
    got = sampled(v, ["abab", "zé b"], 3)
    assert all(s[1] == t for i, t in enumerate(["abab", "zé b"]) for s in got[i].values())
    assert len(set(itertools.chain.from_iterable(s[0] for s in got[0].values()))) <= 5
