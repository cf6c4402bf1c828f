"""Phrases against plain counting, with small tries, small filters and small salts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docket.llm import phrases
from docket.llm.queries import op11_phrase_collocations
from docket.llm.sql import PHRASE_COLLOCATIONS
from docket.testing import SF_SMALL, compare, duck


def expected(rows, min_count, top, percent=80):
    """``rows`` are (lang, text)."""
    freq, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", text or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    freq[lang][tuple(ws[i:i + m])] += 1
    out = []
    for lang, f in freq.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cands.items():
            if any(len(g) > len(p) and 100 * b >= percent * a and any(g[i:i + len(p)] == p for i in range(len(g) - len(p) + 1))
                   for g, b in cands.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    line = "The Quick brown fox, jumps over the lazy dog"
    rows = []
    for i in range(120):
        ws = [f"w{int(rng.paretovariate(0.9)) % 40}" for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            ws.insert(rng.randint(0, len(ws)), line)
        rows.append((rng.choice(["en", "en", "de", None, "x\ny z"]), rng.choice([" ", "\t ", " . ", "\n"]).join(ws)))
    return rows + [("en", None), ("en", ""), ("fr", "one"), ("en", ";,."), ("en", "é È é È é È\x00 a\x00 a\x00")]


@pytest.mark.parametrize("options", [{}, {"entries": 50, "burst": 4}, {"entries": 1 << 20, "burst": 2, "filter_bits": 6}])
@pytest.mark.parametrize("parts", [1, 6])
def test_whole_result(spark, texts, options, parts):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(parts)
    for min_count, top in ((3, 2000), (2, 7)):
        assert got(phrases.mine(df, min_count=min_count, top=top, salts=3, **options)) == expected(texts, min_count, top)


@pytest.mark.parametrize("lengths", phrases.STEPS)
def test_a_numbering_started_anew(texts, monkeypatch, lengths):
    """Few ids, small windows and small chunks of a long text: counts stay whole."""
    for name, value in (("_IDS", 20), ("_CHUNK", 64), ("_WINDOW", 50), ("_SEEN", 5)):
        monkeypatch.setattr(phrases, name, value)
    whole = "\n".join(t or "" for _, t in texts)
    table = None
    if lengths[0] > 1:
        table = type("", (), {"value": np.full(1 << 4, ~np.uint64(0))})  # everything may be frequent
    found = Counter()
    for batch in phrases.count_sequences(lengths, table, 100, 4)([_batch([("en", whole)])]):
        for p, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found[p.removeprefix("en\n")] += n
    ws, want = phrases.tokens(whole.encode()), Counter()
    for m in lengths:
        for i in range(len(ws) - m + 1):
            if b"\xff" not in ws[i:i + m]:
                want[b" ".join(ws[i:i + m]).decode()] += 1
    assert found == want


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "text"])


@pytest.mark.parametrize("rest", [1, 2, 3])
def test_trie_bursts_and_spills_whole_subtrees(rest):
    rng = random.Random(2)
    trie, want = phrases.HatTrie(rest, burst=3), Counter()
    for _ in range(20):
        seqs = [(rng.randint(1, 300), *(rng.randint(1, 9) for _ in range(rest))) for _ in range(60)]
        want.update(seqs)
        packed = [sum(x << phrases._ID_BITS * (rest - 1 - k) for k, x in enumerate(s[1:])) for s in seqs]
        trie.add(np.array([s[0] for s in seqs]), np.array(packed))
    assert trie.size == len(want) and any(isinstance(x, phrases.Node) for x in trie.root.values())
    left = trie.size // 2
    runs = list(trie.spill(left))
    assert trie.size <= left and all(len({f >> 6 for f in first.tolist()}) == 1 for first, _, _ in runs)
    found = Counter()
    for first, packed, counts in runs + list(trie.spill(0)):
        assert sorted(zip(first.tolist(), packed.tolist())) == list(zip(first.tolist(), packed.tolist()))
        for f, p, n in zip(first.tolist(), packed.tolist(), counts.tolist()):
            found[(f, *(p >> phrases._ID_BITS * k & (1 << phrases._ID_BITS) - 1 for k in reversed(range(rest))))] += n
    assert found == want and trie.size == 0


def test_filter_never_misses():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    table = np.zeros(1 << 4, np.uint64)
    slot = hashes >> np.uint64(54)
    np.bitwise_or.at(table, (slot >> np.uint64(6)).astype(int), np.uint64(1) << (slot & np.uint64(63)))
    known = phrases.Filter(table)
    assert known.has(hashes).all() and all(known.has_one(int(h)) for h in hashes)


def test_products_beyond_64_bits(spark):
    big = 9 * 10**17
    rows = [("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long")
    (row,) = phrases.cut_scores(df).collect()
    assert row.score == 2000000 * (big - 1) // (2 * big)


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(phrases.mine(odd_docs, min_count=2)) == expected([(r.lang, r.text) for r in odd_docs.collect()], 2, 2000)
    assert phrases.mine(no_docs).collect() == []


def test_sql(spark):
    ok, said = compare(op11_phrase_collocations(spark, SF_SMALL), duck(SF_SMALL), PHRASE_COLLOCATIONS)
    assert ok, said
