"""Piece probabilities against sums over all segmentations listed one by one; held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docket.llm import langid
from docket.llm.queries import op12_language_id
from docket.testing import SF_SMALL

PIECES = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "c", "ab", "▁a", "bc", "abc", "▁ab", "é"]
KINDS = ["other", *["byte"] * 256, *["normal"] * 10]


def segmentations(word):
    """Every way to write a blank and the word in pieces (characters without a piece by bytes)."""
    known = {p: i for i, p in enumerate(PIECES) if KINDS[i] == "normal"}

    def rest(s):
        if not s:
            yield []
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                yield from ([known[s[:n]], *more] for more in rest(s[n:]))
        if s and s[0] not in known:
            yield from ([*(1 + b for b in s[0].encode()), *more] for more in rest(s[1:]))

    return list(rest("▁" + word))


@pytest.fixture(scope="module")
def log_p():
    p = np.random.default_rng(3).random((len(PIECES), 3)) + 0.01
    return np.log(p / p.sum(0))


WORDS = ["abc", "a", "", "cab", "éab", "xéñ", "abcabcabc", "𐍈a"]


def test_forward_sums_all_segmentations(log_p):
    v = langid.Pieces(PIECES, KINDS)
    got = langid.Lattice(v, WORDS).word_logs(log_p), langid.word_logs(v, WORDS, log_p, np.exp(log_p))
    for w, *rows in zip(WORDS, *got):
        want = [math.log(sum(math.exp(log_p[s, k].sum()) for s in segmentations(w))) for k in range(3)]
        assert np.allclose(rows[0], want) and np.allclose(rows[1], want)


def test_a_product_that_underflows(log_p):
    v, low = langid.Pieces(PIECES, KINDS), log_p - 40
    words, counts = ["ab" * 8, "abc", "ab" * 200], np.array([2.0, 1.0, 3.0])
    assert np.allclose(langid.word_logs(v, words, low, np.exp(low)), langid.Lattice(v, words).word_logs(low))
    one = low[:, 0]
    assert np.allclose(langid.expected_uses(v, words, counts, one, np.exp(one)), langid.Lattice(v, words).expected(one, counts))


def test_expected_uses(log_p):
    counts = np.arange(1, len(WORDS) + 1, dtype=float)
    v = langid.Pieces(PIECES, KINDS)
    got = langid.Lattice(v, WORDS).expected(log_p[:, 1], counts)
    assert np.allclose(got, langid.expected_uses(v, WORDS, counts, log_p[:, 1], np.exp(log_p[:, 1])))
    want = np.zeros(len(PIECES))
    for w, n in zip(WORDS, counts):
        ways = [(s, math.exp(log_p[s, 1].sum())) for s in segmentations(w)]
        for s, p in ways:
            np.add.at(want, s, n * p / sum(x for _, x in ways))
    assert np.allclose(got, want)


def test_learning_raises_the_probability_of_the_training_text(spark):
    texts = [("en", "the thing that the other thing did"), ("fr", "la chose que l'autre chose faisait")] * 3
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    scores = []
    for rounds in (1, 2, 4):
        model, (pieces, kinds) = langid.learn(df, rounds=rounds, smoothing=1.0)
        v = langid.Pieces(pieces, kinds)
        scores.append(langid.Lattice(v, "the thing that the other thing did".split()).word_logs(model.log_p)[:, 0].sum())
        assert model.langs == ["en", "fr"] and np.allclose(np.exp(model.log_p).sum(0), 1)
    assert scores == sorted(scores)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op12_language_id(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in tested)
    assert len(tested) > 30 and right / len(tested) >= 0.97


def test_only_the_text_is_looked_at(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "text")
    one = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    turned = docs.withColumn("lang", langid.F.expr("case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'xx' else lang end"))
    two = {r.doc_id: r.lang_pred for r in langid.identify(turned).collect()}
    assert one == two and "xx" not in two.values()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    asked = odd_docs.collect()
    assert len(rows) == len(asked)
    want = Counter((r.doc_id, r.text is None or not any(map(str.isalpha, r.text))) for r in asked)
    assert Counter((r.doc_id, r.lang_pred == "und") for r in rows) == want
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.identify(no_docs).collect() == []
    unlabelled = odd_docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_long_words_are_several():
    flat, sizes = langid.text_words(pa.array(["x" * 1000 + " y", None, " \t", "a\u2003b\n c ", "ab" * 5000]))
    assert flat.to_pylist()[:5] == ["x" * 256] * 3 + ["x" * 232, "y"] and flat.to_pylist()[5:8] == ["a", "b", "c"]
    assert sizes.tolist() == [5, 0, 0, 3, 40] and "".join(flat.to_pylist()[8:]) == "ab" * 5000


def test_trie_steps():
    v = langid.Pieces(PIECES, KINDS)
    symbol = lambda c: np.array([v.char[ord(c)]], np.int64)
    for word in ("abc", "▁ab", "bc"):
        node = np.zeros(1, np.int64)
        for c in word:
            node = v.step(node, symbol(c))
        assert v.piece[node[0]] == PIECES.index(word)
    assert v.step(v.step(np.zeros(1, np.int64), symbol("b")), symbol("a"))[0] == 0
