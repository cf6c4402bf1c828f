"""Error of the likeness that the query gives for documents with a shared passage."""

import random

from docket.llm import spans


def test_likeness_of_a_shared_passage(spark):
    rng, rows, exact = random.Random(4), [], []
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for i in range(60):
        shared = text(360)
        pair = [text(1800) + shared + text(1800), text(900) + shared + text(2700)]
        rows += [(2 * i + k, t) for k, t in enumerate(pair)]
        sets = [{t[j:j + 24] for j in range(len(t) - 23)} for t in pair]
        exact.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    got = {r.doc_id: r.near_next for r in spans.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = [got[2 * i] - j for i, j in enumerate(exact)]
    assert max(exact) < 0.06 and sum(got[2 * i] == 0 for i in range(60)) <= 3
    assert (sum(x * x for x in off) / 60) ** 0.5 < 0.026  # sqrt(J (1 - J) / 128) is 0.018 at 0.045
