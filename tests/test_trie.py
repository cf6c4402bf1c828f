"""The trie finds what a search term by term finds, in one scan whose cost does not follow the number of terms."""

import random
import re
import time

from pyspark.sql import functions as F

from docket.functions.trie import Terms, trie_pattern

GROUPS = {
    "a": ("is", "is a tort", "a tort", "tort of a", "x-ray", "cause of action"),
    "b": ("is a", "tort", "causes", "no cause", "c++"),
}
PIECES = ["is", "a", "tort", "of", "cause", "causes", "action", "no", "x-ray", "x", "c++", "torts", "ä", "-", ".", "\n", "\t"]


def texts(n=400):
    rnd = random.Random(5)
    return [rnd.choice(["", " "]).join(rnd.choice(PIECES) + rnd.choice([" ", " ", "  ", ""]) for _ in range(rnd.randint(0, 25)))
            for _ in range(n)] + ["", None]


def brute(text, terms):
    """Places where a term stands, each place of each term counted."""
    n = 0
    for t in terms:
        at = re.compile("(?=" + r"[ \t\r\n]+".join(re.escape(w) for w in t.split()) + "(?![a-z]))")
        n += sum(m.start() == 0 or not "a" <= text[m.start() - 1] <= "z" for m in at.finditer(text))
    return n


def test_counts_match_a_search_term_by_term(spark):
    terms = Terms(**GROUPS)
    df = spark.createDataFrame(list(enumerate(texts())), "id int, text string")
    got = df.select("text", terms.hits(F.col("text")).alias("h")).select(
        "text", *[terms.count(F.col("h"), g).alias(g) for g in GROUPS], *[terms.any(F.col("h"), g).alias("any_" + g) for g in GROUPS]).collect()
    assert len(got) == 402
    for r in got:
        if r.text is None:
            assert not r.any_a
            continue
        for g in GROUPS:
            assert r[g] == brute(r.text, GROUPS[g]), (g, r.text)
            assert r["any_" + g] == (r[g] > 0)


def test_no_terms(spark):
    terms = Terms(a=(), b=("", " "))
    r = spark.createDataFrame([("any text",)], "t string").select(terms.hits(F.col("t")).alias("h")).select(
        terms.any(F.col("h"), "a").alias("any"), terms.count(F.col("h"), "b").alias("n")).first()
    assert (r.any, r.n) == (False, 0)


def test_cost_does_not_follow_the_number_of_terms(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    vocabulary = [word() for _ in range(6000)]
    df = spark.createDataFrame([(" ".join(rnd.choice(vocabulary) for _ in range(2000)),) for _ in range(200)], "t string").repartition(8).cache()
    df.count()

    def seconds(n):
        chosen = Terms(t=[" ".join(rnd.sample(vocabulary, rnd.randint(1, 3))) for _ in range(n)])
        best = 1e9
        for _ in range(3):
            start = time.time()
            df.select(F.sum(F.size(chosen.hits(F.col("t"))))).collect()
            best = min(best, time.time() - start)
        return best

    seconds(20)
    few, many = seconds(40), seconds(4000)  # a hundred times the terms
    df.unpersist()
    assert many < 8 * few + 1.0, (few, many)


def test_deep_terms_compile():
    assert re.compile(trie_pattern(["a" * 500 + " b", "a" * 300]))
