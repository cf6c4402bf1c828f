"""Sentence ends learned from the texts: planted truth, rules by hand, odd input."""

from pyspark.sql import functions as F

from docket.operators.boundaries import learn, learned_sentences, sentence_ends, words_of
from docket.sources.lexical import abridged
from docket.testing import SF_MID

PLANTED = {"La", "App", "Cir", "Ct", "Co", "Inc", "Dr", "Art", "Supp", "U.S", "v"}


def test_planted_ends_are_found(spark):
    docs = abridged(spark, SF_MID)
    model = learn(docs)
    assert PLANTED <= {r.type for r in model.abbreviations.collect()}
    marked = abridged(spark, SF_MID, marks=True).select("doc_id", F.posexplode(words_of(F.col("text"))).alias("word_no", "marked"))
    both = sentence_ends(docs, model).join(marked, ["doc_id", "word_no"]).where(
        F.regexp_extract("word", r"^(.*)\.$", 1).isin(*PLANTED)).select(F.col("ends"), F.col("marked").endswith("|").alias("true_end"))
    n = {(r.ends, r.true_end): r["count"] for r in both.groupBy("ends", "true_end").count().collect()}
    hit, extra, lost = n.get((True, True), 0), n.get((True, False), 0), n.get((False, True), 0)
    assert hit > 1000 and n[(False, False)] > 5000
    assert 2 * hit / (2 * hit + extra + lost) >= 0.98, n


def corpus(spark):
    """Enough plain prose that ``La`` is told to be an abbreviation and ``The`` a starter."""
    lines = ["we saw the court in La. App. and the house in La. Cir. today. The end came to the house.",
             "a house stood near the court of La. Dist. then. We saw the house. It was the end, as it was."]
    return [(i, lines[i % 2]) for i in range(60)]


def sentences_for(spark, *texts):
    rows = corpus(spark) + [(1000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in learned_sentences(docs, learn(docs)).collect()}
    assert len(got) == len(rows)
    return [got[1000 + i] for i in range(len(texts))]


def test_both_sides_decide(spark):
    a, b, c, d = sentences_for(
        spark, "It was in La. The court agreed.", "Is it in La. App. now? yes it is", 'He said "the end." The house fell at 3. It was John Q. Public.',
        "the court. of the house")
    assert a == ["It was in La.", "The court agreed."]
    assert b == ["Is it in La. App. now?", "yes it is"]
    assert c == ['He said "the end."', "The house fell at 3.", "It was John Q. Public."]
    assert d == ["the court. of the house"]


def test_odd_input(spark):
    long = "the house stood. " * 50_000
    none, empty, blank, stops, whole = sentences_for(spark, None, "", " \n\t ", "... . !", long)
    assert none == empty == blank == []
    assert " ".join(stops) == "... . !"
    assert " ".join(whole) == " ".join(long.split())
    docs = spark.createDataFrame([], "doc_id long, text string, word string, type long")
    model = learn(docs)
    assert model.abbreviations.count() == 0 and sentence_ends(docs, model).count() == 0 and learned_sentences(docs, model).count() == 0


def test_repeated_rows_say_the_same(spark):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string")
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 500))
    types = lambda d: sorted(r.type for r in learn(d).abbreviations.select("type").collect())
    assert types(docs) == types(twice) and "La" in types(docs)


def test_only_stops_after_suspects_and_initials_are_counted(spark, monkeypatch):
    from docket.operators import boundaries

    plans, write = {}, boundaries.materialize

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(boundaries, "materialize", seen)
    df = spark.createDataFrame([(i, "He paid Co. of Rome and Co. of Lens. He left. (J. “La.” x.y a.b.c. J. Roe \x01Co.\x01 of") for i in range(9)],
                               "doc_id int, text string")
    model = boundaries.learn(df)
    assert "Aggregate [word#" not in plans["sentence_pairs"] and "sentence_suspects" in plans
    got = {r.type: (r.n_with, r.n_without, r.n_inside) for r in boundaries.word_types(df).collect()}
    assert got["Co"] == (27, 0, 27) and got["La"] == (9, 0, 0) and got["x.y"] == (0, 9, 0) and got["a.b.c"] == (9, 0, 9)
    assert got["J"][:2] == (18, 0) and {r.type for r in model.pairs.collect()} >= {"J"}
