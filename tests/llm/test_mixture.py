import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docket.llm import mixture


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share out, cut at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: left * w[s] / weight for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})


def highest_quotients(votes, seats):
    got = Counter()
    for _ in range(seats):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * got[p] + 1))
        got[best] += 1
    return got


def test_targets_match_sharing_again_and_again(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {f"s{i}": rng.randrange(1, 10000) for i in range(rng.randrange(1, 12))}
        sizes[None] = rng.randrange(1, 3000)
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixture.source_targets(df).collect()}
        want = water_fill(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_apportionment_matches_highest_quotients(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = {i: rng.choice((0.0, 1.0, 1.0, rng.random() * 100)) for i in range(rng.randrange(1, 9))}
        votes[99] = 50.0
        seats = rng.randrange(0, 60)
        rows += [(g, p, v, seats) for p, v in votes.items()]
        for p, n in highest_quotients(votes, seats).items():
            want[(g, p)] = n
    df = spark.createDataFrame(rows, "g int, p int, votes double, all_seats long")
    got = mixture.apportion(df, ["g"], F.col("all_seats"), ["p"]).collect()
    assert {(r.g, r.p): r.quota for r in got if r.quota} == want


def documents(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), None if i % 11 == 0 else f"s{min(i % 9, 4)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_meet_targets(spark):
    rows, df = documents(spark)
    got = mixture.mix(df, shard_words=4096).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = water_fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * r.target
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(1, 0.05 * want[s]) for s in sizes)


def test_sources_of_one_document_meet_targets(spark):
    rng = random.Random(8)
    sizes = {f"s{i:03d}": rng.randrange(7, 37) for i in range(300)} | {"big": 40_000, None: 9}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = water_fill(sizes)
    assert all(abs(got[s].taken - want[s]) <= max(1, 0.05 * want[s]) and got[s].taken <= 2 * n for s, n in sizes.items())


def test_share_above_the_caps_takes_all_of_them(spark):
    df = spark.createDataFrame([("a", 10), ("b", 30), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixture.source_targets(df, share=3.0).collect()}
    assert got == {"a": 20.0, "b": 60.0, None: 0.0}


def test_no_window_over_all_sources(spark):
    rows, df = documents(spark, 50)
    plan = mixture.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_repeatable_and_texts_agree_with_plan(spark):
    rows, df = documents(spark, 300, 4)
    key = lambda d: sorted((r.doc_id, r.taken) for r in d.collect())
    plan = key(mixture.mix(df, shard_words=2048))
    assert plan == key(mixture.mix(df.repartition(7), shard_words=2048))
    words = Counter()
    for r in mixture.mixed_texts(df, shard_words=2048).collect():
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in plan if n} == dict(words)


def test_odd_rows(odd_docs, no_docs):
    got = mixture.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.size == r.taken == 0 for r in got if r.doc_id in (0, 1, 2))
    texts = mixture.mixed_texts(odd_docs)
    assert texts.columns == [*odd_docs.columns, "epoch"] and texts.count() > 0
    assert mixture.mix(no_docs).collect() == [] and mixture.mixed_texts(no_docs).collect() == []


def test_all_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixture.mix(df).collect()] == [(0, 0.0, 0)] * 2
