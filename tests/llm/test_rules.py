import random
from collections import defaultdict

from pyspark.sql import functions as F

from docket.llm import rules
from docket.sinks.tables import materialize


def base(text):
    t = text or ""
    ws = t.encode().split()
    runs = defaultdict(list)
    for i in range(len(ws) - 4):
        runs[tuple(ws[i:i + 5])].append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    with_words = [x for x in t.split("\n") if x.encode().split()]
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t),
            len(with_words) - len(set(with_words)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(df):
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(base(r.text))
    got = defaultdict(list)
    for r in rules.statistics(df).collect():
        got[r.doc_id].append(tuple(r[n] for n in NAMES))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_base_counts_match_brute_force(spark, odd_docs, no_docs):
    check(odd_docs)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(("a", "b", "c ", " ", "\n", "\t")) for _ in range(rng.randrange(200)))) for i in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rules.statistics(no_docs).collect() == []


def labelled(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, x double, y double, bad int")
    return materialize(df, "test-labelled")


def test_sequential_covering_finds_conjunctions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        x, y = rng.random(), rng.random()
        rows.append((i, x, y, int((x > 0.8 and y < 0.5) or (x < 0.1 and y > 0.7))))
    found = rules.learn(labelled(spark, rows), features=("x", "y"))
    assert 2 <= len(found.rules) <= 6
    df = spark.createDataFrame(rows, "doc_id long, x double, y double, bad int")
    right = df.filter(F.coalesce(found.rule_no(), F.lit(0)).cast("boolean").cast("int") == F.col("bad")).count()
    assert right > 0.95 * len(rows)
    assert all(1 <= len(r) <= 3 for r in found.rules) and " and " in str(found)


def test_noise_gives_no_rule(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random(), rng.randrange(2)) for i in range(1000)]
    assert rules.learn(labelled(spark, rows), features=("x", "y")).rules == []


def test_one_label_or_no_rows_keeps_everything(spark):
    assert rules.learn(labelled(spark, [(i, 1.0, 2.0, 0) for i in range(50)]), features=("x", "y")).rules == []
    empty = spark.createDataFrame([], "doc_id long, x double, y double, bad int")
    assert rules.learn(empty, features=("x", "y")).rules == []


def test_judge_on_odd_rows(spark, odd_docs):
    stats = rules.statistics(odd_docs)
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in rules.judge(stats, rules.DecisionList()).collect()}
    assert got[(0, 0)] == (True, False) and got[(5, 60)][1] == (not got[(5, 60)][0])


def test_held_out_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    stats = materialize(rules.statistics(spark.read.parquet(f"{sf}/documents.parquet")), "test-stats")
    known = materialize(rules.labelled_statistics(stats, spark.read.parquet(f"{sf}/labels.parquet")), "test-known")
    train, test = known.filter("doc_id % 2 = 0"), known.filter("doc_id % 2 = 1")
    judged = rules.judge(test, rules.learn(train))
    n, right, clean_lost = judged.agg(F.count("*"), F.count_if(F.col("kept") == (F.col("bad") == 0)),
                                      F.count_if(~F.col("kept") & (F.col("bad") == 0))).first()
    assert right / n > 0.95 and clean_lost <= 0.02 * n
