"""Rows with null or repeated ids: the pipeline decides by row, not by id."""

from collections import Counter

import corpus_pipeline as pipeline
from docket.llm import rules, simhash
from docket.sinks.tables import materialize

SF = "/root/testdata/sf0.001"


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_judges_each_row_by_its_text(spark, odd_docs):
    stats = materialize(rules.statistics(odd_docs, id_col="text"), "test-texts")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = materialize(rules.labelled_statistics(materialize(rules.statistics(odd_docs), "test-stats"), labels), "test-known")
    good = {r.doc_id for r in rules.judge(stats, rules.learn(known)).collect() if r.kept}
    want = Counter((r.doc_id, r.text) for r in odd_docs.collect() if r.text in good)
    assert texts(pipeline.quality(spark, odd_docs, SF)) == want
    body = odd_docs.filter("doc_id = 5").first().text
    assert want[(None, body)] == 1 and want[(5, body)] == 3


def test_a_rejected_row_leaves_other_rows_of_its_id(spark, odd_docs):
    body = odd_docs.filter("doc_id = 5").first().text
    rows = [(7, body, "en", "s", 1), (7, "too few", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert texts(pipeline.quality(spark, df, SF)) == Counter({(7, body): 1})


def test_one_row_of_each_group_stays(spark, odd_docs):
    marks = [simhash.majority_bits(simhash.shingle_hashes(r.text, 3)) for r in odd_docs.collect()]
    rows = odd_docs.collect()
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(marks):
            group[i] = min(group[j] for j, y in enumerate(marks) if (x ^ y).bit_count() <= 3)
    want = {}
    for g, r in zip(group, rows):
        want[g] = min(want.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    got = pipeline.near_dedup(spark, odd_docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want.values())


def test_null_and_repeated_ids_in_near_dedup(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(None, one, "en", "s", 1), (None, one, "en", "t", 1), (None, two, "en", "s", 1), (None, two, "en", "s", 1)]
    got = texts(pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), SF))
    assert got == Counter({(None, one): 1, (None, two): 1})
    rows = [(1, one, "en", "s", 1), (2, one, "en", "s", 1), (2, two, "en", "s", 1), (2, two, "en", "s", 1)]
    got = texts(pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), SF))
    assert got == Counter({(1, one): 1, (2, two): 1})
