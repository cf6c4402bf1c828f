import random

import pytest

import corpus_pipeline as pipeline
from docket.llm import lines, mixture, rules, simhash
from docket.sinks.tables import materialize

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    assert pipeline.ORACLE_SQL is None


def test_whole_run_matches_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stats = materialize(rules.statistics(docs), "test-stats")
    known = rules.labelled_statistics(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in rules.judge(stats, rules.learn(known)).filter("kept").collect()}
    one = stage("quality_rules")(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == kept and tuple(one.columns) == pipeline.COLUMNS

    one = materialize(one, "test-one")
    two = materialize(stage("line_dedup")(spark, one, SF), "test-two")
    assert {(r.doc_id, r.text) for r in two.collect()} == {(r.doc_id, r.text) for r in lines.dedup_texts(one).collect()}
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = materialize(stage("simhash_near_dedup")(spark, two, SF), "test-three")
    least = {r.component_id for r in simhash.near_duplicates(two).collect()}
    assert {r.doc_id for r in three.collect()} == least

    four = materialize(stage("mixing")(spark, three, SF), "test-four")
    taken = {r.doc_id: r.taken for r in mixture.mix(three).collect() if r.taken}
    got = {}
    for r in four.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == taken and tuple(four.columns) == pipeline.COLUMNS

    five = stage("sentencepiece")(spark, four, SF).collect()
    assert all(r.round_trip for r in five)
    assert sum(r["rank"] == 0 for r in five) == four.count()


def test_run_chains_the_stages(spark):
    rows = pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.filter("not round_trip").count() == 0


@pytest.fixture()
def planted(spark):
    """Clean, junk, copied and near-copied documents."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    clean = [(i, text(80)) for i in range(60)]
    copies = [(100 + i, clean[i][1]) for i in range(5)]
    near = [(200 + i, clean[10 + i][1] + " tail") for i in range(5)]
    junk = [(300 + i, "junk words " * 50) for i in range(5)] + [(400 + i, "too few") for i in range(3)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in clean + copies + near + junk]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_planted_cases(spark, planted):
    one = materialize(stage("quality_rules")(spark, planted, SF), "test-planted")
    ids = {r.doc_id for r in one.collect()}
    assert set(range(60)) <= ids and not ids & set(range(300, 500))
    two = materialize(stage("line_dedup")(spark, one, SF), "test-planted")
    ids = {r.doc_id for r in two.collect()}
    assert set(range(60)) <= ids and not ids & (set(range(100, 105)) | set(range(200, 205)))
    three = {r.doc_id for r in stage("simhash_near_dedup")(spark, one, SF).collect()}
    assert set(range(60)) <= three and not three & set(range(100, 105))


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for _, run in pipeline.STAGES[:-1]:
        out = run(spark, odd_docs, SF)
        assert tuple(out.columns) == pipeline.COLUMNS
        out.collect()
        assert run(spark, no_docs, SF).collect() == []
    assert stage("sentencepiece")(spark, no_docs, SF).collect() == []
    assert all(r.round_trip for r in stage("sentencepiece")(spark, odd_docs, SF).collect())
