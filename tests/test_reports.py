"""Report lines (R20-R22) and the partitioned sink."""

import os

from docket.operators.report import HEADINGS, report_lines
from docket.sinks.reports import read_reports, write_reports
from docket.schema import RESULT_SCHEMA


def _case(fn, rel="High", sup="Supports", kps=("k1", "k2"), cites=(), quotes=("“q”, at *3",)):
    return (fn, ("Doe v. Roe, 1 So. 3d 2 (La. 2001)", "S.", rel, "R.", list(kps), list(cites), list(quotes), "A.", sup), None)


def test_layout_and_page_breaks(spark):
    df = spark.createDataFrame([_case("b.docx"), _case("a.docx", kps=())], RESULT_SCHEMA)
    lines = report_lines(df).collect()
    rep = "high_relevance/high_relevance_analysis"
    a = sorted([r for r in lines if r["report"] == rep and r["filename"] == "a.docx"], key=lambda r: r["line_no"])
    b = sorted([r for r in lines if r["report"] == rep and r["filename"] == "b.docx"], key=lambda r: r["line_no"])
    assert a[0]["style"] == "Heading 1" and a[0]["text"].startswith("Case Analysis: Doe v. Roe")
    assert b[0]["style"] == "Page Break"  # not the first case of its report
    assert a[1]["text"] == "_" * 50
    heads = [r["text"] for r in a if r["style"] == "Heading 2"]
    assert heads == list(HEADINGS)  # every section appears, even with an empty list
    rel = [r["text"] for r in a if r["text"].startswith("Relevance Level: ")][0]
    assert rel == "Relevance Level: High\nReasoning: R.\n"
    bullets_b = [r["text"] for r in b if r["style"] == "List Bullet"]
    assert bullets_b == ["k1", "k2", "“q”, at *3"]
    # each case appears in the level report and its combination report
    assert {r["report"] for r in lines} == {rep, "high_relevance/Relevance High - Supports"}


def test_sink_roundtrip_and_overwrite_modes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "reports")
    first = spark.createDataFrame([_case("a.docx"), _case("b.docx", rel="Low", sup="Does not Support")], RESULT_SCHEMA)
    write_reports(report_lines(first), path, partitions=3)
    back = read_reports(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, report_lines(first).collect()))
    # second run has no Low case: dynamic overwrite keeps the stale Low reports
    second = spark.createDataFrame([_case("c.docx")], RESULT_SCHEMA)
    write_reports(report_lines(second), path)
    reports = {r[0] for r in read_reports(spark, path).select("report").distinct().collect()}
    assert "low_relevance/low_relevance_analysis" in reports
    files = {r[0] for r in read_reports(spark, path).where("report like 'high%'").select("filename").distinct().collect()}
    assert files == {"c.docx"}
    # replace_all drops them
    write_reports(report_lines(second), path, replace_all=True)
    reports = {r[0] for r in read_reports(spark, path).select("report").distinct().collect()}
    assert reports == {"high_relevance/high_relevance_analysis", "high_relevance/Relevance High - Supports"}


def test_sink_files_are_ordered(spark, tmp_dir):
    path = os.path.join(tmp_dir, "reports")
    cases = [_case(f"{i:03d}.docx") for i in range(30)]
    lines = report_lines(spark.createDataFrame(cases, RESULT_SCHEMA))
    write_reports(lines, path, partitions=4)
    folder = os.path.join(path, "folder=high_relevance", "name=high_relevance_analysis")
    import pyarrow.parquet as pq

    keys = []
    for f in sorted(x for x in os.listdir(folder) if x.endswith(".parquet")):
        t = pq.read_table(os.path.join(folder, f)).to_pydict()
        keys += list(zip(t["filename"], t["line_no"]))
    assert keys == sorted(keys) and len({k[0] for k in keys}) == 30
