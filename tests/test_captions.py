"""Citation grammar, back-references and grounding on hand-made texts."""

import re

import pytest
from pyspark.sql import functions as F

from docket.config import Lexicon
from docket.functions.captions import CITES, FULL, REPORTERS, with_caption
from docket.operators.analyze import RuleAnalyzer
from docket.operators.grounding import ground
from docket.operators.references import references
from docket.sources.captions import FORMS
from docket.testing import SF_MID, compare, duck


def test_some_fifty_forms():
    assert len(FORMS) >= 40 and sum(f[4] is not None for f in FORMS) >= 40


@pytest.mark.parametrize("reporter", sorted(REPORTERS))
def test_no_known_reporter_is_lost(reporter):
    for series in REPORTERS[reporter]:
        for name in {reporter, reporter.replace(" ", "")}:
            cite = f"Doe v. Roe, 12 {name}{' ' + series if series else ''} 345 (Court 1999)"
            assert re.fullmatch(FULL, cite), cite


@pytest.mark.parametrize("text", [
    "He sued. Smith v. Jones, 1 So. 2d 3 (La. 1950)", "see Jones v. Smith Bros. Constr. Co., 1 A.3d 3 (Me. 2011)",
    "In re J.M.B., 1 P.3d 4 (Kan. 2000)", "Doe v. Roe, 98-1 (La. App. 1 Cir. 2/3/99), 100 So. 2d 4, 200 So. 2d 5"])
def test_where_a_name_begins(text):
    want = {"He": "Smith v. Jones, 1 So. 2d 3 (La. 1950)", "see": "Jones v. Smith Bros. Constr. Co., 1 A.3d 3 (Me. 2011)"}
    assert re.search(FULL, text).group(0) == want.get(text.split()[0], text)


def test_prose_is_no_citation():
    assert not re.search(FULL, "The Court in 12 Cases of 1999 held so. No. 12 was lost, and 45 P.M. came (La. 1999).")
    assert not re.search(CITES, "12 Roses 34 (La. 1999)")


@pytest.fixture(scope="module")
def captions(spark):
    rows = [
        (0, "SUPREME COURT OF LOUISIANA\nNo. 2014-CQ-1\nA B\nv.\nC D\nJune 30, 2015\nThe plaintiff lost."),
        (1, "A B\nv.\nC D\nno court or date"), (2, ""), (3, None), (4, "Prose only. Nothing more."),
        (5, "x" * 200_000 + "\n" + "Lorem ipsum dolor. " * 20_000),
        (6, "Court of Appeal\nIn re: Baby Girl\nFiled 1/2/1999\n\nOpinion text follows."),
    ]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_header_blocks(captions):
    got = {r.doc_id: r.caption for r in with_caption(captions).collect()}
    assert got[0].citation == "A B v. C D, No. 2014-CQ-1 (SUPREME COURT OF LOUISIANA June 30, 2015)" and got[0].year == 2015
    assert all(got[i].citation is None and got[i].form is None for i in (1, 2, 3, 4, 5))
    assert got[6].citation == "In re: Baby Girl (Court of Appeal 1/2/1999)"


def test_a_case_with_a_header_block_does_not_fail(captions):
    docs = captions.select(F.col("doc_id").cast("string").alias("filename"), "text")
    got = {r.filename: r for r in RuleAnalyzer(Lexicon()).analyze(docs).collect()}
    assert got["0"].error is None and got["0"].analysis.blue_book_citation.startswith("A B v. C D, No. 2014-CQ-1")
    assert got["0"].analysis.summary == "The plaintiff lost."
    assert "blue_book_citation" in got["1"].error


def test_back_references(spark):
    text = ("See Doe v. Roe, 172 So. 3d 607, 610 (La. 2015). Id. at 612. Id.\nLater, Fox v. Gray, 10 N.E.2d 5 (Ill. 1937). "
            "Roe, supra, at 615, and 172 So.3d at 616. 99 P.2d at 3. Id. at 9. Fox, supra. The idea (id. at 7) stands.")
    df = spark.createDataFrame([(1, text), (2, None), (3, "Id. at 5. Nobody, supra."), (4, "")], "doc_id int, text string")
    rows = [(r.doc_id, r.kind, r.target, r.pinpoint) for r in references(df).orderBy("doc_id", "ref_no").collect()]
    doe, fox = "Doe v. Roe, 172 So. 3d 607, 610 (La. 2015)", "Fox v. Gray, 10 N.E.2d 5 (Ill. 1937)"
    assert rows == [
        (1, "full", doe, "610"), (1, "id", doe, "612"), (1, "id", doe, None), (1, "full", fox, None), (1, "supra", doe, "615"),
        (1, "short", doe, "616"), (1, "short", None, "3"), (1, "id", None, "9"), (1, "supra", fox, None), (1, "id", fox, "7"),
        (3, "id", None, "5"), (3, "supra", None, None)]


def test_grounding(spark):
    text = "One two *5 three, four five. *6 six “Seven” eight nine ten\n*7 one two three four"
    asked = [("Three FOUR five", "5"), ("three four five", "6"), ("five six seven", "5"), ("one two three four", "7"),
             ("one two three four", None), ("six seven eight nine eleven", "6"), ("seven nine", "6"), ("", "6"), (None, None)]
    df = spark.createDataFrame([(text, [dict(zip(("quote", "page"), a)) for a in asked]), (None, [{"quote": "x", "page": "1"}]), ("x", [])],
                               "text string, quotes array<struct<quote:string,page:string>>")
    got = [[(g.status, g.page) for g in r.grounding] for r in ground(df).collect()]
    assert got[0] == [("found", "right"), ("found", "wrong"), ("found", "right"), ("found", "right"), ("found", "none"),
                      ("altered", None), ("missing", None), ("missing", None), ("missing", "none")]
    assert [s for s, _ in got[1]] == ["missing"] and got[2] == []


@pytest.mark.parametrize("key", ["caption_forms", "citation_references", "quote_grounding"])
def test_oracles_at_the_larger_scale(spark, key):
    import __spark_entry__ as E

    ok, said = compare(E.queries()[key](spark, SF_MID), duck(SF_MID), E.oracle_sql()[key])
    assert ok, said


def test_long_runs_of_capitalised_words(spark):
    run, cite = "The " * 40_000, "Doe v. Roe, 1 So. 2d 3 (La. 1950)"
    pages = "Doe v. Roe, 1 So. 2d 3" + "".join(f", {i}" for i in range(4, 9000)) + " (La. 1950)"
    texts = [run + "end. " + cite, run + cite, run + "Doe, supra, at 5. " + cite, "THE" * 40_000 + " " + cite, pages, "\n" * 30_000 + cite,
             "COURT " + run + "\nDoe\nv.\nRoe\nJune 30, 2015\n", run + "\nv.\nRoe\nJune 30, 2015\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in references(df).orderBy("doc_id", "ref_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.reference))
    assert got == {0: [("full", cite)], 1: [("full", run + cite)], 2: [("supra", run + "Doe, supra, at 5"), ("full", cite)],
                   3: [("full", "THE" * 40_000 + " " + cite)], 4: [("full", pages)], 5: [("full", cite)]}
    captions = {r.doc_id: r.caption.citation for r in with_caption(df).collect()}
    assert captions[1] == run + cite and captions[5] == cite
    assert captions[6] == f"Doe v. Roe (COURT {run.strip()} June 30, 2015)" and captions[7] == f"{run.strip()} v. Roe (June 30, 2015)"


def test_grounding_of_a_long_text_takes_time_in_proportion(spark):
    import time

    text = " ".join(f"w{i % 30_011}x{i % 7}" for i in range(60_000))
    words = text.split()
    asked = [{"quote": " ".join(words[k:k + 50] + ["zzz"] * 47), "page": None} for k in range(0, 40_000, 2_000)]
    df = spark.createDataFrame([(text, asked)], "text string, quotes array<struct<quote:string,page:string>>")
    began = time.time()
    got = ground(df).first().grounding  # every word cut the whole text anew: minutes
    assert time.time() - began < 30
    assert [g.status for g in got] == ["altered"] * 20 and {g.coverage for g in got} == {47 / 51}
