"""Rule analyzer edge cases on hand-made rows."""

from pyspark.sql import functions as F

from docket.config import FIXTURE_LEXICON, Lexicon
from docket.operators.analyze import RuleAnalyzer, missing_fields, missing_without
from docket.operators.requests import PromptTemplate


def _fields(spark, texts, lex):
    df = spark.createDataFrame([(f"{i}.docx", t) for i, t in enumerate(texts)], "filename string, text string")
    return {r["filename"]: r for r in RuleAnalyzer(lex).fields(df, keep_private=True).collect()}


def test_phrase_lexicon(spark):
    text = (
        "Doe v. Roe, 12 So. 3d 34 (La. 2009)\n"
        "The court held that intentional spoliation is not a standalone tort. "
        "Plaintiff sought duplicative recovery, and existing remedies were adequate.\nUnrelated."
    )
    r = _fields(spark, [text], Lexicon())["0.docx"]
    assert r["blue_book_citation"] == "Doe v. Roe, 12 So. 3d 34 (La. 2009)"
    assert r["relevance_level"] == "High" and r["n_both"] == 1
    assert r["support_level"] == "Strongly Supports" and r["net_support"] == 2
    assert r["key_points"] == ["The court held that intentional spoliation is not a standalone tort"]
    assert r["argument"].startswith("Doe v. Roe, 12 So. 3d 34 (La. 2009) strongly supports the position")


def test_adjacent_hits_all_counted(spark):
    r = _fields(spark, ["thing thing erble. attion"], FIXTURE_LEXICON)["0.docx"]
    assert r["net_support"] == 2
    r = _fields(spark, ["thing thing erble. attion"], FIXTURE_LEXICON.with_terms(contra_terms=("attion x",)))["0.docx"]
    assert r["net_support"] == 3  # phrase lexicon: separate scans, same counting rule


def test_topic_and_holding_must_share_a_sentence(spark):
    rows = _fields(spark, ["worthless claim. thble ruling.", "worthless thble ruling.", "nothing."], FIXTURE_LEXICON)
    assert [rows[f"{i}.docx"]["relevance_level"] for i in range(3)] == ["Medium", "High", "Low"]


def test_quote_pages(spark):
    text = "\n".join([
        "Head",
        "“before any page”",
        "*610 text",
        "“on 610” then *611",
        "**2 “second pagination is not a page”",
        "“a” and *612 “b",
        "*613 over lines” “c” “never closed “d”",
    ])
    r = _fields(spark, [text], FIXTURE_LEXICON)["0.docx"]
    assert [(q["quote"], q["page"]) for q in r["_quote_records"]] == [
        ("before any page", None),
        ("on 610", "610"),  # the last marker before the quote opens
        ("second pagination is not a page", "611"),
        ("a", "611"),
        ("b\n*613 over lines", "612"),
        ("c", "613"),
        ("d", "613"),
    ]
    assert r["quotes"][0] == "“before any page”" and r["quotes"][1] == "“on 610”, at *610"


def test_caption_below_a_court_header(spark):
    cite = "Doe v. Roe, 12 So. 3d 34 (La. 2009)"
    texts = [f"COURT OF APPEAL\n\n  {cite}\nWe affirm. See Poe v. Low, 1 So. 2d 3 (La. 1990).",
             f"Before.\nAs said in {cite}, no.", f"In re {cite}", f"\n{cite}\nx", f"A\n{cite}"]
    rows = _fields(spark, texts, FIXTURE_LEXICON)
    assert [rows[f"{i}.docx"]["blue_book_citation"] for i in range(5)] == [cite, None, cite, cite, cite]
    assert [rows[f"{i}.docx"]["_body"] for i in range(5)] == [
        "COURT OF APPEAL\n\nWe affirm. See Poe v. Low, 1 So. 2d 3 (La. 1990).", texts[1], "", "\nx", "A"]
    assert rows["0.docx"]["citations"] == ["Poe v. Low, 1 So. 2d 3 (La. 1990)"]


def test_abbreviations_do_not_end_a_sentence(spark):
    text = "Reynolds v. Bordelon held so. See La. R.S. 9:1. Was it v.\nnew? Third v! Fourth."
    r = _fields(spark, [text], FIXTURE_LEXICON.with_terms(summary_sentences=9))["0.docx"]
    assert r["summary"] == "Reynolds v. Bordelon held so. See La. R.S. 9:1. Was it v. new. Third v. Fourth."


def test_summary_skips_blank_pieces(spark):
    text = ". " * 20 + "First one. Second one! Third one? Fourth."
    r = _fields(spark, [text], FIXTURE_LEXICON)["0.docx"]
    assert r["summary"] == "First one. Second one. Third one."


def test_template_braces_are_inert(spark):
    tpl = PromptTemplate(user="Case:\n{text}\nEnd {not_a_field}")
    assert tpl.render_user("a {b} c") == "Case:\na {b} c\nEnd {not_a_field}"
    df = spark.createDataFrame([("a {b} c",)], "text string")
    assert df.select(tpl.user_column(F.col("text"))).first()[0] == tpl.render_user("a {b} c")


def test_straight_quotes(spark):
    lex = FIXTURE_LEXICON.with_terms(quote_open='"', quote_close='"')
    text = 'Head\n*12 the court said "no such tort" and "again"\n"open only'
    r = _fields(spark, [text], lex)["0.docx"]
    assert [(q["quote"], q["page"]) for q in r["_quote_records"]] == [("no such tort", "12"), ("again", "12")]
    assert r["quotes"][0] == '"no such tort", at *12'


def test_missing_fields_told_from_text_and_citation(spark):
    caption = "Doe v. Roe, 100 So. 3d 5 (La. 1999)"
    texts = [None, "", "\n", "No caption. None.", caption, caption + "\nthtion thble. more thing.", "Court\n" + caption]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "filename string, text string")
    for lexicon in (FIXTURE_LEXICON, Lexicon()):
        f = RuleAnalyzer(lexicon).fields(docs)
        both = f.select(missing_fields().alias("m"), missing_without(F.col("text"), F.col("blue_book_citation")).alias("w"))
        assert all(r["m"] == r["w"] for r in both.collect())
