"""Are the quotes of an answer in the text, and on the page given?

Text and quotes are compared as words without case or punctuation, star pages left out of the text.
A quote is ``found`` if its words stand in the text in a row, ``altered`` if at
least ``ALTERED`` of its runs of four words do, else ``missing``. A found quote's page is
``right`` if it begins where that page is in force (anywhere in the text), ``wrong`` if
not, ``none`` if the answer gives no page. All of it is per row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.text import STAR_PAGE

RUN = 4  # words of an anchor
ALTERED = 0.5
_SPAN = 3  # page breaks inside a quote whose page can still be told


def word_text(s: Column) -> Column:
    """Words in lower case with one blank between."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def _with(value: Column, then) -> Column:
    """``then(value)``, the value worked out once: an expression inside a lambda is evaluated per element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_runs(words: Column) -> Column:
    """All runs of ``RUN`` words of a word text (a shorter text is its own run)."""
    starts = lambda ws: F.sequence(F.lit(1), F.greatest(F.size(ws) - RUN + 1, F.lit(1)))
    return _with(F.split(words, " "), lambda ws: F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i, RUN), " ")))


def with_source(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what quotes are looked up in: ``_pages`` (word text and page of every stretch between star pages) and ``_whole``."""
    pages = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(F.col(text), F.lit(STAR_PAGE), 1))
    stretches = F.transform(F.split(F.col(text), STAR_PAGE, -1), word_text)
    df = df.withColumn("_stretches", stretches).withColumn("_page", pages)
    whole = F.concat(F.lit(" "), F.array_join(F.filter("_stretches", lambda x: x != ""), " "), F.lit(" "))
    df = df.withColumn("_whole", whole).withColumn("_pages", F.filter(F.arrays_zip("_stretches", "_page"), lambda x: x["_stretches"] != ""))
    # each stretch with those after it, for quotes that run over a page break
    following = F.transform("_pages", lambda x, i: F.struct(
        x["_page"].alias("page"), F.length(x["_stretches"]).alias("size"),
        F.concat(F.lit(" "), F.array_join(F.transform(F.slice("_pages", i + 1, _SPAN + 1), lambda y: y["_stretches"]), " "), F.lit(" ")).alias("words")))
    return df.withColumn("_pages", following).drop("_stretches", "_page")


def ground(df: DataFrame, quotes: str = "quotes", text: str = "text", out: str = "grounding") -> DataFrame:
    """Add ``out``: an array with one record per quote, ``(status, page, coverage)``; ``quotes`` is ``array<struct<quote, page>>``."""
    df = with_source(df, text)
    worded = F.transform(quotes, lambda q: F.struct(word_text(q["quote"]).alias("words"), q["page"].alias("page")))

    def looked_up(q, whole):
        found = F.contains(whole, F.concat(F.lit(" "), q["words"], F.lit(" "))) & (q["words"] != "")
        mine = F.when(~found & (q["words"] != ""), F.array_distinct(word_runs(q["words"])))
        return F.struct(q["words"], q["page"], found.alias("found"), mine.alias("runs"))

    df = df.withColumn("_asked", _with(F.col("_whole"), lambda whole: F.transform(worded, lambda q: looked_up(q, whole))))
    # the text's runs of words are needed only where a quote is not found as it is, and of them only those of such quotes
    missed = F.flatten(F.filter(F.transform("_asked", lambda q: q["runs"]), lambda r: r.isNotNull()))
    df = df.withColumn("_runs", F.when(F.exists("_asked", lambda q: q["runs"].isNotNull()), F.array_intersect(missed, word_runs(F.trim("_whole")))))

    def shared(q, runs):
        share = F.when(q["found"], 1.0).when(q["words"] == "", 0.0).when(
            q["runs"].isNotNull(), F.size(F.array_intersect(q["runs"], runs)) / F.size(q["runs"]))
        return F.struct(q["words"], q["page"], q["found"], share.alias("share"))

    df = df.withColumn("_asked", _with(F.col("_runs"), lambda runs: F.transform("_asked", lambda q: shared(q, runs))))

    def record(q, pages):
        begins = F.exists(pages, lambda p: (p["page"] == q["page"]) & F.instr(
            p["words"], F.concat(F.lit(" "), q["words"], F.lit(" "))).between(1, p["size"] + 1))
        return F.struct(
            F.when(q["found"], "found").when(q["share"] >= ALTERED, "altered").otherwise("missing").alias("status"),
            F.when(q["page"].isNull(), "none").when(q["found"] & begins, "right").when(q["found"], "wrong").alias("page"),
            q["share"].alias("coverage"))

    df = df.withColumn(out, _with(F.col("_pages"), lambda pages: F.transform("_asked", lambda q: record(q, pages))))
    return df.drop("_whole", "_pages", "_asked", "_runs")
