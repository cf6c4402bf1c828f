"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words. Two different lines are near copies if one word edit
(a word put in, taken out or replaced) turns one into the other and the longer has at
least ``1 / (1 - similarity)`` words (five for 0.8). A line with words is dropped when an
equal line or a near copy stands earlier in (id, text hash, line number) order.

* Equal lines meet first, in an aggregate, so everything after works on distinct lines.
* Lines one edit apart agree in their first or in their last half. Distinct lines that
  share no half with another are near copies of none and emit no variants (lossless).
* The others emit the hashes of all variants with one word deleted, and of themselves.
  The hash is an exclusive-or over (word, position), so all variants of a line come from
  running prefixes in linear time. Equal (variant, deleted position) means one word
  replaced; a variant equal to a whole line means one word put in or taken out. Both are
  found by minimum aggregates over the hash, never by pairing the members of a group.
* Every link found is verified on the words before it counts.

Results for odd input: lines without words are kept and never compared; a null text has
one line without words; a null id sorts first; rows equal in id and text are judged as
one; an empty table gives an empty table; other columns are ignored (or carried along,
in ``dedup_texts``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docket.llm.common import Scratch, words
from docket.sinks.tables import materialize


_POS = ("doc_id", "text_hash", "line_no")
# within a line, white space other than one blank between words holds one of these, or is at an end
_UNEVEN = ("  ", "\t", "\v", "\f", "\r")


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, line_no, norm)``: each line as its words with one blank between."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                    F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    even = F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    uneven = F.col("line").startswith(" ") | F.col("line").endswith(" ")
    for found in _UNEVEN:
        uneven = uneven | F.col("line").contains(found)
    return d.withColumn("norm", F.when(uneven, even).otherwise(F.col("line"))).drop("line")


def half_keys(min_words: int) -> str:
    """SQL: hashes of the halves that a near copy of the line must share one of."""
    def halves(k: str) -> str:
        return f"xxhash64(0, {k}, substring_index(norm, ' ', {k})), xxhash64(1, {k}, substring_index(norm, ' ', -{k}))"

    k, less = "(n div 2)", "((n - 1) div 2)"
    return (f"case when n < {min_words - 1} then cast(array() as array<bigint>) "
            f"when {k} = {less} then array({halves(k)}) else array({halves(k)}, {halves(less)}) end")


def text_lines(docs: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows, one per line: its place ``pos``, a 128-bit ``key`` of its words, its half keys."""
    d = split_lines(docs, id_col, text_col).withColumn(
        "n", F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    key = F.struct(F.xxhash64("norm").alias("a"), F.xxhash64(F.lit(1), "norm").alias("b"))
    return d.select(F.struct(*_POS).alias("pos"), F.when(F.col("norm") != "", key).alias("key"),
                    F.expr(half_keys(min_words)).alias("halves"))


def variants(candidates: DataFrame, min_words: int) -> DataFrame:
    """``(key, pos, variant, at)``: the line itself (at -1) and each one-word deletion."""
    lines = candidates.repartition("key").select(
        "key", "pos", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w"))
    order = W.partitionBy("key").orderBy("i")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here, moved = F.xxhash64("w", "i"), F.xxhash64("w", F.col("i") - 1)
    lines = lines.select(
        "key", "pos", "n", "i", F.bit_xor(here).over(whole).alias("all"),
        F.coalesce(F.bit_xor(here).over(before), F.lit(0)).alias("head"),
        F.bit_xor(moved).over(whole).bitwiseXOR(F.bit_xor(moved).over(upto)).alias("tail"))
    deleted = F.when(F.col("n") >= min_words, F.struct(F.col("head").bitwiseXOR(F.col("tail")).alias("variant"),
                                                       F.col("i").alias("at")))
    itself = F.when(F.col("i") == 0, F.struct(F.col("all").alias("variant"), F.lit(-1).alias("at")))
    return lines.select("key", "pos", F.explode(F.array_compact(F.array(deleted, itself))).alias("v")).select(
        "key", "pos", "v.*")


def near_links(docs: DataFrame, distinct: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """``(key, near)``: the earliest verified near copy before each of the distinct lines ``(key, pos, halves)``.

    ``docs`` has columns doc_id and text; it is read again for the words of the candidates alone.
    What is returned reads the tables of ``scratch``.
    """
    halves = distinct.select("key", "pos", F.explode("halves").alias("half"))
    # two keys differ in one of their numbers at least; numbers, unlike structs, are aggregated by hash
    shared = halves.groupBy("half").agg(*[f(f"key.{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "ab"])
    shared = shared.filter("min_a <> max_a or min_b <> max_b")
    wanted = halves.join(shared.select("half"), "half").select("key", "pos").distinct()
    wanted = wanted.groupBy("pos.doc_id", "pos.text_hash").agg(
        F.collect_set(F.struct("pos.line_no", "key")).alias("lines"))  # at most one text's lines
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", "text", F.xxhash64(text).alias("text_hash"))
    found = texts.join(wanted.withColumnsRenamed({"doc_id": "i", "text_hash": "h"}),
                       F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    found = found.select("doc_id", "text_hash", "lines", F.split(text, "\n", -1).alias("all"))
    found = found.select("doc_id", "text_hash", "all", F.explode("lines").alias("x")).select(
        F.struct("doc_id", "text_hash", "x.line_no").alias("pos"), "x.key", F.expr("all[x.line_no]").alias("line"))
    found = found.select("key", "pos", words(F.col("line")).alias("ws")).dropDuplicates(["key"])  # of repeated rows
    candidates = scratch.write(found, "line-candidates")
    emitted = scratch.write(variants(candidates, min_words), "line-variants")

    first = emitted.groupBy("variant", "at").agg(F.min(F.struct("pos", "key")).alias("first"), F.count("*").alias("n"))
    first = scratch.write(first, "line-firsts")
    replaced = emitted.join(first.filter("at >= 0 and n > 1").select("variant", "at", "first"), ["variant", "at"])
    by_variant = first.groupBy("variant").agg(
        F.min(F.when(F.col("at") < 0, F.col("first"))).alias("whole"),
        F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("cut")).filter("whole is not null and cut is not null")
    moved = emitted.join(by_variant, "variant").select(
        "key", "pos", "at", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("first"))
    found = replaced.select("key", "pos", "at", "first").unionByName(moved).filter("first.pos < pos")
    found = found.groupBy("key", F.col("first.key").alias("other")).agg(F.min("first.pos").alias("near"))

    mine, theirs = candidates.select("key", "ws"), candidates.select(F.col("key").alias("other"), F.col("ws").alias("os"))
    checked = found.join(mine, "key").join(theirs, "other").filter(one_edit("ws", "os"))
    return checked.groupBy("key").agg(F.min("near").alias("near"))


def one_edit(a: str, b: str):
    """Whether two different word arrays are one word edit apart: what follows the first
    difference must be equal, skipping one word of the longer array (or of both)."""
    # Index of the first difference; with arrays of different length it may be the shorter's end.
    differ = f"transform(arrays_zip({a}, {b}), z -> not (z.`{a}` <=> z.`{b}`))"
    i = f"(cast(array_position({differ}, true) as int))"  # 1-based, never 0 for different arrays
    rest = lambda x, skip: f"slice({x}, {i} + {skip}, size({x}))"
    return F.expr(f"case when size({a}) = size({b}) then {rest(a, 1)} = {rest(b, 1)} "
                  f"when size({a}) = size({b}) + 1 then {rest(a, 1)} = {rest(b, 0)} "
                  f"when size({b}) = size({a}) + 1 then {rest(b, 1)} = {rest(a, 0)} else false end")


def decide(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``(pos, key, first, near, kept)``; ``first`` is the earliest equal line."""
    min_words = max(2, math.ceil(1 / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 30
    lines = materialize(text_lines(docs, min_words, id_col, text_col), "lines")
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.write(
        lines.filter("key is not null").groupBy("key").agg(F.min("pos").alias("pos"), F.first("halves").alias("halves")),
        "lines-distinct")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    verdict = materialize(
        distinct.select("key", F.col("pos").alias("first")).join(near_links(slim, distinct, min_words, scratch), "key", "left"),
        "line-verdicts")
    scratch.drop()  # what follows reads lines and verdicts alone
    return lines.select("pos", "key").join(verdict, "key", "left").select(
        "pos", "key", "first", "near",
        (F.col("key").isNull() | ((F.col("pos") == F.col("first")) & F.col("near").isNull())).alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line_no, kept, earliest_doc, earliest_line, exact)`` for every line of every text."""
    found = decide(docs, similarity, id_col, text_col)
    equal = F.col("first") < F.col("pos")
    source = F.when(F.col("kept"), None).when(F.col("near").isNull(), F.col("first")).when(
        equal, F.least("first", "near")).otherwise(F.col("near"))
    return found.withColumn("of", source).select(
        "pos.doc_id", "pos.line_no", "kept", F.col("of.doc_id").alias("earliest_doc"),
        F.col("of.line_no").alias("earliest_line"),
        F.when(~F.col("kept"), F.col("of") == F.col("first")).alias("exact"))


def dedup_texts(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; all columns are carried along.

    A text that loses every line with words was made of earlier lines only; its row goes.
    """
    gone = decide(docs, similarity, id_col, text_col).filter(~F.col("kept"))
    gone = gone.groupBy("pos.doc_id", "pos.text_hash").agg(F.collect_set("pos.line_no").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("_gone").alias("gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the row travels as one struct, so no column name of the caller's can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("hash"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    out = out.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(left).alias("left"))
    wordless = F.col("gone").isNotNull() & ~F.col("left").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~wordless).select(
        *[F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
