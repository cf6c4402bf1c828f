"""Sentence ends learned from the texts themselves (for E02, E05), in place of a list of abbreviations.

A word type (case kept) is an abbreviation when the texts say so:

* a period follows it far more often than it follows words at large: the log-likelihood ratio of
  "nearly always" against the share of all words, weighed down by the length of the type and up by
  periods inside it, after Kiss and Strunk (2006), reaches ``least_score``;
* at most one occurrence in five has no period;
* at most half of the words that follow its period are *starters*.

A starter is an upper-case word that the texts mostly write in lower case: its lower-case
occurrences are at least four times its upper-case ones inside sentences. All measures but the
first are shares, so a table says the same at every size.

The boundary rule looks at both sides. ``!`` and ``?`` end a sentence. A period after an ordinary
word ends it unless the next word is in lower case; a period after an abbreviation or a single
upper-case letter ends it only before a starter: ``in La. The court`` splits, ``La. App.`` does not.

Odd input: a null or blank text has no ends; U+0001 counts as a blank in counting; a text's last word is never listed (nothing follows
it); words that are no letters (``14.``) count as ordinary. ``key`` must tell the rows apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.sinks.tables import materialize

# These read the same in Java and RE2. Group 1: the type; group 2: its period.
WORD = r"^[\"“‘(\[]*(\p{L}(?:[\p{L}.'’-]*\p{L})?)([.]?)[,;:]?[\"”’)\]]*$"
STOP = r"[.!?][\"”’)\]]*$"
HARD_STOP = r"[!?][\"”’)\]]*$"
_OPENING = "\x01"  # put before words that follow a pause; a blank where a text holds it
PAUSE = r"[.!?:][\"”’)\]]*$"
LOWER_NEXT = r"^[\"“‘(\[]*\p{Ll}"
INITIAL = r"^\p{Lu}$"

LEAST_SCORE = 0.3
NEAR_ALWAYS = 0.99


def words_of(text: Column) -> Column:
    """The words of a text, cut at white space."""
    return F.array_remove(F.split(text, r"[ \t\r\n]+", -1), "")


def _type(word: Column) -> Column:
    return F.regexp_extract(word, WORD, 1)


def _stops(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per stop that a word follows: number, the word, the one after."""
    df = docs.select(*keep, words_of(F.col(text)).alias("_words"))
    places = F.when(F.size("_words") > 1, F.sequence(F.lit(0), F.size("_words") - 2)).otherwise(F.array().cast("array<int>"))
    at = F.filter(places, lambda i: F.get("_words", i).rlike(STOP))  # only stops become rows
    return df.select(*keep, F.inline(F.transform(at, lambda i: F.struct(
        i.cast("long").alias("word_no"), F.get("_words", i).alias("word"), F.get("_words", i + 1).alias("after")))))


def word_types(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per type: occurrences with and without a period, and those inside a sentence.

    Words after a pause are marked in the text, so that equal words are counted before any of
    them is looked at: the patterns run over distinct words.
    """
    plain = F.regexp_replace(F.replace(F.col(text), F.lit(_OPENING), F.lit(" ")), r"^[ \t\r\n]+", "")
    marked = F.regexp_replace(F.concat(F.lit(_OPENING), plain), r"([.!?:][\"”’)\]]*)[ \t\r\n]+", f"$1 {_OPENING}")
    words = docs.select(F.explode(F.split(marked, r"[ \t\r\n]+", -1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = words.select("n", F.col("word").startswith(_OPENING).alias("opens"), F.replace("word", F.lit(_OPENING), F.lit("")).alias("word"))
    # the type holds the word's first letter, so it stands nowhere before; the period is what follows it
    w = words.withColumn("type", _type(F.col("word"))).select("n", "opens", "type", F.col("word").substr(
        F.instr("word", F.col("type")) + F.length("type"), F.lit(1)).eqNullSafe(".").alias("dot"))
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return w.where(F.col("type") != "").groupBy("type").agg(
        number(F.col("dot")).alias("n_with"), number(~F.col("dot")).alias("n_without"), number(~F.col("opens")).alias("n_inside"))


def starters(types: DataFrame) -> DataFrame:
    """``type``: upper-case words that open sentences rather than name something."""
    n = F.col("n_with") + F.col("n_without")
    cases = types.groupBy(F.lower("type").alias("low")).agg(
        F.sum(F.when(F.col("type").rlike(r"^\p{Ll}"), n)).alias("n_lower"),
        F.sum(F.when(F.col("type").rlike(r"^\p{Lu}"), F.col("n_inside"))).alias("n_upper"))
    usual = cases.where(F.col("n_lower") >= 4 * F.coalesce("n_upper", F.lit(0))).select("low")
    upper = types.where(F.col("type").rlike(r"^\p{Lu}")).select("type", F.lower("type").alias("low"))
    return upper.join(usual, "low").select("type")


def _score(p: float) -> tuple[Column, Column]:
    """Log-likelihood ratio and weighed score of a type, ``p`` being the share of words with a period."""
    p = min(max(p, 1e-9), 0.98)
    k, rest = F.col("n_with").cast("double"), F.col("n_without").cast("double")
    ratio = 2.0 * (k * (math.log(NEAR_ALWAYS) - math.log(p)) + rest * (math.log(1 - NEAR_ALWAYS) - math.log(1 - p)))
    letters = F.length(F.regexp_replace("type", "[.]", ""))
    return ratio, ratio * F.exp(-letters.cast("double")) * (1 + F.length("type") - letters)


class SentenceModel:
    """What the texts say of abbreviations: ``abbreviations`` (with figures) and ``pairs`` (abbreviation, next word)."""

    def __init__(self, abbreviations: DataFrame, pairs: DataFrame):
        self.abbreviations, self.pairs = abbreviations, pairs


def learn(docs: DataFrame, text: str = "text", least_score: float = LEAST_SCORE) -> SentenceModel:
    """Two passes of map-side combined counts over all texts; what they leave is written."""
    types = materialize(word_types(docs, text), "sentence_types")
    n_with, n_without = types.agg(F.coalesce(F.sum("n_with"), F.lit(0)), F.coalesce(F.sum("n_without"), F.lit(0))).first()
    ratio, score = _score(n_with / max(n_with + n_without, 1))
    suspects = materialize(types.select("*", ratio.alias("ratio"), score.alias("score")).where(
        (F.col("score") >= least_score) & (F.col("n_with") >= 4 * F.col("n_without"))), "sentence_suspects")

    # only stops after suspects and initials are counted; the written suspects are few, and joined before the counts
    known = suspects.select("type", F.lit(True).alias("suspect"))
    stops = _stops(docs, text).select(_type(F.col("word")).alias("type"), "after").where(F.col("type") != "")
    counted = stops.join(known, "type", "left").where(F.col("suspect") | F.col("type").rlike(INITIAL))
    counted = counted.groupBy("type", "suspect", "after").agg(F.count("*").alias("n"))
    pairs = counted.groupBy("type", "suspect", _type(F.col("after")).alias("next_type")).agg(F.sum("n").alias("n"))
    opening = starters(types).select(F.col("type").alias("next_type"), F.lit(True).alias("starts"))
    pairs = materialize(pairs.join(opening, "next_type", "left").fillna({"starts": False}), "sentence_pairs")

    shares = pairs.where("suspect").groupBy("type").agg(
        F.sum("n").alias("n_followed"), F.sum(F.when(F.col("starts"), F.col("n")).otherwise(0)).alias("n_starts"))
    abbreviations = materialize(
        suspects.join(shares, "type", "left").fillna(0, ["n_followed", "n_starts"]).where(
            2 * F.col("n_starts") <= F.col("n_followed")).drop("n_inside", "score"), "sentence_abbreviations")
    chosen = abbreviations.select("type", F.lit(True).alias("learned"))
    decided = pairs.select("type", "next_type", "starts").join(chosen, "type", "left").where(
        F.col("learned") | F.col("type").rlike(INITIAL)).drop("learned")
    return SentenceModel(abbreviations, materialize(decided, "sentence_decisions"))


def sentence_ends(docs: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every ``.``, ``!`` or ``?`` that another word follows: key, word_no, word, after, abbreviation, ends.

    One join on (type, next word) against the decisions, a written table: small ones are
    broadcast by the adaptive plan, and a hot pair is split by it.
    """
    stops = _stops(docs, text, key).select(
        key, "word_no", "word", "after", _type(F.col("word")).alias("type"), _type(F.col("after")).alias("next_type"))
    found = stops.join(model.pairs, ["type", "next_type"], "left")
    soft = ~F.col("word").rlike(HARD_STOP)
    abbreviation = soft & F.col("starts").isNotNull()
    return found.select(
        key, "word_no", "word", "after", abbreviation.alias("abbreviation"),
        F.when(~soft, True).when(abbreviation, F.col("starts")).otherwise(~F.col("after").rlike(LOWER_NEXT)).alias("ends"))


def learned_sentences(docs: DataFrame, model: SentenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sentences)``: every row's text cut at its sentence ends, words one space apart."""
    ends = sentence_ends(docs, model, key, text).where("ends").groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.col("word_no").cast("int") + 1)).alias("_ends"))
    df = docs.select(key, words_of(F.col(text)).alias("_words")).join(ends, F.col(key) == F.col("_key"), "left")
    df = df.select(key, "_words", F.concat(F.coalesce("_ends", F.array().cast("array<int>")), F.array(F.size("_words"))).alias("_ends"))
    cuts = F.transform("_ends", lambda e, i: F.array_join(F.slice(
        "_words", F.when(i > 0, F.get("_ends", i - 1)).otherwise(0) + 1, e - F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)), " "))
    return df.select(key, F.when(F.size("_words") > 0, cuts).otherwise(F.array().cast("array<string>")).alias("sentences"))
