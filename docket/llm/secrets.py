"""Secret scans: a random forest removes false findings.

Candidates are runs of at least ``min_length`` token characters with a digit, and every
value given under a secret's name (``name = value``, ``"name": "value"``, ``name => value``,
``Authorization: Bearer value``), whatever its length and characters; a value ends at white
space, its quote, or, without quotes, a comma, semicolon or ampersand. Each is described by its length, its character transitions (mean log-probability under the
character pairs of the corpus dictionary, and class changes per character), the share of
it that dictionary words cover, and by what labelled findings say of its path and of the
words before and after it. The dictionary holds every letter run that the whole corpus has
``min_count`` times or more.

The forest is trained on a bounded sample of labelled findings. One fold of them gives the
rates of paths and neighbouring words, the other trains the forest on top, so no finding
sees its own label. All of it is DataFrame code; the forest is Spark's own.

Results for odd input: a null text has no candidates; a null path or a missing neighbour
counts as an unknown one; a null label is not used; without labels of both kinds every
candidate is kept, with a null probability; repeated rows give repeated findings; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import unit_interval, words
from docket.sinks.tables import materialize

TOKEN = "[A-Za-z0-9+/_-]"
# Words that name a secret before it is given.
SECRET_NAMES = ("token", "password", "passwd", "pwd", "secret", "apikey", "key", "credential", "auth")
FEATURES = ("length", "transitions", "class_changes", "coverage", "in_path", "path_rate", "before_rate", "after_rate")
_LETTERS, _CLASSES = "abcdefghijklmnopqrstuvwxyz", 28


def _name(name: str) -> str:
    """Regular expression for one name; not author, monkey or keyword."""
    if name == "auth":
        return "auth(?!or(?!iz))"
    if name == "key":
        return "(?:(?<![a-z])|(?<=api|access|secret|private|auth|signing|encryption))key(?!board|word|note|stone)"
    return name


_QUOTE = "[\"'`]"
# a name, a separator, perhaps a scheme, and the value (group 1), which ends in the last word
NAMED = (rf"(?i)(?:{'|'.join(map(_name, SECRET_NAMES))})[a-z0-9_-]*{_QUOTE}?\]?\s*(?:=>|:=|[=:])\s*{_QUOTE}?"
         rf"(?:(?:bearer|basic)\s+)?{_QUOTE}?(?!(?:bearer|basic)\b)(?![=>:])"
         r"((?<=[\"'`])[^\s\"'`]+|[^\s\"'`,;&]*[^\s\"'`,;&.:)\]}>])(?=\S*$)")


def candidates(docs: DataFrame, min_length: int = 16, id_col: str = "doc_id", text_col: str = "text",
               path_col: str = "source") -> DataFrame:
    """``(doc_id, path, word_no, run_no, run, named, lead, before, after)``; ``lead`` is the text just before the run.

    ``named`` tells a value given under a secret's name. One that is no run by itself has a
    negative ``run_no``, and stands for the runs inside it.
    """
    run = f"{TOKEN}{{{min_length},}}"
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"),
                    words(F.col(text_col).cast("string")).alias("ws"))
    given = " or ".join(f"instr({x}, '{c}') > 0" for x in ("w", "get(ws, i - 1)", "get(ws, i - 2)") for c in "=:")
    near = (f"filter(transform(ws, (w, i) -> if((length(w) >= {min_length} and w rlike '{run}') or {given}, named_struct("
            "'word_no', i, 'w', w, 'lead', concat_ws(' ', get(ws, i - 2), get(ws, i - 1)), 'next', get(ws, i + 1)), null)),"
            " x -> x is not null)")
    d = d.select("doc_id", "path", F.explode(F.expr(near)).alias("x")).select("doc_id", "path", "x.*")
    d = d.select("*", F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "lead", "w"), F.lit(NAMED), F.lit(1))).alias("vs"),
                 F.expr(f"filter(transform(regexp_extract_all(w, '{run}', 0), (r, k) -> struct(k as run_no, r as run)), "
                        "r -> r.run rlike '[0-9]')").alias("rs"))
    d = d.select("*", F.explode(F.expr(
        "concat(transform(filter(rs, r -> not exists(vs, v -> v <> r.run and contains(v, r.run))), "
        "r -> struct(r.run_no as run_no, r.run as run, array_contains(vs, r.run) as named)), "
        "transform(filter(vs, v -> not exists(rs, r -> r.run = v)), "
        "(v, k) -> struct(-1 - k as run_no, v as run, true as named)))")).alias("x")).select("*", "x.*")
    lead = F.concat_ws(" ", "lead", F.expr("substring(w, 1, instr(w, run) - 1)"))
    rest = F.concat_ws(" ", F.expr("substring(w, instr(w, run) + length(run))"), "next")
    return d.select("doc_id", "path", "word_no", "run_no", "run", "named", lead.alias("lead"),
                    F.regexp_extract(F.lower(lead), "([a-z]+)[^a-z]*$", 1).alias("before"),
                    F.regexp_extract(F.lower(rest), "([a-z]+)", 1).alias("after"))


def dictionary(docs: DataFrame, min_count: int = 3, text_col: str = "text") -> DataFrame:
    """``(word, n)``: lower-case letter runs of four or more that the corpus has often enough."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def char_classes(text: str) -> str:
    """SQL: letters 0 to 25, digits 26, anything else 27."""
    return (f"transform(split(lower({text}), ''), c -> case when locate(c, '{_LETTERS}') > 0 "
            f"then locate(c, '{_LETTERS}') - 1 when c between '0' and '9' then 26 else 27 end)")


def transition_logs(known: DataFrame) -> list[float]:
    """Base-2 logs of character transition probabilities over the dictionary, row by row."""
    pairs = (known.select("n", F.expr(char_classes("word")).alias("c"))
             .select("n", F.explode(F.expr(f"transform(sequence(0, size(c) - 2), i -> c[i] * {_CLASSES} + c[i + 1])")).alias("p"))
             .groupBy("p").agg(F.sum("n").alias("n")).collect())  # at most 28 x 28 rows
    counts = [1.0] * _CLASSES**2
    for p, n in pairs:
        counts[p] += n
    return [math.log2(counts[a * _CLASSES + b] / sum(counts[a * _CLASSES:(a + 1) * _CLASSES]))
            for a in range(_CLASSES) for b in range(_CLASSES)]


def describe(found: DataFrame, known: DataFrame) -> DataFrame:
    """Add the features that need no labels."""
    table = "array(" + ",".join(f"{x:.6f}D" for x in transition_logs(known)) + ")"
    pieces = found.select("run").distinct().select(
        "run", F.explode(F.expr("regexp_extract_all(lower(run), '[a-z]{4,}', 0)")).alias("word"))
    covered = pieces.join(known, "word", "left_semi").groupBy("run").agg(F.sum(F.length("word")).alias("covered"))
    kinds = F.expr("regexp_replace(regexp_replace(regexp_replace(run, '[A-Z]+', 'A'), '[a-z]+', 'a'), '[0-9]+', '9')")
    d = found.withColumn("c", F.expr(char_classes("run")))
    total = F.expr(f"aggregate(slice(sequence(0, size(c)), 1, size(c) - 1), 0D, (s, i) -> s + {table}[c[i] * {_CLASSES} + c[i + 1]])")
    d = d.withColumn("transitions", total / F.greatest(F.length("run") - 1, F.lit(1))).drop("c")
    return d.join(covered, "run", "left").select(
        *found.columns, F.length("run").cast("double").alias("length"), "transitions",
        (F.length(kinds) / F.length("run")).alias("class_changes"),
        (F.coalesce("covered", F.lit(0)) / F.length("run")).alias("coverage"),
        F.coalesce(F.col("lead").rlike(r"[/\\]") | F.col("run").contains("/"), F.lit(False)).cast("double").alias("in_path"))


def rates(labelled: DataFrame, column: str, prior: float, weight: float = 4.0) -> DataFrame:
    """Smoothed share of true findings by one column's values."""
    return labelled.groupBy(F.coalesce(column, F.lit("")).alias(column)).agg(
        ((F.sum("label") + F.lit(weight * prior)) / (F.count("*") + F.lit(weight))).alias(f"{column}_rate"))


def with_rates(found: DataFrame, fold: DataFrame, prior: float) -> DataFrame:
    for column in ("path", "before", "after"):
        table = rates(fold, column, prior).withColumnRenamed(column, "value")
        found = found.join(table, F.coalesce(column, F.lit("")) == F.col("value"), "left").drop("value").withColumn(
            f"{column}_rate", F.coalesce(f"{column}_rate", F.lit(prior)))
    return found


def assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(described: DataFrame, max_labelled: int = 20000, trees: int = 24, depth: int = 6, seed: int = 42):
    """The forest and the fold that gives rates, or None without labels of both kinds."""
    from pyspark.ml.classification import RandomForestClassifier

    draw = unit_interval(F.lit(seed), "doc_id", "word_no", "run_no", "run")
    sample = described.filter("label is not null").withColumn("draw", draw).orderBy("draw", "run").limit(max_labelled)
    sample = materialize(sample.withColumn("label", F.col("label").cast("double"))
                         .withColumn("fold", (F.floor(F.col("draw") * 1e6) % 2)), "secret-labels")
    counts = {f: (n, true) for f, n, true in sample.groupBy("fold").agg(F.count("*"), F.sum("label")).collect()}
    if len(counts) < 2 or any(true in (0, n) for n, true in counts.values()):
        return None
    prior = counts[0][1] / counts[0][0]
    fold, rest = sample.filter("fold = 0"), sample.filter("fold = 1")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features")
    return forest.fit(assembled(with_rates(rest, fold, prior)).select("features", "label")), fold, prior


def scan(docs: DataFrame, label: Column, min_length: int = 16, min_count: int = 3, threshold: float = 0.5,
         max_labelled: int = 20000, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         labelled_ids: DataFrame | None = None) -> DataFrame:
    """Findings with ``probability`` and ``kept``.

    ``label`` is 1, 0 or null per candidate row; ``labelled_ids`` (one id column) restricts
    labels to some documents.
    """
    from pyspark.ml.functions import vector_to_array

    known = materialize(dictionary(docs, min_count, text_col), "secret-dictionary")
    found = candidates(docs, min_length, id_col, text_col, path_col)
    if labelled_ids is not None:
        ids = labelled_ids.toDF("labelled").distinct().filter("labelled is not null")
        found = found.join(ids, F.col("doc_id") == F.col("labelled"), "left")
        found = found.withColumn("label", F.when(F.col("labelled").isNotNull(), label)).drop("labelled")
    else:
        found = found.withColumn("label", label)
    described = materialize(describe(found, known), "secret-candidates")
    trained = train(described, max_labelled)
    if trained is None:
        return described.withColumn("probability", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    forest, fold, prior = trained
    scored = forest.transform(assembled(with_rates(described, fold, prior)))
    scored = scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("kept", F.col("probability") >= threshold).drop("features", "rawPrediction", "prediction")


# Key forms that tell themselves: cloud ids, platform tokens and the parts of a JSON web token.
_KEYS = (r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(live|test)_\w{8,}"
         r"|xox[abeprs]-[\w-]{8,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{30,}|eyJ[\w-]{13,})$")
_PART = r"([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})"
# Numbers (cards, dates, times, with separators or without), and paths or compounds of words and short numbers.
_NUMBER = r"^[0-9]+([-/_+][0-9]+)*$|^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9]{2,6}Z?$"
_COMPOUND = rf"^[-/_+]*{_PART}([-/_+]+{_PART})+[-/_+]*$"
# What a name is given that is no value: an address, a variable, a call, or a plain word as after a colon in prose.
_OPEN = r"^[a-z][a-z0-9+]*://|^[$<{%(]|[(\[]"


def named_or_well_formed() -> Column:
    """A label for candidates whose form settles it, null for the others.

    1 for values given under a secret's name and for known key forms; 0 for numbers, dates,
    paths and compounds of words.
    """
    run, lead = F.col("run"), F.col("lead")
    prose = run.rlike("^[A-Za-z]+$") & lead.rlike(r":\s+$")
    given = (F.col("named") & ~run.rlike(_OPEN) & ~prose) | F.lower(lead).rlike(r"\bbearer\s+$")
    signature = lead.rlike(r"eyJ[\w-]+\.eyJ[\w-]+\.$")
    other = run.rlike(_NUMBER) | (run.rlike(_COMPOUND) & run.rlike("[A-Za-z]{3}"))
    return F.when(given | run.rlike(_KEYS) | signature, 1).when(other & ~F.col("named"), 0)
