"""Quality rules: decision lists learned by sequential covering, applied as SQL conditions.

Per-text statistics are plain column expressions over the whole text. A rule is a
conjunction of thresholds on them. It is grown greedily (FOIL gain) on two thirds of the
labelled rows, pruned on the rest, and kept while it stays precise there; rows it covers
then leave the training set and the next rule is sought. Every step is one Spark
aggregate of labelled rows by (statistic, threshold bin), so all labelled rows take part
and only counts reach the driver. The finished list is an ordered ``CASE WHEN``.

Results for odd input: a null text has no words; a null label is not used for training;
without rows of both labels the list is empty and keeps everything; repeated rows count
as often as they occur; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import unit_interval, words

WINDOW = 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share",
            "words_per_line", "distinct_share", "top_line_share")


def with_repeated_words(df: DataFrame, hashed: str = "h") -> DataFrame:
    """Replace the array of word hashes by ``n_repeat_words``: words inside a five-word
    run that occurs twice or more.

    Runs are hashed to 64 bits. Only a text whose run hashes are not all distinct is
    sorted, with the position packed beside 40 bits of the hash (a primitive sort);
    neighbours are confirmed on the whole hash, and the covered words are summed as a
    union of intervals.
    """
    args = ", ".join(f"{hashed}[i + {j}]" for j in range(WINDOW))
    runs = (f"if(size({hashed}) <= {WINDOW}, cast(array() as array<bigint>), "
            f"transform(sequence(0, size({hashed}) - {WINDOW}), i -> xxhash64({args})))")
    df = df.withColumn("hs", F.expr(runs)).drop(hashed)
    same = ("(({0} & -16777216L) = ({1} & -16777216L) and "
            "get(hs, cast({0} & 16777215L as int)) = get(hs, cast({1} & 16777215L as int)))")
    packed = "array_sort(transform(hs, (h, i) -> (h & -16777216L) | cast(i as bigint)))"
    df = df.withColumn("ps", F.expr(f"if(size(array_distinct(hs)) = size(hs), cast(array() as array<bigint>), {packed})"))
    hit = (f"coalesce({same.format('v', 'get(ps, j - 1)')}, false) or "
           f"coalesce({same.format('v', 'get(ps, j + 1)')}, false)")
    starts = f"sort_array(transform(filter(ps, (v, j) -> {hit}), v -> cast(v & 16777215L as int)))"
    covered = (f"aggregate({starts}, struct(0L as n, 0 as upto), (a, s) -> struct("
               f"a.n + greatest(0, s + {WINDOW} - greatest(s, a.upto)) as n, s + {WINDOW} as upto), a -> a.n)")
    return df.withColumn("n_repeat_words", F.expr(f"if(size(ps) = 0, 0L, {covered})")).drop("hs", "ps")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts and the ten statistics that rules may test."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    d = d.select("doc_id", "t", F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("ls"))
    # the text is dropped here, then the words, then their hashes: each stage carries little
    d = d.select(
        "doc_id",
        (F.char_length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").alias("n_lines"),
        F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"),
        F.coalesce(F.array_max(F.transform("ls", lambda x: F.char_length(x))), F.lit(0)).alias("top_line"),
        F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("h"),
    )
    d = d.withColumn("n_words", F.size("h").cast("long")).withColumn("n_distinct", F.size(F.array_distinct("h")))
    d = with_repeated_words(d)
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_digits", "word_chars").alias("digit_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_words", "n_lines").alias("words_per_line"), share("n_distinct", "n_words").alias("distinct_share"),
        share("top_line", "word_chars").alias("top_line_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def conjunction(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects a row, and a row that none covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_no(self) -> Column:
        """1-based number of the first rule that covers the row, else null."""
        out = F.lit(None).cast("int")
        for i in reversed(range(len(self.rules))):
            out = F.when(conjunction(self.rules[i]), F.lit(i + 1)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def thresholds(rows: DataFrame, features, cuts: int) -> dict[str, list[float]]:
    """Cut points midway between neighbouring distinct quantiles of every statistic."""
    points = [i / (cuts + 1) for i in range(cuts + 2)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), points, 10000).alias(f) for f in features]).first()
    levels = {f: sorted(set(got[f] or [])) for f in features}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in levels.items()}


def bin_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Per statistic and bin (thresholds below the value): (bad, good) rows."""
    pairs = []
    for f, ts in cuts.items():
        if ts:
            value = F.col(f).cast("double")
            level = sum(((value > F.lit(t)).cast("int") for t in ts), F.lit(0))
            pairs.append(F.struct(F.lit(f).alias("f"), level.alias("b")))
    if not pairs:
        return {}
    found = (rows.select("bad", F.explode(F.array(*pairs)).alias("x")).groupBy("x.f", "x.b")
             .agg(F.sum("bad"), F.sum(1 - F.col("bad"))).collect())
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for f, b, bad, good in found:
        out.setdefault(f, {})[b] = (bad, good)
    return out


def best_condition(cuts, counts, bad: int, good: int) -> Condition | None:
    """The threshold of the highest FOIL gain over the rows counted, if any gains."""
    if not bad:
        return None
    before, best = math.log2(bad / (bad + good)), (1e-9, None)
    for f, by_bin in sorted(counts.items()):
        for i, t in enumerate(cuts[f]):
            p_low = sum(v[0] for b, v in by_bin.items() if b <= i)
            n_low = sum(v[1] for b, v in by_bin.items() if b <= i)
            for above, p, n in ((True, bad - p_low, good - n_low), (False, p_low, n_low)):
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                    best = (gain, Condition(f, above, t))
    return best[1]


def learn(labelled: DataFrame, features=FEATURES, max_rules: int = 6, max_conditions: int = 3, cuts: int = 24,
          min_precision: float = 0.95, min_covered: int = 5, seed: int = 42) -> DecisionList:
    """Sequential covering over rows ``(doc_id, features..., bad)`` with ``bad`` 1 or 0."""
    grow_part = unit_interval(F.lit(seed), "doc_id") < 2 / 3
    rows = labelled.filter("bad is not null").withColumn("grow", grow_part)
    found, edges = DecisionList(), thresholds(rows, features, cuts)
    for _ in range(max_rules):
        left = rows.filter(F.coalesce(found.rule_no(), F.lit(0)) == 0) if found.rules else rows
        conditions: tuple[Condition, ...] = ()
        while len(conditions) < max_conditions:
            counts = bin_counts(left.filter(F.col("grow") & conjunction(conditions)), edges)
            one = next(iter(counts.values()), {})
            bad, good = sum(v[0] for v in one.values()), sum(v[1] for v in one.values())
            if not bad or not good:
                break
            chosen = best_condition(edges, counts, bad, good)
            if chosen is None:
                break
            conditions += (chosen,)
        if not conditions:
            break
        held = left.filter(~F.col("grow"))
        sums = []
        for n in range(1, len(conditions) + 1):  # prune: drop the final conditions that do not pay
            hit = conjunction(conditions[:n])
            sums += [F.coalesce(F.sum(F.when(hit, F.col("bad"))), F.lit(0)), F.count_if(hit)]
        got = held.agg(*sums).first()
        scored = [((got[2 * n], got[2 * n + 1]), conditions[: n + 1]) for n in range(len(conditions))]
        (bad, covered), rule = max(scored, key=lambda s: ((2 * s[0][0] - s[0][1]) / max(1, s[0][1]), -len(s[1])))
        if covered < min_covered or bad < min_precision * covered:
            break
        found.rules.append(rule)
    return found


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics with ``base_failed``, ``rule_no`` and ``kept``."""
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule_no", rules.rule_no())
            .withColumn("kept", ~F.col("base_failed") & F.col("rule_no").isNull()))


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics of the labelled rows, ``bad`` where the label is 0.

    Rows that the base test already rejects are left out: the learned rules only decide
    on the others.
    """
    bad = F.when(F.col(label) == 0, 1).when(F.col(label) == 1, 0)
    known = labels.select(F.col("doc_id"), bad.alias("bad")).filter("bad is not null").distinct()
    return stats.filter(~base_failed()).join(known, "doc_id")

