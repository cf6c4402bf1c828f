"""Documents with planted legal phrases, which the driver's invented words never hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.sources.documents import spread, table

# Planted at line ends (``~`` is a line break): phrases of the default lexicon alone, together, wrapped,
# spaced out and in capitals, and near misses of each.
PLANTS = (
    "Spoliation is no independent tort here.",
    "The court does not recognize~this claim.",
    "We recognize that existing   remedies suffice.",
    "A disspoliation and spoliations were pleaded.",
    "An impairment of a~civil claim was alleged; no cause of action lies.",
    "Adequate remedies exist, and duplicative\trecovery would follow.",
    "It declined to recognize a STANDALONE TORT.",
    "They recognized the tort of spoliation.",
    "That is a tort, is a torte, this a tort.",
    "Intentional  Spoliation is a tort we recognized the tortuous way.",
    "No causes of action; no impairment of civil claims.",
    "Not recognized, not recognize, duplicative-recovery.",
)


def plant_sql(i: str) -> str:
    """SQL (Spark and DuckDB): the plant at the end of line ``i`` (from 0), or null on three lines in four."""
    whens = " ".join(f"when {k} then '{p}'" for k, p in enumerate(PLANTS))
    number = f"(doc_id % 1000003 * 5 + {i} * 7) % {len(PLANTS)}"
    return f"case when (doc_id + {i}) % 4 = 0 then replace(case {number} {whens} end, '~', chr(10)) end"


def pleaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(filename, doc_id, text)``: every document with plants at the ends of its lines."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = f"array_join(transform(split(text, '\\n', -1), (x, i) -> concat_ws(' ', x, {plant_sql('i')})), '\\n')"
    return d.select(F.expr("lpad(cast(doc_id as string), 9, '0') || '.docx'").alias("filename"), "doc_id", F.expr(lines).alias("text"))


PLEADED_DUCKDB_SQL = (
    "select doc_id, array_to_string(list_transform(string_split(text, chr(10)),"
    f" lambda x, i: concat_ws(' ', x, {plant_sql('(i - 1)')})), chr(10)) as text from documents"
)


# Planted sentences full of abbreviations; ``|`` marks a sentence end right after one of them and is not part of the text.
ABRIDGED = (
    "He moved to La.| The court then sat with La. App. judges on the case.",
    "Moss v. North was decided by the Cir. Ct. of La. in the spring.",
    "He paid Acme Co. the fee and Gale Co. the rest, and sued Beta Inc. and Hale Inc. for it.",
    "It was sold to Acme Co.| The fee was small, as it was for Beta Inc., too.",
    "See Dr. Hale and Dr. Moss on this, Art. 12 and Art. 2315 of the code.",
    "Cole v. Hale held so, and La. App. panels agree.| They cite Supp. 3 of it.",
    "They asked Beta Inc.| It paid, and they left La. by noon.",
    "The U.S. rule and the U.S. statute differ from La. practice under Art. 7, as they must.",
)


def abridged_sql(i: str) -> str:
    """SQL (Spark and DuckDB): the sentences planted at the end of line ``i``, with their marks."""
    whens = " ".join(f"when {k} then '{p}'" for k, p in enumerate(ABRIDGED))
    return f"case (doc_id % 1000003 * 3 + {i}) % {len(ABRIDGED) + 3} {whens} end"


def abridged(spark: SparkSession, sf_dir: str, marks: bool = False) -> DataFrame:
    """``(doc_id, text)``: every document with planted sentences at the ends of its lines."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plant = abridged_sql("i") if marks else f"replace({abridged_sql('i')}, '|', '')"
    text = F.expr(f"array_join(transform(split(text, '\\n', -1), (x, i) -> concat_ws(' ', x, {plant})), '\\n')")
    return d.select("doc_id", text.alias("text"))


ABRIDGED_DUCKDB_SQL = (
    "select doc_id, array_to_string(list_transform(string_split(text, chr(10)),"
    f" lambda x, i: concat_ws(' ', x, replace({abridged_sql('(i - 1)')}, '|', ''))), chr(10)) as text from documents"
)
