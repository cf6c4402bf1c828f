"""Document tables: Parquet text tables and the derived ``cases`` view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Session setting: tasks to deal a text table over after its scan (unset: the scan's own splits).
SCAN_TASKS = "docket.scan.tasks"


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal the rows out over ``tasks`` tasks, or leave them in the scan's splits (the default).

    For a table stored as one large row group, which scans as one task. It is the
    caller's choice, by argument or :data:`SCAN_TASKS`, and nothing about the data
    decides it: a table of many splits is best left alone.
    """
    tasks = tasks or int(df.sparkSession.conf.get(SCAN_TASKS, "0"))
    return df.repartition(tasks) if tasks else df


def filename_of(doc_id: Column) -> Column:
    """Stable file name for a document id: zero-padded id with the document suffix."""
    return F.concat(F.lpad(doc_id.cast("string"), 9, "0"), F.lit(".docx"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pre-extracted input: ``(filename, doc_id, text)``."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(filename_of(F.col("doc_id")).alias("filename"), "doc_id", "text")


# The case header planted on every document whose id is not a multiple of 17.
_HEAD = (
    "case when doc_id % 17 = 0 then 'Untitled' else concat('Doe', doc_id, ' v. Roe, ', 100 + doc_id % 200,"
    " ' So. 3d ', 1 + doc_id % 900, ' (La. ', 1990 + doc_id % 35, ')') end"
)
# A cited case appended to every seventh line (i % 7 = 6).
_SEE = (
    "concat(' See Doe', (doc_id * 7 + i) % 1000, ' v. Roe, ', 100 + (doc_id + i) % 200, ' So. 2d ',"
    " 1 + (doc_id * 3 + i) % 900, ' (La. ', 1990 + (doc_id + i) % 35, ').')"
)

# Every fourth document has a court header above the caption.
_COURT = "case when doc_id % 4 = 1 then 'COURT OF APPEAL' || chr(10) else '' end"


def _quoted(i: str) -> str:
    """Every fifth line opens a quote: it ends with the line, a star page may follow it, or it ends a line later."""
    return (
        f"case when {i} % 5 = 3 then concat('“', x, case (doc_id + {i}) % 3 when 0 then ''"
        f" when 1 then concat('” *', 700 + {i}) else '”' end)"
        f" when {i} % 5 = 4 and (doc_id + {i}) % 3 = 1 then concat(x, '”') else x end"
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as case opinions: citation header, star pages, quotes, cited cases.

    Same rows as :data:`CASES_DUCKDB_SQL` on the oracle side.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.selectExpr(
        "lpad(cast(doc_id as string), 9, '0') || '.docx' as filename",
        "doc_id",
        f"""concat({_COURT}, {_HEAD}, '\\n', array_join(transform(split(text, '\\n', -1), (x, i) -> concat(
    case when i % 3 = 2 then concat('*', 600 + doc_id % 20 + i, ' ') else '' end,
    {_quoted('i')},
    case when i % 7 = 6 then {_SEE} else '' end)), '\\n')) as text""",
    )


_SEE_DUCK = _SEE.replace("(doc_id * 7 + i)", "(doc_id * 7 + (i - 1))").replace("(doc_id + i)", "(doc_id + (i - 1))").replace(
    "(doc_id * 3 + i)", "(doc_id * 3 + (i - 1))"
)

CASES_DUCKDB_SQL = f"""
select lpad(doc_id::varchar, 9, '0') || '.docx' as filename, doc_id,
  {_COURT} || {_HEAD} || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(
    case when (i - 1) % 3 = 2 then concat('*', 600 + doc_id % 20 + (i - 1), ' ') else '' end,
    {_quoted('(i - 1)')},
    case when (i - 1) % 7 = 6 then {_SEE_DUCK} else '' end)), chr(10)) as text
from documents
"""
