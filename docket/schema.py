"""Record schemas and the fixed domain values of the analysis contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the original tool's for the same routing.
RELEVANCE_LEVELS = ("High", "Medium", "Low")
SUPPORT_LEVELS = ("Strongly Supports", "Supports", "Does not Support")

# Nine analysis fields, in declaration order, with their kind.
ANALYSIS_FIELDS = (
    ("blue_book_citation", "string"),
    ("summary", "string"),
    ("relevance_level", "string"),
    ("reasoning", "string"),
    ("key_points", "list"),
    ("citations", "list"),
    ("quotes", "list"),
    ("argument", "string"),
    ("support_level", "string"),
)
STRING_FIELDS = tuple(n for n, k in ANALYSIS_FIELDS if k == "string")
LIST_FIELDS = tuple(n for n, k in ANALYSIS_FIELDS if k == "list")

ANALYSIS_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType() if k == "string" else T.ArrayType(T.StringType(), True), True)
        for n, k in ANALYSIS_FIELDS
    ]
)

DOCUMENT_SCHEMA = T.StructType(
    [T.StructField("filename", T.StringType(), False), T.StructField("text", T.StringType(), True)]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType(), False),
        T.StructField("analysis", ANALYSIS_SCHEMA, True),
        T.StructField("error", T.StringType(), True),
    ]
)

MESSAGE_SCHEMA = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
