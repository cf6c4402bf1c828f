"""Strict response validation (R12) and the result envelope.

``from_json`` is too lax for the contract (missing keys become null, numbers
become strings, null list elements pass), so each field is checked on the
parsed VARIANT: strings must be JSON strings, lists must be arrays whose every
element is a string. Extra keys are allowed and any level text is accepted --
the closed domains are enforced only by routing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.schema import ANALYSIS_FIELDS


def field_ok(v: Column, name: str, kind: str) -> Column:
    t = F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    if kind == "string":
        ok = t == "STRING"
    else:
        arr = F.try_variant_get(v, f"$.{name}", "array<string>")
        ok = t.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(arr, lambda x: x.isNull())
    return F.coalesce(ok, F.lit(False))


def parsed(response: Column) -> Column:
    return F.try_parse_json(response)


def extract(v: Column) -> Column:
    """The typed nine-field struct from a valid response."""
    return F.struct(
        *[
            F.try_variant_get(v, f"$.{n}", "string" if k == "string" else "array<string>").alias(n)
            for n, k in ANALYSIS_FIELDS
        ]
    )


def validate(responses: DataFrame, response: str = "response", error: str = "error") -> DataFrame:
    """R12 + R13: responses -> ``(filename, analysis, error, ...)`` envelopes.

    An earlier error (dead letter) is kept; a response failing validation gets
    ``analysis`` null and the reason as ``error``. The response is parsed once and
    each field check is computed once (own projection), then read by both the
    verdict and the reason.
    """
    keep = [c for c in responses.columns if c not in (response, error)]
    staged = responses.withColumn("_v", parsed(F.col(response)))
    v = F.col("_v")
    checks = [F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)).alias("_ok_object")]
    checks += [field_ok(v, name, kind).alias(f"_ok_{name}") for name, kind in ANALYSIS_FIELDS]
    staged = staged.select(*keep, error, "_v", *checks)
    good = F.col("_ok_object")
    for name, _ in ANALYSIS_FIELDS:
        good = good & F.col(f"_ok_{name}")
    reason = F.when(v.isNull(), F.lit("response is not valid JSON")).when(
        ~F.col("_ok_object"), F.lit("response is not a JSON object")
    )
    for name, kind in ANALYSIS_FIELDS:
        what = "a string" if kind == "string" else "a list of strings"
        reason = reason.when(~F.col(f"_ok_{name}"), F.lit(f"field {name} is missing or not {what}"))
    staged = staged.withColumn("_good", good)
    return staged.select(
        *keep,
        F.when(F.col(error).isNull() & F.col("_good"), extract(v)).alias("analysis"),
        F.when(F.col(error).isNotNull(), F.col(error))
        .when(~F.col("_good"), F.concat(F.lit("invalid response: "), reason))
        .alias("error"),
    )
