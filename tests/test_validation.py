"""Strict validation (R12) on the malformed-response corpus of FIXTURES.md section 5."""

import json

import pytest

from docket.operators.infer import check_response
from docket.operators.validate import validate

OK = {
    "blue_book_citation": "Doe v. Roe, 1 So. 3d 2 (La. 2001)",
    "summary": "s",
    "relevance_level": "High",
    "reasoning": "r",
    "key_points": ["k"],
    "citations": ["c"],
    "quotes": ["q"],
    "argument": "a",
    "support_level": "Supports",
}


def _with(**kw):
    d = dict(OK)
    for k, v in kw.items():
        if v is _DROP:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


_DROP = object()
ok_text = json.dumps(OK)

# (shape, response text, valid in Spark)
SHAPES = [
    ("ok", ok_text, True),
    ("empty list", _with(key_points=[]), True),
    ("empty string", _with(summary=""), True),
    ("extra key", _with(extra=1), True),
    ("out-of-domain level", _with(relevance_level="high "), True),
    ("date-like string", _with(summary="2024-01-01"), True),
    ("duplicate key", ok_text[:-1] + ', "summary": "again"}', False),
    ("missing key", _with(argument=_DROP), False),
    ("top-level array", "[" + ok_text + "]", False),
    ("null string", _with(summary=None), False),
    ("number for string", _with(summary=5), False),
    ("string for list", _with(key_points="a"), False),
    ("null element", _with(citations=["x", None]), False),
    ("number element", _with(quotes=["q", 3]), False),
    ("nested list", _with(key_points=[["a"]]), False),
    ("not JSON", "not json", False),
    ("empty text", "", False),
    ("truncated JSON", ok_text[:40], False),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(f"f{i}.docx", s, None) for i, (_, s, _) in enumerate(SHAPES)]
    df = spark.createDataFrame(rows, "filename string, response string, error string")
    out = validate(df).collect()
    return {r["filename"]: r for r in out}


@pytest.mark.parametrize("i", range(len(SHAPES)))
def test_shape_verdict(verdicts, i):
    name, _, valid = SHAPES[i]
    r = verdicts[f"f{i}.docx"]
    assert (r["analysis"] is not None) == valid, name
    if not valid:
        assert r["error"].startswith("invalid response: ")


def test_valid_record_is_typed(verdicts):
    a = verdicts["f0.docx"]["analysis"]
    assert a["key_points"] == ["k"] and a["support_level"] == "Supports"


@pytest.mark.parametrize("i", range(len(SHAPES)))
def test_in_task_check_agrees(i):
    name, text, valid = SHAPES[i]
    try:
        check_response(text)
        py_valid = True
    except Exception:
        py_valid = False
    assert py_valid == valid, name


def test_dead_letter_error_is_kept(spark):
    df = spark.createDataFrame([("a.docx", None, "Failed after 1 retries: boom")],
                               "filename string, response string, error string")
    r = validate(df).first()
    assert r["analysis"] is None and r["error"] == "Failed after 1 retries: boom"
