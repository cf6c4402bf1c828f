"""Response-shape corpus for strict validation, as SQL usable by Spark and DuckDB.

Shape ``doc_id % 17`` picks one of the malformed-response kinds below (the
duplicate-key kind is left to a unit test: the two engines disagree on it).
"""

from __future__ import annotations

# Shape names in index order (fixed test vocabulary).
SHAPES = (
    "ok", "empty_list", "empty_string", "extra_key", "level_out_of_domain", "date_like",
    "missing_key", "top_level_array", "null_string", "number_for_string", "string_for_list",
    "null_element", "number_element", "nested_list", "not_json", "empty_text", "truncated",
)
VALID_SHAPES = {"ok", "empty_list", "empty_string", "extra_key", "level_out_of_domain", "date_like"}


def _obj(fields: list[tuple[str, str]]) -> str:
    parts = []
    for i, (k, v) in enumerate(fields):
        parts.append(("'{" if i == 0 else "', ") + f'"{k}": ' + "' || " + v + " || ")
    return "".join(parts) + "'}'"


def response_sql(dialect: str) -> str:
    """CASE expression over ``doc_id`` and ``text`` building one response string."""
    sha = "sha2(text, 256)" if dialect == "spark" else "sha256(text)"
    sid = "cast(doc_id as string)" if dialect == "spark" else "cast(doc_id as varchar)"
    s = lambda x: "'\"' || " + x + " || '\"'"  # noqa: E731  JSON string of a safe SQL value
    base = [
        ("blue_book_citation", s(f"'Doe' || {sid} || ' v. Roe'")),
        ("summary", s(sha)),
        ("relevance_level", s("'High'")),
        ("reasoning", s("'r'")),
        ("key_points", "'[' || " + s(f"substr({sha}, 1, 8)") + " || ']'"),
        ("citations", "'[]'"),
        ("quotes", "'[\"q\"]'"),
        ("argument", s("'a'")),
        ("support_level", s("'Supports'")),
    ]

    def with_(**kw):
        out = [(k, kw.get(k, v)) for k, v in base if kw.get(k, v) is not None]
        return out

    ok = _obj(base)
    cases = {
        "ok": ok,
        "empty_list": _obj(with_(key_points="'[]'")),
        "empty_string": _obj(with_(summary="'\"\"'")),
        "extra_key": _obj(base + [("confidence", "'0.9'")]),
        "level_out_of_domain": _obj(with_(relevance_level=s("'high '"))),
        "date_like": _obj(with_(summary=s("'2024-01-01'"))),
        "missing_key": _obj([(k, v) for k, v in base if k != "argument"]),
        "top_level_array": "'[' || " + ok + " || ']'",
        "null_string": _obj(with_(summary="'null'")),
        "number_for_string": _obj(with_(summary="'5'")),
        "string_for_list": _obj(with_(key_points=s("'a'"))),
        "null_element": _obj(with_(citations="'[\"x\", null]'")),
        "number_element": _obj(with_(quotes="'[\"q\", 3]'")),
        "nested_list": _obj(with_(key_points="'[[\"a\"]]'")),
        "not_json": "'not json'",
        "empty_text": "''",
        "truncated": f"substr({ok}, 1, 40)",
    }
    whens = " ".join(f"when {i} then {cases[name]}" for i, name in enumerate(SHAPES))
    return f"case doc_id % {len(SHAPES)} {whens} end"
