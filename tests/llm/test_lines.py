import random

from docket.llm import lines


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows, min_words=5):
    """(kept, earliest) per (doc, line) by comparing every pair of lines."""
    every = [(d, i, tuple(x.encode().split())) for d, t in sorted(rows) for i, x in enumerate((t or "").split("\n"))]
    out = {}
    for d, i, ws in every:
        before = [(e, j) for e, j, o in every if ws and o and (e, j) < (d, i) and (
            o == ws or max(len(o), len(ws)) >= min_words and one_edit(list(o), list(ws)))]
        out[(d, i)] = (not before, min(before) if before else None)
    return out


def edited(rng, ws):
    ws = list(ws)
    at = rng.randrange(len(ws))
    kind = rng.randrange(3)
    if kind == 0:
        ws[at] = "edit"
    elif kind == 1:
        del ws[at]
    else:
        ws.insert(at, "put")
    return ws


def test_matches_brute_force(spark):
    rng = random.Random(11)
    stock = [[f"w{rng.randrange(40)}" for _ in range(rng.choice((1, 2, 4, 5, 6, 9, 30)))] for _ in range(60)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randrange(1, 8)):
            ws = list(rng.choice(stock))
            for _ in range(rng.randrange(3)):
                ws = edited(rng, ws) or ["one"]
            text.append((" \t" if rng.random() < 0.2 else " ").join(ws) if rng.random() < 0.95 else "  ")
        rows.append((d, "\n".join(text)))
    got = {(r.doc_id, r.line_no): (r.kept, (r.earliest_doc, r.earliest_line) if r.earliest_doc is not None else None)
           for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_texts_lose_dropped_lines_and_emptied_rows_go(spark):
    rows = [(1, "alpha beta gamma delta eps\nshort"), (2, "short\n\nunique line"), (3, "alpha beta gamma delta EPS"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_texts(df).collect()}
    assert got == {1: rows[0][1], 2: "\nunique line", 4: None}  # 3 is a near copy of a line of 1


def test_odd_rows(odd_docs, no_docs):
    decided = lines.dedup_lines(odd_docs).collect()
    assert len(decided) == sum(len((r.text or "").split("\n")) for r in odd_docs.collect())
    kept = lines.dedup_texts(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 0 and None in ids  # the null id comes first, so its copy of the text is the earliest
    assert {0, 1, 2} <= set(ids)  # texts without words are left alone
    assert lines.dedup_lines(no_docs).collect() == [] and lines.dedup_texts(no_docs).collect() == []


def test_similarity_one_keeps_near_copies(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "a  b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in lines.dedup_lines(df, similarity=1.0).collect()}
    assert got == {1: True, 2: True, 3: False}
