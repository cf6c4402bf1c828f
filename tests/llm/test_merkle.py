"""The manifest against a plain tree built level by level, and its SQL."""

import hashlib
import random
import zlib

import pytest

from docket.llm import merkle
from docket.llm.queries import op13_merkle_manifest
from docket.llm.sql import MERKLE_MANIFEST
from docket.testing import SF_SMALL, compare, duck

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """All levels of a tree, and every leaf's siblings."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(last[i:i + 3]) for i in range(0, len(last), 3)])
    witnesses = []
    for i in range(len(nodes)):
        found = []
        for level in levels[:-1]:
            start = i - i % 3
            found.append([(j, x) for j, x in enumerate(level[start:start + 3], start) if j != i])
            i //= 3
        witnesses.append(found)
    return levels[-1][0], witnesses


def refold(node, i, witness):
    for run in witness:
        both = sorted(run + [(i, node)])
        node, i = h(x for _, x in both), i // 3
    return node


def expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    placed = {s: sorted(rs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s, rs in by_source.items()}
    trees = {s: tree([leaf(r, r.text) for r in placed[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(placed[s]):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            witness = trees[s][1][i]
            folded = refold(refold(leaf(r, text), i, witness), k, tops[k])
            siblings = [x for run in witness + tops[k] for _, x in run]
            out.append((r.doc_id, leaf(r, r.text), trees[s][0], root, h(siblings), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 61])
def test_appender_and_fold(n):
    nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    one = merkle.Appender()
    for x in nodes:
        one.append(x)
    top, witnesses = tree([x.hex() for x in nodes])
    assert one.finish().hex() == top
    for i, (mine, want) in enumerate(zip(one.witness, witnesses)):
        assert mine.hex() == "".join(x for run in want for _, x in run)
        assert merkle.fold(nodes[i], i, n, bytes(mine)) == (bytes.fromhex(top), b"")


def test_partial_witnesses_grow_with_the_tree():
    one = merkle.Appender()
    seen = []
    for i in range(9):
        one.append(bytes([i]) * 32)
        seen.append(len(one.witness[0]) // merkle.WIDTH)
    assert seen == [0, 0, 2, 2, 2, 2, 2, 2, 4]  # a run is known when its last sibling is


@pytest.mark.parametrize("levels", [1, 2, 7])
@pytest.mark.parametrize("parts", [1, 5])
def test_whole_manifest(spark, levels, parts):
    """Blocks of three leaves make many rounds of appended block roots."""
    rng = random.Random(4)
    rows = [(i, f"s{min(9, int(rng.paretovariate(0.6)))}", rng.choice(["en", None]), i, "a\nb" * (i % 5)) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert got(merkle.verified_manifest(df, levels)) == expected(df.collect())


def test_odd_rows(spark, odd_docs, no_docs):
    assert got(merkle.verified_manifest(odd_docs, 2)) == expected(odd_docs.collect())
    assert merkle.verified_manifest(no_docs).collect() == []


def test_lone_leaf_and_null_source(spark):
    df = spark.createDataFrame([(7, None, None, None, None)], SCHEMA)
    (row,) = merkle.verified_manifest(df).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h([])
    assert row.leaf == hashlib.sha256(b"1:7----").hexdigest()


def test_tampering_is_found(spark):
    rows = op13_merkle_manifest(spark, SF_SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in docs[r.doc_id].text
        assert r.verified != changed and r.verified == (r.folded_root == r.root)


def test_sql(spark):
    ok, said = compare(op13_merkle_manifest(spark, SF_SMALL), duck(SF_SMALL), MERKLE_MANIFEST)
    assert ok, said
