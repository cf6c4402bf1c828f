import random

import xxhash

from docket.llm import simhash


def fingerprint(text, size=3):
    ws = (text or "").encode().lower().split()
    runs = [b" ".join(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points, bits):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_definition(odd_docs):
    got = {(r.doc_id, r.fingerprint) for r in simhash.fingerprints(odd_docs).collect()}
    want = {(r.doc_id, signed(fingerprint(r.text))) for r in odd_docs.collect()}
    assert got == want


def test_native_hash_agrees(spark):
    got = spark.sql("select xxhash64('ab cd ef') as h").first().h
    assert signed(int(simhash.shingle_hashes("AB cd\tEF", 3)[0])) == got


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    points = set(centers)
    for c in centers:
        for _ in range(6):
            x = c
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
            c = x if rng.random() < 0.5 else c
    points = [signed(p) for p in points]
    df = spark.createDataFrame([(p,) for p in points], "fingerprint long")
    for bits in (1, 3, 5):
        want = {p: r for p, r in roots(points, bits).items()}
        linked = {r.node: r.root for r in simhash.components(simhash.links(df, bits)).collect()}
        groups = lambda m: {frozenset(p for p in points if m.get(p, p) == r) for r in set(m.get(p, p) for p in points)}
        assert groups(linked) == groups(want), bits


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    of = {}
    for r in found:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[5] == of[6] == {5}  # copies and repeated rows
    assert of[0] == of[1] == of[2] == {0}  # null and wordless texts share fingerprint zero
    assert of[None] == {0, 5}  # null ids join their texts' groups
    assert simhash.near_duplicates(no_docs).collect() == []


def test_chain_of_links_is_one_component(spark):
    chain = [0]
    for b in range(0, 30, 3):
        chain.append(chain[-1] | 7 << b)
    df = spark.createDataFrame([(p,) for p in chain], "fingerprint long")
    got = simhash.components(simhash.links(df, 3)).collect()
    assert {r.root for r in got} == {0} and {r.node for r in got} == set(chain[1:])
