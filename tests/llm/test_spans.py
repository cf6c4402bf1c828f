import hashlib
import random

import numpy as np

from docket.llm import spans


def test_span_equality_and_common_extension():
    rng = random.Random(1)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = a[40:120] + "".join(rng.choice("ab") for _ in range(200))
    pa, pb = spans.PrefixHash(a), spans.PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(300), rng.randrange(len(b)), rng.randrange(1, 40)
        inside = i + n <= len(a) and j + n <= len(b)
        assert spans.equal_spans(pa, i, pb, j, n) == (inside and a[i:i + n] == b[j:j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert spans.common_extension(pa, i, pb, j) == k
    hashes = pa.windows(7)
    assert [int(h) for h in hashes] == [pa.span(i, 7) for i in range(len(a) - 6)]
    assert len({int(h) for h in hashes}) == len({a[i:i + 7] for i in range(len(a) - 6)})
    assert spans.joined(pa.span(0, 100), 100, pb.span(0, 50)) == spans.PrefixHash(a[:100] + b[:50]).whole()


def test_likeness_is_the_jaccard_of_spans():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    other = base[:2000] + "".join(rng.choice("abcdefgh ") for _ in range(2000))
    size = 256
    sets = [{t[i:i + 24] for i in range(len(t) - 23)} for t in (base, other)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    least = [spans.sketch(spans.span_hashes(spans.PrefixHash(t), 24), size) for t in (base, other)]
    assert abs(spans.likeness(*least, size) - exact) < 0.1
    assert spans.likeness(least[0], least[0], size) == 1.0


def test_query_rows_match_definition(odd_docs, no_docs):
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd_docs.collect()))
    got = spans.fingerprints(odd_docs, bucket_chars=4000).collect()
    assert len(got) == len(rows)
    want = set()
    ids = [i for i, _ in rows]
    for n, (i, t) in enumerate(rows):
        if ids.count(i) > 1 or ids.count(ids[(n + 1) % len(rows)]) > 1:
            continue  # equal ids: their order is by hash
        follow = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + follow[:half]
        want.add((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), spans.fingerprint(t), spans.fingerprint(changed)))
    have = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got}
    assert want and want <= have
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert spans.fingerprints(no_docs).collect() == []


def test_order_does_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abc ") for _ in range(rng.randrange(300)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(spans.fingerprints(df, bucket_chars=1 << 30))
    assert one == key(spans.fingerprints(df.repartition(7), bucket_chars=500))
    follow = {i: rows[(n + 1) % len(rows)][1] for n, (i, _) in enumerate(rows)}
    for i, n, sha, *_ in one:
        t = dict(rows)[i]
        half = n // 2
        assert sha == hashlib.sha256((t[:n - half] + follow[i][:half]).encode()).hexdigest()


def test_single_document_follows_itself(spark):
    row = spans.fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0 and row.common_prefix == 3


def test_sketch_finds_the_least_distinct_values():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    repeated = np.concatenate((x, np.full(50000, x.max())))
    for values in (x, repeated, np.full(9000, np.uint64(5)), x[:3], x[:0]):
        assert spans.sketch(values, 32).tolist() == sorted(set(values.tolist()))[:32]
