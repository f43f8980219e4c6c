"""SimHash near-dedup, exact dedup and fingerprints against brute force, and the cases their docstrings define."""

import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import exact_dedup, fingerprint, simhash
from plumbline.llm._kernels import U

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tur", "ve") for b in ("na", "ri", "so", "l") for c in ("", "n", "st", "dor", "pe")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, share):
    w = text.split()
    for k in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[k] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(rng.integers(60, 300))) for _ in range(150)]
    groups = list(range(150))
    for k in range(60):
        for _ in range(1 + k % 3):
            texts.append(edited(rng, texts[k], 0.02))
            groups.append(k)
    texts += [texts[3]] * 40
    groups += [3] * 40
    return texts, groups


def brute_pairs(texts):
    rows, sig, _ = simhash.signatures(pa.array(texts))
    d = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(axis=2)
    return rows, d


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2**63, (300, 4), dtype=np.int64).view(U)
    sig[50:90] = sig[10]
    sig[60:90, 0] ^= rng.integers(0, 2**40, 30, dtype=np.int64).view(U)
    d = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(axis=2)
    vertical = simhash.planes(sig)
    for radius in (0, 3, 20, 66, 120, 255):
        for q in (0, 10, 70, 299):
            assert simhash.near_one(sig[q], vertical, len(sig), radius).tolist() == np.flatnonzero(d[q] <= radius).tolist()
        i, j = np.triu_indices(300, 1)
        assert simhash.near_pairs(sig[i], sig[j], radius).tolist() == np.flatnonzero(d[i, j] <= radius).tolist()


def test_links_span_the_components_of_a_bucket():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.int64).view(U)
    sig = np.repeat(base, 60, axis=0)
    sig[:, 1] ^= U(1) << rng.integers(0, 60, 300).astype(U)
    a, b = simhash.links(sig, 10)
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        parent[root(x)] = root(y)
    assert len({root(x) for x in range(300)}) == 5


def test_near_duplicates_are_found_and_others_left(spark, corpus):
    texts, groups = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(docs).collect()}
    truth = {}
    for i, g in enumerate(groups):
        truth.setdefault(g, i)
    wanted = {i: truth[g] for i, g in enumerate(groups) if truth[g] != i}
    right = sum(found.get(i) == k for i, k in wanted.items())
    assert right >= 0.95 * len(wanted)
    assert all(i in wanted for i in found)
    # every linked document is within the radius of another of its group, and recall of pairs within the radius is at least 0.9
    rows, d = brute_pairs(texts)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if d[i, j] <= simhash.RADIUS]
    same = sum(found.get(i, i) == found.get(j, j) for i, j in near)
    assert same >= 0.9 * len(near)


def test_small_cells_give_the_same_groups(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus[0])), "doc_id long, text string")
    a = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert {tuple(r) for r in simhash.near_duplicates(docs, cell=3).collect()} == a


def test_near_dedup_cases(spark):
    long = prose(np.random.default_rng(3), 30_000)
    rows = [(1, "a b c d e f g h i j k l m n", "x"), (2, "a b c d e f g h i j k l m n", "y"), (None, "a b c d e f g h i j k l m n", "z"), (3, None, "x"), (4, "", "x"), (5, "!!! ...", "x"), (6, long, "x"), (7, long + " end", "x"), (6, long, "x"), (8, "一二三四五六七八九", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, plumbline_dropped_x string").withColumnsRenamed({"plumbline_dropped_x": "id"})
    assert sorted((r.doc_id, r.kept_doc_id) for r in simhash.near_duplicates(docs).collect()) == [(2, 1), (7, 6)]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (1, 3, 4, 5, 6, 6, 8)] + [(True, 0)]
    assert simhash.near_dedup(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("id", "plumbline_dropped").withColumnRenamed("plumbline_dropped", "PLUMBLINE_DROPPED")
    assert simhash.near_dedup(clash).columns == clash.columns


def test_exact_dedup_confirms_bytes(spark):
    from pyspark.sql import functions as F

    rows = [(5, "abc", 1), (2, "abc", 2), (None, "abc", 3), (7, "abd", 4), (8, None, 5), (9, None, 6), (3, "", 7), (4, "", 8), (2, "abc", 2), (11, "ABC", 1), (12, "abc ", 1), (13, "x" * 300_000, 1), (14, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int").withColumn("_row", F.lit("r"))
    for hash_fn in (exact_dedup.content_hash, lambda t: F.when(t.isNotNull(), F.unhex(F.lit("00")))):  # the second makes everything collide
        pairs = sorted((r.doc_id, r.kept_doc_id) for r in exact_dedup.exact_duplicates(docs, hash_fn=hash_fn).collect())
        assert pairs == [(4, 3), (5, 2), (14, 13)]
        kept = exact_dedup.exact_dedup(docs, hash_fn=hash_fn)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 8, 9, 11, 12, 13]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_fingerprints_against_brute_force(spark, corpus):
    texts = corpus[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.nearest_doc_id, r.difference) for r in fingerprint.nearest_digests(docs).collect()}
    codes, head = fingerprint.digests(pa.array(texts))
    step = np.array([0, 1, 2, 6])
    d = step[np.abs(codes[:, None].astype(int) - codes[None])].sum(axis=2)
    h = np.abs(head[:, None].astype(int) - head[None])
    d += np.where(h[..., 0] <= 1, h[..., 0], 12 * h[..., 0]) + np.minimum(h[..., 1:], 16 - h[..., 1:]).sum(axis=2)
    np.fill_diagonal(d, 10**6)
    for i in range(len(texts)):
        best = d[i].min()
        want = (int(np.flatnonzero(d[i] == best)[0]), int(best)) if best <= fingerprint.BOUND else (None, None)
        assert got[i] == want
    assert sum(v[0] is not None for v in got.values()) > 100
    assert {r.doc_id: (r.nearest_doc_id, r.difference) for r in fingerprint.nearest_digests(docs, cell=3).collect()} == got


def test_fingerprints_of_those_that_ask(spark, corpus):
    """Their nearest are those of the search for all, copies of what doesn't ask among them; all rows keep their digests."""
    docs = spark.createDataFrame(list(enumerate(corpus[0])), "doc_id long, text string")
    whole = {r.doc_id: r for r in fingerprint.nearest_digests(docs).collect()}
    for every, cell in ((20, 20_000), (20, 1), (3, 2)):
        got = {r.doc_id: r for r in fingerprint.nearest_digests(docs, cell=cell, asks=lambda i, e=every: i % e == 0).collect()}
        assert got.keys() == whole.keys() and all(got[k].digest == whole[k].digest for k in got)
        for k, r in got.items():
            assert (r.nearest_doc_id, r.difference) == ((whole[k].nearest_doc_id, whole[k].difference) if k % every == 0 else (None, None))
    assert sum(whole[k].nearest_doc_id is not None for k in whole if k % 20 == 0) > 5


def test_fingerprint_cases(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(1, t), (2, t), (3, t + "!"), (None, t), (4, None), (5, ""), (6, "short"), (1, t), (7, "z" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS d", "2 AS len")
    out = fingerprint.nearest_digests(docs)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.nearest_doc_id, r.difference) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    assert (False, 1, 2, 0) in got and (False, 2, 1, 0) in got and (True, 0, None, None) in got
    assert {(x[2], x[3]) for x in got if x[1] in (4, 5, 6, 7)} == {(None, None)}
    assert fingerprint.nearest_digests(docs.limit(0)).count() == 0


def test_most_edited_copies_find_their_original(spark):
    """Recall is held against copies that were edited, not against BOUND."""
    rng = np.random.default_rng(11)
    texts = [prose(rng, int(rng.integers(150, 500))) for _ in range(120)]
    for share, least in ((0.03, 0.9), (0.05, 0.8)):
        docs = spark.createDataFrame(list(enumerate(texts + [edited(rng, t, share) for t in texts])), "doc_id long, text string")
        got = {r.doc_id: r.nearest_doc_id for r in fingerprint.nearest_digests(docs).collect()}
        assert sum(got[k + 120] == k for k in range(120)) >= least * 120


def test_fingerprints_of_lengths_two_codes_apart(spark):
    """Two steps of length count 24, which is within the bound: such pairs are found across ranges and cells as well."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(40):
        block = prose(rng, int(rng.integers(40, 120))) + " "
        texts += [block * 10, block * 12]
    codes, head = fingerprint.digests(pa.array(texts))
    p = fingerprint.packed(codes)
    i, j = (x.ravel() for x in np.indices((80, 80)))
    d = fingerprint.difference(p[i], p[j], head[i], head[j]).reshape(80, 80)
    np.fill_diagonal(d, 10**6)
    want = {k: (int(d[k].argmin()), int(d[k].min())) if d[k].min() <= fingerprint.BOUND else (None, None) for k in range(80)}
    assert sum(v[1] is not None and v[1] >= 24 for v in want.values()) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cell in (3, fingerprint.CELL):
        assert {r.doc_id: (r.nearest_doc_id, r.difference) for r in fingerprint.nearest_digests(docs, cell=cell).collect()} == want


def test_ids_of_any_type(spark):
    rng = np.random.default_rng(5)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)) for _ in range(12)]
    texts = [t for t in base for _ in range(2)] + [base[0] + " tail", None, ""]
    names = {k: f"{k:04d}-x" for k in range(len(texts))}
    numbers = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = spark.createDataFrame([(names[k], t) for k, t in enumerate(texts)], "doc_id string, text string")
    for f in (simhash.near_duplicates, exact_dedup.exact_duplicates):
        want = sorted((names[r.doc_id], names[r.kept_doc_id]) for r in f(numbers).collect())
        assert sorted((r.doc_id, r.kept_doc_id) for r in f(words).collect()) == want and len(want) >= 12
    want = {names[r.doc_id]: (r.digest, names.get(r.nearest_doc_id), r.difference) for r in fingerprint.nearest_digests(numbers).collect()}
    assert {r.doc_id: (r.digest, r.nearest_doc_id, r.difference) for r in fingerprint.nearest_digests(words).collect()} == want
    assert simhash.near_dedup(words).count() == len(texts) - len(simhash.near_duplicates(numbers).collect())


def test_nothing_written_is_left_but_what_results_read(spark):
    from plumbline.llm import _shared

    docs = spark.createDataFrame([(k, f"some words of text {k % 3} and more of them") for k in range(9)], "doc_id long, text string")
    before = _shared.written_now()
    assert simhash.near_duplicates(docs).count() > 0
    left = _shared.written_now() - before
    assert len(left) == 1 and "stars" in next(iter(left))
    _shared.drop_paths(left)
    assert _shared.written_now() == before


def test_keys_meet_pairs_near_the_radius():
    """Of copies with many words replaced, those that are still within the radius, and of them the ones close to it."""
    rng = np.random.default_rng(11)
    base = [prose(rng, int(rng.integers(80, 400))) for _ in range(120)]
    copies = [edited(rng, t, float(rng.uniform(0.04, 0.2))) for t in base]
    _, a, ka = simhash.signatures(pa.array(base))
    _, b, kb = simhash.signatures(pa.array(copies))
    d = np.bitwise_count(a ^ b).sum(axis=1)
    met = (ka == kb).any(axis=1)
    near, edge = d <= simhash.RADIUS, (d > simhash.RADIUS - 20) & (d <= simhash.RADIUS)
    assert near.sum() > 40 and edge.sum() > 15
    assert met[near].mean() >= 0.9 and met[edge].mean() >= 0.9
