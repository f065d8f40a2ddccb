"""Exact dedup, n-gram join and embedding dedup against brute force, with the hard rows of each."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, exact_dedup, ngram_join
from lodestone.llm.components import components

DOCS = "doc_id long, text string, keep_id string, digest string, bands string"


def docs(spark, rows):
    """Rows with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def groups_of(links, nodes):
    root = {}
    for n in sorted(nodes):
        if n in root:
            continue
        stack = [n]
        root[n] = n
        while stack:
            for m in links.get(stack.pop(), ()):
                if m not in root:
                    root[m] = n
                    stack.append(m)
    return root


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    made = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    links = {}
    for a, b in pairs:
        if a is not None and b is not None:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert made == {n: r for n, r in groups_of(links, links).items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = [(0, i) for i in range(1, 900)] + [(i, 5000 + i) for i in range(1, 900, 7)]
    assert {r.component for r in components(spark.createDataFrame(star, "u long, v long").repartition(8)).collect()} == {0}


def test_exact(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "abc"), (7, "abc"), (7, "abc"), (8, "x" * 100_000)] + [(100 + i, "hot") for i in range(500)]
    got = exact_dedup.exact_groups(docs(spark, rows), support=0.01).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = {}
    for i, t in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        want.setdefault(key, []).append(i)
    for r in got:
        key = next(k for k in want if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        top = max((i for i in want[key] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(want[key]), r.doc_id == top)
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "digest", "bands"] and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 599]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0 and exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0


def brute_jaccard(rows, threshold=0.8, n=5):
    sets = {}
    for i, t in rows:
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


def test_ngram_join(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(30, 120)))]
        for edits in rng.integers(0, 9, int(rng.integers(1, 12))):
            t = list(base)
            for at in rng.integers(0, len(t), edits):
                t[at] = word()
            rows.append((k, " ".join(t)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "..."), (k + 3, "one two"), (k + 4, "One, two!"), (k + 5, "one two three four five"), (k + 6, "w " * 60_000)]
    links = brute_jaccard(rows[:-1]) | {k + 6: set()}
    root = groups_of(links, links)
    for block in (4, 256):  # blocks of a cluster give the same as a whole one
        got = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, rows), block=block).collect()}
        assert {i: (r.n_links, r.class_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), root[i], root[i] == i) for i, _ in rows}
    assert got[k + 4].set_id == k + 3
    kept = ngram_join.drop_near_duplicates(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns[0] == "doc_id"


def test_ngram_join_odd_rows(spark):
    got = ngram_join.jaccard_join(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here alone now")])).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=repr) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (None, 0, None)]
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0
    assert len(ngram_join.drop_near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f")])).collect()) == 1


NEAR = "the quick brown fox jumps over the lazy dog and then runs home to its own den in the dark green wood at night when all is still"
FAR = "every morning a small boat leaves the old harbour with nets ropes and bread for the men who fish until noon far out at sea"


def test_repeated_ids_keep_their_own_texts(spark):
    """Links by row, and no text is lost with another one of its id."""
    near, far = NEAR.replace("still", "calm"), FAR.replace("at sea", "at bay")
    rows = [(1, NEAR), (1, FAR), (7, near), (8, far)]
    got = sorted((r.doc_id, r.n_links, r.class_id) for r in ngram_join.jaccard_join(docs(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (7, 1, 1), (8, 1, 1)]
    rows = [(3, NEAR), (5, NEAR), (5, FAR), (7, near), (8, far), (9, "one other text stands alone here"), (9, "one other text stands alone here"), (9, None), (9, ""), (None, NEAR), (4, "x")]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(docs(spark, rows)).collect()), key=repr)
    assert kept == sorted([(3, NEAR), (5, FAR), (9, "one other text stands alone here"), (9, None), (9, ""), (None, NEAR), (4, "x")], key=repr)


def test_large_clusters_go_by_buckets(spark):
    """A chain of texts that share ever fewer shingles, and a group of near copies, with blocks far smaller than either."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in rng.integers(0, 10_000, 900)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(120)]
    rows += [(1000 + k, " ".join([*words[:60], f"x{k}", *words[60:100]])) for k in range(60)]
    links = brute_jaccard(rows)
    root = groups_of(links, links)
    for block in (7, 1000):
        got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.jaccard_join(docs(spark, rows), block=block).collect()}
        assert got == {i: (len(links[i]), root[i]) for i, _ in rows}


def test_banding():
    b = ngram_join.choose_banding()
    assert b.recall(0.8) >= 0.9999 and b.bands * b.rows <= ngram_join.MOST_HASHES
    rng = np.random.default_rng(2)
    hasher, hits = ngram_join.MinHasher(b), 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 80, np.uint64), rng.integers(0, 1 << 63, (2, 10), np.uint64)
        x, y = (hasher.bands(np.unique(np.concatenate([common, o]))) for o in own)
        hits += bool((x == y).any())
    assert hits == 300


def test_banding_of_small_sets():
    """Sets of five shingles, four of them common: theory misses 1.5 of 20,000 pairs."""
    b = ngram_join.choose_banding()
    rng, hasher = np.random.default_rng(6), ngram_join.MinHasher(b)
    sets = rng.integers(0, 1 << 63, (20_000, 5), np.uint64)
    missed = sum(not (hasher.bands(s[:4]) == hasher.bands(s)).any() for s in sets)
    assert missed <= 20_000 * (1 - b.recall(0.8)) + 6


def test_banding_of_long_sets(spark):
    """A set of 2,000 shingles and the least 1,700 or any 1,700 of them share a band; so do the texts, at all lengths, in the join."""
    b = ngram_join.choose_banding()
    rng, hasher = np.random.default_rng(8), ngram_join.MinHasher(b)
    for _ in range(40):
        s = np.unique(rng.integers(0, 1 << 63, 2_000, np.uint64))
        for part in (s[:1_700], s[np.sort(rng.permutation(len(s))[:1_700])]):
            assert (hasher.bands(part) == hasher.bands(s)).any()
    words = [f"w{i}" for i in rng.integers(0, 100_000, 3_000)]
    rows = [(10 * n + k, f"t{n} " + " ".join(words[:m])) for n in (130, 600, 2_500) for k, m in enumerate((n, int(n * 0.85)))]
    links = brute_jaccard(rows)
    assert sum(map(len, links.values())) == 6
    assert {r.doc_id: r.n_links for r in ngram_join.jaccard_join(docs(spark, rows)).collect()} == {i: len(x) for i, x in links.items()}


def test_pipeline_drops_long_near_copies(spark):
    """The pipeline's stage keeps one of a long text and 85 % of it, at lengths of more than 128 shingles."""
    import corpus_pipeline

    words = [f"w{i}" for i in np.random.default_rng(11).integers(0, 100_000, 3_000)]
    rows = [(10 * n + k, f"t{n} " + " ".join(words[:m])) for n in (1_200, 2_800) for k, m in enumerate((n, int(n * 0.85)))]
    assert sorted(r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs(spark, rows), "").collect()) == [12_000, 28_000]


@pytest.mark.parametrize("most", [0, 250_000])
def test_components_by_rounds_and_by_driver(spark, monkeypatch, most):
    """The same components either way, and few links take few jobs."""
    import importlib

    monkeypatch.setattr(importlib.import_module("lodestone.llm.components"), "DRIVER_LINKS", most, raising=False)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(-7, 3000 + i) for i in range(300)]
    spark.sparkContext.setJobGroup(f"components {most}", "")
    made = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(6)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    assert made == {n: r for n, r in groups_of(links, links).items() if n != r}
    assert jobs <= 8 or not most


@pytest.mark.parametrize("tile", [16, 2048])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = [c + rng.normal(scale=rng.choice([0.05, 0.2, 0.4]), size=16) for c in centres for _ in range(20)]
    x += [x[0]] * 30 + [x[3] * 7.5, x[3] * 1e-30, x[5] * 1e30]
    rows = [(i, [float(v) for v in e], "l", "r", 1) for i, e in enumerate(x)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + i, e, "l", "r", 1) for i, e in enumerate(bad)] + [(None, rows[0][1], "l", "r", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, rep string, size int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    m = np.array([r[1] for r in rows[:n]])
    m /= np.abs(m).max(axis=1)[:, None]
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T >= 0.95
    np.fill_diagonal(s, False)
    root = groups_of({i: np.flatnonzero(s[i]).tolist() for i in range(n)}, range(n))
    assert {i: (got[i].n_links, got[i].component_id) for i in range(n)} == {i: (int(s[i].sum()), root[i]) for i in range(n)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + len(bad)))
    assert got[None].n_links == 0 and got[None].component_id is None and len(got) == len(rows)


def test_repeated_vector_ids(spark):
    """Rows of one id are vectors of their own: each has its own links."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (4, [1.0, 0.01]), (5, [0.0, 1.0]), (6, [0.01, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (4, 1, 1, False), (5, 2, 1, False), (6, 2, 1, False)]


def test_no_embeddings(spark):
    kinds = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kinds)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, [1.0])], kinds)).orderBy("vec_id").collect()
    assert [(r.n_links, r.kept) for r in got] == [(0, True), (0, True)]


def test_pruned_products_equal_plain_ones():
    rng = np.random.default_rng(4)
    a = embedding_dedup.unit_rows(rng.normal(size=(700, 24)) * np.linspace(3, 0.1, 24))
    p = embedding_dedup.Projection(a[:200], 8)
    i, j = embedding_dedup.linked_pairs(a, a, p.basis, 0.9, rows=128)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(a @ a.T >= 0.9)), strict=True))


def test_small_tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    links = brute_jaccard(rows)
    root = groups_of(links, links)
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.jaccard_join(d).collect()}
    assert got == {i: (len(links[i]), root[i]) for i, _ in rows}
    assert exact_dedup.exact_groups(d).where(F.col("kept")).count() == len({re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows})
