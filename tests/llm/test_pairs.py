import random

import numpy as np
import pytest

from folioforge.llm import neardup, neighbours
from folioforge.llm.components import connected_components

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(t, share, rng=RNG):
    w = t.split()
    for i in rng.sample(range(len(w)), int(share * len(w))):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


# near-duplicates --------------------------------------------------------------


def jaccard(a, b, width):
    x, y = ({tuple(t.lower().split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0


@pytest.mark.parametrize(("tile", "exact"), [(4096, False), (8, False), (4096, True), (8, True)])
def test_near_duplicates_against_brute_force(spark, tile, exact):
    rng = random.Random(tile)
    docs = []
    for base in range(12):
        t = text(80, rng)
        docs += [t, t, *[edited(t, rng.choice([0.01, 0.03, 0.06, 0.1]), rng) for _ in range(6)]]
    rows = list(enumerate(docs, 1)) + [(3, docs[2]), (None, docs[0]), (500, None), (501, ""), (502, "short text")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "Id long, Doc string, node string, id_a int")
    members, links = neardup.near_duplicates(df, "Id", "Doc", 0.6, 3, 40, tile=tile, exact=exact)
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()}
    want = {(i, j) for i in range(1, len(docs) + 1) for j in range(i + 1, len(docs) + 1) if jaccard(docs[i - 1], docs[j - 1], 3) >= 0.6}
    assert got == want
    groups = {r.id: r.class_id for r in neardup.group_members(members, links).collect()}
    assert len(groups) == len(docs) and all(groups[a] == groups[b] for a, b in want)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "Id long, Doc string")
    members, links = neardup.near_duplicates(empty, "Id", "Doc")
    assert members.count() == 0 and links.count() == 0
    assert neardup.group_members(members, links).count() == 0


def test_hot_copies_stay_one_node(spark):
    t = text(60)
    df = spark.createDataFrame([(i, t) for i in range(300)] + [(1000, edited(t, 0.02)), (1001, "x " * 200_000)], "Id long, Doc string")
    members, links = neardup.near_duplicates(df, "Id", "Doc", 0.6, 3, 40)
    assert links.count() == 1 and members.select("node").distinct().count() == 3
    g = {r.id: r.n_links for r in neardup.group_members(members, links).collect()}
    assert g[0] == 1 and g[1000] == 1 and g[1001] == 0


def test_tile_comparison_is_exact():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    f[300:] = f[:300] ^ (np.uint64(1) << rng.integers(0, 60, (300, 2)).astype(np.uint64))
    n = rng.integers(50, 200, 600)
    x, y = neardup.compare_run(np.arange(600), n, f[:, 0].view(np.int64), f[:, 1].view(np.int64), 0.6, 20, tile=64)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if int(np.bitwise_count(f[i] ^ f[j]).sum()) <= 20 and min(n[i], n[j]) >= 0.6 * max(n[i], n[j])}
    assert got == want


def test_tiles_are_skipped_by_population_count(monkeypatch):
    rng = np.random.default_rng(2)
    light, heavy = ((rng.random((512, 128)) < share).astype(np.uint64) for share in (0.1, 0.9))
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pack = lambda bits: [(bits[:, 64 * j : 64 * (j + 1)] * weight).sum(axis=1, dtype=np.uint64).view(np.int64) for j in (0, 1)]
    f0, f1 = (np.concatenate(x) for x in zip(pack(light), pack(heavy)))
    n = np.concatenate((np.full(512, 100), np.full(512, 101)))
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(x.shape) or count(x))
    x, y = neardup.compare_run(np.arange(1024), n, f0, f1, 0.6, 40, tile=64)
    assert sum(len(s) == 2 for s in seen) == 2 * 2 * (8 * 9 // 2)  # two words, two halves, tiles within a half only
    monkeypatch.undo()
    a = np.stack((f0, f1), 1).view(np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i, j in zip(*np.nonzero(d <= 40)) if i < j}


def test_keys_meet_nearly_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    for t in (0.6, 0.8):
        members = neardup.band_members(neardup.bands_for(t), 3)
        met = (rng.random((200_000, neardup.BITS)) < t)[:, members].all(2).any(1)
        assert met.mean() > 0.9999


def test_crowds_are_verified_in_blocks(spark):
    rng = random.Random(12)
    t = text(120, rng)
    docs = [edited(t, 0.03, rng) for _ in range(150)]
    members, links = neardup.near_duplicates(spark.createDataFrame(list(enumerate(docs, 1)), "Id long, Doc string"), "Id", "Doc", 0.6, 3, 40)
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(members, links).collect()}
    assert got == {(i + 1, j + 1) for i in range(150) for j in range(i + 1, 150) if jaccard(docs[i], docs[j], 3) >= 0.6} and len(got) > 5000


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and got[102] == 100 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# neighbours ---------------------------------------------------------------------


def brute(x, keys, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {keys[i]: {keys[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(x))}


def test_neighbours_recall_and_dirty_rows(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.4).astype(np.float32)
    rows = [(i + 1, [v.tolist() for v in x[3 * i : 3 * i + 3]], "z") for i in range(500)]
    bad = [(900, None, ""), (901, [[0.0] * 16], ""), (902, [[float("nan")] + [1.0] * 15, [1.0] * 8, None], ""), (None, [[1.0] * 16], ""), rows[0], (903, [], "")]
    df = spark.createDataFrame(rows + bad, "Id long, Vec array<array<float>>, cell string")
    vec = neighbours.chunk_vectors(df, "Id", "Vec", 16)
    assert vec.count() == 1500
    found = neighbours.nearest_neighbours(vec, 16, 5, probes=4, per_cell=100, block=64)
    got: dict = {}
    for r in found.collect():
        got.setdefault((r.id, r.chunk), set()).add((r.n_id, r.n_chunk))
    keys = [(i // 3 + 1, i % 3) for i in range(1500)]
    want = brute(x, keys, 5)
    recall = sum(len(got[k] & want[k]) for k in keys) / (5 * len(keys))
    assert recall >= 0.95 and all(len(got[k]) == 5 for k in keys)
    exact = neighbours.exact_neighbours(vec.filter("id % 20 = 0"), vec, 16, 5, groups=3)
    assert all((r.n_id, r.n_chunk) in want[(r.id, r.chunk)] for r in exact.collect())


def test_tree_of_cells_finds_the_flat_answer(monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(60, 16))
    x = (centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "FLAT", 10)
    codec = neighbours.fit_codec(x, 200)
    assert codec.tops is not None and 150 <= len(codec.centroids) <= 260 and codec.first[-1] == len(codec.centroids)
    got = codec.assign(x, 4)
    flat = neighbours.Codec(codec.centroids, codec.words, codec.eta).assign(x, 4)
    assert (got[:, 0] == flat[:, 0]).mean() > 0.98 and np.mean([len(set(a) & set(b)) for a, b in zip(got, flat)]) > 3.7
    assert codec.assign(x[:3], 4).shape == (3, 4)


def test_equal_vectors(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, [same]) for i in range(1, 41)] + [(100 + i, [rng.normal(size=8).astype(np.float32).tolist()]) for i in range(30)]
    vec = neighbours.chunk_vectors(spark.createDataFrame(rows, "Id long, Vec array<array<float>>"), "Id", "Vec", 8)
    got: dict = {}
    for r in neighbours.nearest_neighbours(vec, 8, 3).collect():
        got.setdefault(r.id, []).append(r.n_id)
    assert set(got) == {i for i, _ in rows} and all(len(v) == 3 for v in got.values())
    assert sorted(got[1]) == [2, 3, 4] and sorted(got[40]) == [1, 2, 3]


@pytest.mark.parametrize("dim", [33, 1024, 1536, 3072])
def test_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(6, dim))
    x = (centre[np.arange(240) % 6] + rng.normal(size=(240, dim)) * 0.5).astype(np.float32)
    vec = neighbours.materialize(neighbours.chunk_vectors(spark.createDataFrame([(i + 1, [v.tolist()]) for i, v in enumerate(x)], "Id long, Vec array<array<float>>"), "Id", "Vec", dim))
    table = lambda df: {(r.id, r.n_id) for r in df.collect()}
    got, want = table(neighbours.nearest_neighbours(vec, dim, 4, probes=3, per_cell=60, rerank=24)), table(neighbours.exact_neighbours(vec, vec, dim, 4, groups=1))
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want) == 960


def test_sums_of_codes_do_not_wrap():
    """The largest possible sum of looked-up bytes at 3,072 dimensions is above what 16 bits hold."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3072)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codec = neighbours.fit_codec(x, 1)
    assert int(codec.tables(x[:1]).max(axis=2).astype(np.int64).sum()) > 1 << 16


def test_fit_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    fit = neighbours.fit_codec
    monkeypatch.setattr(neighbours, "fit_codec", lambda sample, cells, **how: seen.append((sample.nbytes, cells)) or fit(sample, cells, **how))
    rng = np.random.default_rng(7)
    vec = neighbours.chunk_vectors(spark.createDataFrame([(i, [rng.normal(size=16).tolist()]) for i in range(1500)], "Id long, Vec array<array<float>>"), "Id", "Vec", 16)
    assert neighbours.nearest_neighbours(vec, 16, 3, per_cell=2, fit_bytes=256 * 64, probes=64).count() == 4500
    assert seen[0][0] <= 1.25 * 256 * 64 and seen[0][1] == 64


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "Id long, Vec array<array<float>>")
    assert neighbours.nearest_neighbours(neighbours.chunk_vectors(empty, "Id", "Vec", 4), 4, 5).count() == 0
    one = spark.createDataFrame([(1, [[1.0, 0.0, 0.0, 0.0]])], "Id long, Vec array<array<float>>")
    assert neighbours.nearest_neighbours(neighbours.chunk_vectors(one, "Id", "Vec", 4), 4, 5).count() == 0
