import numpy as np

from weftline.llm import embed as e

from . import brute


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, err = e.quantise(x)
    approx = codes * scale[:, None]
    bound = err[:, None] + err[None] + err[:, None] * err[None]
    assert (np.abs(x @ x.T - approx @ approx.T) <= bound + 1e-12).all()


def test_tile_matches_double_precision(monkeypatch):
    monkeypatch.setattr(e, "STRIP", 37)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 32)), 5, 0) + 0.12 * rng.normal(size=(300, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    rows = np.arange(300)
    got, label, again = e.tile_links(x, rows, rows, np.ones(300, np.int64), 0.95)
    assert (got == links.sum(1)).all() and 0 < again < 300 * 299 / 4
    assert label.tolist() == list(brute.roots(range(300), zip(*np.nonzero(np.triu(links)), strict=True)).values())


def test_query(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 16)), 3, 0) + 0.1 * rng.normal(size=(120, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200 + i, x[0].tolist(), 0) for i in range(30)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [float("inf")] + [1.0] * 15, 0), (304, [], 0), (None, x[1].tolist(), 0), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in e.near_vectors(df, tile=25).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = [r[0] for r in rows]
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    want = brute.roots(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(links), strict=True)])
    assert [got[i].n_links for i in ids] == links.sum(1).tolist() and {i: got[i].component_id for i in ids} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (300, 301, 302, 303, 304, 307, None)) and got[None].kept
    assert got[305].n_links == got[306].n_links == 1 and got[306].component_id == 305
    assert e.near_vectors(df.limit(0)).count() == 0


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.001]), (4, [1.0, 0.0]), (5, [-0.0, 2.0]), (3, [1.0, 0.001]), (6, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_vectors(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (3, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 1, False), (6, 0, 6, True)])


def test_large_and_small_double_vectors(spark):
    df = spark.createDataFrame([(1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [1e-300, 2e-300]), (4, [2e200, -1e200])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in e.near_vectors(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_cells_lose_no_link():
    rng = np.random.default_rng(7)
    for spread in (0.1, 0.4, 2.0):
        x = e.unit_vectors(np.repeat(rng.normal(size=(20, 8)), 40, 0) + spread * rng.normal(size=(800, 8)))
        for least in (0.95, 0.8):
            for k in (1, 5, 40):
                home, near = e.near_cells(x, x[:k], least)
                i, j = np.nonzero(x @ x.T >= least)
                assert near[i, home[j]].all()
        assert len(e.pick_pivots(x, 10, 0.95)) >= (2 if spread == 0.1 else 1)


def test_clusters_in_cells(spark):
    rng = np.random.default_rng(8)
    x = (np.repeat(rng.normal(size=(12, 16)), 25, 0) + 0.08 * rng.normal(size=(300, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = e.unit_vectors(x)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    want = brute.roots(range(300), zip(*np.nonzero(links), strict=True))
    for tile in (10, 60):
        got = {r.vec_id: r for r in e.near_vectors(df, tile=tile).collect()}
        assert [got[i].n_links for i in range(300)] == links.sum(1).tolist()
        assert {i: got[i].component_id for i in got} == want
