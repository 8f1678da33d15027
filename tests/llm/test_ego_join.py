import numpy as np
import pytest

from polyad.llm import ego_join as E

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n int"


def brute(rows):
    unit = []
    for i, e, label in rows:
        ok = i is not None and label is not None and e and None not in e and np.isfinite(e).all() and any(e)
        v = np.array(e, np.float32).astype(float) if ok else None
        unit.append(v / np.linalg.norm(v) if ok else None)
    link = lambda a, b: unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    n = len(rows)
    links = [[b for b in range(n) if b != a and link(a, b)] for a in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in links[a]:
                comp[a] = comp[b] = min(comp[a], comp[b], key=lambda x: rows[x][0])
    best = [min((rows[b][0] for b in range(n) if comp[b] == comp[a] and rows[b][0] is not None), default=None) for a in range(n)]
    return sorted(((rows[a][0], len(links[a]), best[a] if rows[a][0] is not None else None) for a in range(n)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], SCHEMA)
    out = E.near_duplicates(spark, df).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.vec_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def cloud(seed, n, dim=8):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            base = np.array(rows[r.integers(len(rows))][1])
            v = base + r.normal(0, 0.12, dim) * np.linalg.norm(base) / dim**0.5 * r.choice([0, 1, 3])
        else:
            v = r.normal(size=dim)
        rows.append((int(i * 7 % 1009), np.float32(v * r.choice([1, 1, 5])).astype(float).tolist(), int(r.integers(2))))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "SEQUENCE", 40)
    monkeypatch.setattr(E, "PIECE", 2)
    monkeypatch.setattr(E, "GROUP", 2)
    rows = cloud(1, 300)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(5, v, 1), (9, [2.0, 4.0, 0.0], 1), (3, v, 2), (4, v, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [1.0, None, 2.0], 1), (10, [float("nan"), 2.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0], 1), (12, [], 1), (13, [1.0, 2.0], 1), (None, v, 1), (14, v, 1), (14, v, 1), (15, [1.0, 2.0, -0.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1)]


def test_all_alike(spark, monkeypatch):
    monkeypatch.setattr(E, "SEQUENCE", 64)
    monkeypatch.setattr(E, "PIECE", 2)
    r = np.random.default_rng(3)
    rows = [(i, (np.ones(6) + r.normal(0, 0.05, 6)).astype(np.float32).astype(float).tolist(), 0) for i in range(200)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("same", [True, False])
def test_join_pair(same):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x if same else np.vstack([x[::3], -x[::5]]) @ np.linalg.qr(np.eye(5) + r.normal(0, 0.05, (5, 5)))[0]
    nx, ny = r.integers(1, 4, len(x)), None
    ny = nx if same else r.integers(1, 4, len(y))
    axes = np.linalg.qr(r.normal(size=(5, 3)))[0]
    (ox, lx), (oy, ly) = (E.leaf_order(v, axes, 0.2) for v in (x, y))
    x, nx = x[ox], nx[ox]
    y, ny = (x, nx) if same else (y[oy], ny[oy])
    cx, cy, _ = E.join_pair(x, y, lx, ly, nx, ny, same)
    hit = x @ y.T >= 0.93
    if same:
        np.fill_diagonal(hit, False)
    assert (cx == hit @ ny).all() and (same or (cy == nx @ hit).all())


def test_leaves_hold_their_rows():
    r = np.random.default_rng(4)
    for n in (1, 15, 300, 2048):
        x = r.normal(size=(n, 7))
        order, leaves = E.leaf_order(x, np.eye(7)[:, :4], 0.7)
        assert sorted(order.tolist()) == list(range(n)) and leaves.limits[0] == 0 and leaves.limits[-1] == n
        for a, b, c, radius in zip(leaves.limits[:-1], leaves.limits[1:], leaves.centres, leaves.radii):
            assert len(np.unique(np.clip(np.floor(x[order][a:b, :4] / 0.7), -8, 7), axis=0)) == 1 and np.linalg.norm(x[order][a:b] - c, axis=1).max() <= radius + 1e-6
