import numpy as np

from gridloom.llm import embedding_dedup as ed
from gridloom.llm.components import components

SCHEMA = "vec_id long, embedding array<double>, label int, e int, rep string, n_links string"


def brute(rows, cosine):
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = [0] * len(rows), {k: rows[k][0] for k in range(len(rows))}
    links = []
    for s, k in enumerate(ok):
        for m in ok[s + 1 :]:
            a, b = np.array(rows[k][1]), np.array(rows[m][1])
            if rows[k][2] == rows[m][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                n[k] += 1
                n[m] += 1
                links.append((k, m))
    changed = True
    while changed:
        changed = False
        for k, m in links:
            low = min(comp[k], comp[m])
            changed |= comp[k] != low or comp[m] != low
            comp[k] = comp[m] = low
    return sorted(((rows[k][0] is None, rows[k][0] or 0, n[k], comp[k] or 0, rows[k][0] == comp[k]) for k in range(len(rows))))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in ed.deduplicate(df, **kw).collect())


def test_against_brute_force(spark, monkeypatch):
    g = np.random.default_rng(1)
    rows = []
    for i in range(260):
        base = g.normal(size=8) if not rows or g.random() < 0.4 else np.array(rows[g.integers(len(rows))][1])
        rows.append((i, (base + g.normal(size=8) * 0.12).tolist(), int(g.integers(3))))
    rows += [(300 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(400, (np.array(rows[7][1]) * 3).tolist(), rows[7][2])]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [None] + [1.0] * 7, 1), (503, [float("nan")] * 8, 1), (504, rows[7][1], None), (505, [], 1), (506, [1.0], 2), (507, [2.0], 2), (None, rows[7][1], rows[7][2]), (3, rows[3][1], rows[3][2])]
    want = brute(rows, 0.93)
    assert run(spark, rows) == want
    monkeypatch.setattr(ed, "LEAF", 4)
    assert run(spark, rows, interval=16) == want


def test_shared_ids(spark):
    """Rows that share an id but not the label or the vector are nodes of their own."""
    g = np.random.default_rng(4)
    a, b, c = (g.normal(size=6).tolist() for _ in range(3))
    rows = [(1, a, 0), (1, b, 1), (2, a, 0), (3, b, 2), (4, c, 1), (4, b, 1), (4, b, 1), (0, c, 1)]
    assert run(spark, rows) == brute(rows, 0.93)
    rows = [(int(g.integers(12)), (np.array(a) + g.normal(size=6) * 0.3).tolist(), int(g.integers(2))) for _ in range(60)]
    assert run(spark, rows) == brute(rows, 0.93)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(False, 1, 0, 1, True)]


def test_leaves_against_all_pairs(monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 8)
    g = np.random.default_rng(2)
    v = np.repeat(g.normal(size=(20, 6)), 6, 0) + g.normal(size=(120, 6)) * 0.1
    v = v[np.lexsort(v.T[::-1])]
    basis = ed.principal(v)
    part = lambda x: type("I", (), {"ids": np.arange(len(x)), "vectors": x, "norms": np.linalg.norm(x, axis=1), "projections": (x / np.linalg.norm(x, axis=1)[:, None]) @ basis})()
    cos = lambda x, y: x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    i, j = ed.join_intervals(part(v[:70]), part(v[70:]), False, 0.93)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(cos(v[:70], v[70:]) >= 0.93))))
    i, j = ed.join_intervals(part(v), part(v), True, 0.93)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(cos(v, v) >= 0.93)) if a < b}


def test_components(spark):
    g = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(None, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
