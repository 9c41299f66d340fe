import math
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

from gridloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string"


def brute(rows, k):
    ok = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {q for q, _ in ok if q % 20 == 0}:
        clamp = lambda s: max(min(s, 2**63 - 1), -(2**63))
        best = sorted((-clamp(sum(x * y for x, y in zip(a, b))), i) for own, a in ok if own == q for i, b in ok if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), **kw).collect())


def test_against_brute_force(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(i, (g.normal(size=9) / 3).tolist()) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # a group of copies: ties
    rows += [(500, None), (520, [0.5, None] + [0.0] * 7), (540, [float("nan")] * 9), (560, [float("inf")] * 9), (None, [0.1] * 9), (580, []), (600, [0.0] * 9), (620, [1.0, -2.0])]
    assert run(spark, rows) == brute(rows, 20)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    assert run(spark, rows, block_values=70 * 9, k=5) == brute(rows, 5)


def test_repeated_ids(spark):
    """Repeated rows are candidates of their own, as in the SQL; also beside rows of one id with other vectors."""
    g = np.random.default_rng(8)
    rows = [(i % 25, (g.normal(size=4) / 3).tolist()) for i in range(60)] + [(7, [0.9] * 4)] * 30 + [(40, [0.5] * 4)] * 3
    got = run(spark, rows)
    assert got == brute(rows, 20)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    assert sorted(con.sql(topk.OP6_SQL).fetchall()) == got


def test_any_finite_component(spark):
    rows = [(0, [1e17, 0.5]), (1, [1e300, 0.0]), (2, [-1.7e308, 1.0]), (3, [0.25, 0.5]), (20, [0.3, -0.4]), (40, [float(1 << 56) / 64, 1.0])]
    assert run(spark, rows) == brute(rows, 20)


def test_wide_values(spark):
    g = np.random.default_rng(6)
    rows = [(i, (g.normal(size=3) * 1e6).tolist()) for i in range(45)]
    assert run(spark, rows) == brute(rows, 20)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e15, 0.0]), (1, [1e15, 0.0]), (2, [-1e15, 0.0])]
    assert run(spark, rows) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.1, -0.9]), (20, [0.2, 0.2])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []


def test_sum_of_slices():
    g = np.random.default_rng(7)
    for width in (1, 2, 6, 90):
        values = g.integers(-width, width + 1, (130, 5))
        block = topk.SlicedBlock(np.arange(130), values)
        query = g.integers(-70, 70, 5)
        slices, constant = block.sum_slices(query)
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << b for b, s in enumerate(slices)) + constant
        assert (got == values @ query).all()


def test_signed_digits():
    for q in range(-300, 300):
        assert sum(s << a if s > 0 else -(1 << a) for a, s in topk.signed_digits(q)) == q
