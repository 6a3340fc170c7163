"""Hard negatives against brute force in whole numbers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkledger.llm import hard_negatives as H

LONG = 2**63 - 1


def brute(rows, k=5, low=80, high=100):
    """rows: (vec_id, label, whole numbers); one anchor for equal rows."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    clamp = lambda s: min(max(s, -LONG - 1), LONG)
    for i, label, x in {(i, y, tuple(x)): (i, y, x) for i, y, x in rows if i % 100 == 0}.values():
        others = [(-dot(x, z), j, m) for j, m, z in rows if j != i and len(z) == len(x)]
        for p, j, _ in sorted((s, j, m) for s, j, m in others if m == label)[:k]:
            p = -p
            found = sorted((s, n) for s, n, m in others if m != label and low * p <= 100 * -s <= high * p)[:k]
            out += [(i, j, r, n, clamp(p), clamp(-s)) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def whole(spark, rows):
    return spark.createDataFrame([(i, y, [float(v) for v in x]) for i, y, x in rows], "vec_id long, label long, x array<double>")


def cases(seed, n, dim=6, spread=40):
    r = random.Random(seed)
    return [(i, r.randrange(3), [r.randrange(-spread, spread) * (1 + i % 4) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 16, "block_rows": 2}])
def test_against_brute_force(spark, sizes):
    rows = cases(1, 700)
    rows += [(5000 + i, rows[300][1] + 1 - i % 2, rows[300][2]) for i in range(60)]  # copies of an anchor under two labels: ties
    rows += [(9000, 0, [1, 2]), (9001, 0, [2, 2]), (9002, 1, [1, 2]), (9100, 7, [0] * 6), (9200, 0, [0] * 6), (100, 1, [3] * 6)] + [rows[200]] * 2
    df = whole(spark, rows)
    got = H.hard_negatives(df, df.where("vec_id % 100 = 0"), **sizes)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_other_limits(spark):
    rows = cases(2, 300)
    df = whole(spark, rows)
    got = H.hard_negatives(df, df.where("vec_id % 100 = 0"), k_positive=2, k_negative=2, low=10, high=60)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 10, 60)


def test_norm_bounds_skip_pages(monkeypatch):
    """Vectors of falling norm: the search ends at the page that no bound allows, and loses nothing."""
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(8000, 8)) * 500 / (1 + np.arange(8000)[:, None]) ** 0.7)
    order = np.argsort(-H._norms(x), kind="stable")
    ids, labels, x = np.arange(8000)[order], r.integers(0, 2, 8000)[order], x[order]
    q = np.floor(r.normal(size=(4, 8)) * 100)
    search = H.Search(np.array([-1, -2, -3, -4]), np.zeros(4, np.int64), q, [[]] * 4, 5, True)
    pages = 0
    for a in range(0, 8000, 100):
        if not search.page(ids[a : a + 100], labels[a : a + 100], x[a : a + 100], float(H._norms(x[a:]).max())):
            break
        pages += 1
    assert pages < 40
    scores = x @ q.T
    for i in range(4):
        own = sorted((-int(s), int(v)) for s, v, y in zip(scores[:, i], ids, labels) if y == 0)[:5]
        assert search.best[i][0] == own


def test_op13_query_of_large_and_odd_vectors(spark, tmp_path):
    r = random.Random(6)
    vec = [(i, [r.uniform(-1, 1) for _ in range(4)], r.randrange(10)) for i in range(400)]
    vec += [(1000, [1e30, 2e30, -1e30, 0.5], 1), (1001, [2e30, 1e30, 0.0, 1.0], 1), (1003, [1.9e30, 1e30, 0.0, 1.0], 2), (1100, [2e-300, 0.0, 0.0, 0.0], 2), (2000, [1e308] * 4, 2)]
    vec += [(3000, None, 1), (3100, [1.0, None, 0.0, 0.0], 1), (3200, [math.nan] * 4, 1), (3300, [math.inf] * 4, 1), (3400, [], 1), (3500, [1.0] * 4, None), (None, [1.0] * 4, 1), (3600, [0.5, 0.25], 3)]
    spark.createDataFrame(vec, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit("clash")).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = []
    for i, x, y in vec:
        if i is not None and y is not None and x and all(v is not None and math.isfinite(v) and math.isfinite(256 * v) for v in x):
            rows.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * v) for v in x]))
    got = H.op13_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_op13_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = H.op13_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({H.OP13_SQL})").fetchall())
