"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from conftest import TESTDATA

import oracle
from pulseplan.llm import nearest, registry, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, id string, v int, score string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], SCHEMA)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k, score):
    """The k best of each query, as (query, rank, id, score)."""
    usable = [(i, v) for i, v in rows if i is not None and good(v)]
    out = []
    for q in {i for i, _ in usable if i % every == 0}:
        asked = [x for i, x in usable if i == q]
        ranked = sorted((-score(x, y), i) for x in asked for i, y in usable if i != q and len(x) == len(y))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:k])]
    return sorted(out)


def product(x, y):
    return sum(math.floor(1024 * np.float64(np.float32(a))) * math.floor(1024 * np.float64(np.float32(b))) for a, b in zip(x, y, strict=True))


ODD = [
    (0, [1.0, 0.0, -0.5]), (100, [0.25, 0.5, 0.0]), (7, [1.0, 0.0, -0.5]), (5, [1.0, 0.0, -0.5]),
    (5, [1.0, 0.0, -0.5]), (300, [0.0, 0.0, 0.0]), (3, None), (4, [float("nan"), 1.0, 1.0]),
    (6, [float("inf"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, []), (None, [1.0, 1.0, 1.0]),
    (5, [9.0, 0.0, -0.5]), (0, [0.0, 2.0, 1.0]), (200, [2.0, 1.0]), (11, [0.5, -1.0]), (400, [3.0]), (12, [-1.0, -2.0, 3.0]),
]


def got_products(frame, every=100, k=10):
    import pyspark.sql.functions as F

    return sorted(map(tuple, topk.top_products(frame, F.col("id") % every == 0, k).collect()))


def test_products_of_odd_vectors(spark):
    assert got_products(table(spark, ODD)) == brute(ODD, 100, 10, product)


@pytest.mark.parametrize("rows", [[], [(3, [1.0])], [(100, [1.0, 2.0])], [(i, [0.5] * 4) for i in range(250)]])
def test_products_of_few_vectors(spark, rows):
    assert got_products(table(spark, rows)) == brute(rows, 100, 10, product)


@pytest.mark.parametrize("dimension, spread", [(1, 1.0), (5, 100.0), (70, 0.1)])
def test_products_over_many_blocks(spark, monkeypatch, dimension, spread):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(dimension)
    rows = [(i, (rng.standard_normal(dimension) * spread).astype(np.float32).tolist()) for i in range(700)]
    assert got_products(table(spark, rows), every=20, k=7) == brute(rows, 20, 7, product)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_products_match_sql(spark, scale):
    sf_dir = str(TESTDATA / scale)
    query = registry.op3_topk_products(spark, sf_dir)
    assert oracle.compare(query, oracle.connect(sf_dir), topk.TOPK_SQL) == []


def test_segment_statistics_bound_the_product():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((50, 33)), rng.standard_normal((60, 33))
    exact, last = a @ b.T, np.inf
    for n in (1, 2, 8, 16, 33):
        bound = topk.segment_statistics(a, n) @ topk.segment_statistics(b, n).T
        assert (bound >= exact - 1e-9).all() and bound.mean() <= last
        last = bound.mean()


def cosines(frame, every=50, k=5):
    import pyspark.sql.functions as F

    return nearest.nearest(frame, F.col("id") % every == 0, k).collect()


def cosine(x, y):
    x, y = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
    return float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y))


def test_nearest_of_odd_vectors(spark):
    rows = [r for r in ODD if r[1] is None or any(x != 0 for x in r[1])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in cosines(table(spark, ODD)))
    want = brute([(i, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, v in rows], 50, 5, lambda x, y: round(cosine(x, y), 12))
    assert got == [w[:3] for w in want]


def test_nearest_of_nothing(spark):
    assert cosines(table(spark, [])) == []


@pytest.mark.parametrize("dimension", [3, 33])
def test_equal_vectors_go_by_id(spark, monkeypatch, dimension):
    """Groups of equal vectors larger than a leaf, over one block and over several."""
    rng = np.random.default_rng(dimension)
    pool = rng.standard_normal((4, dimension)).astype(np.float32).tolist()
    order = rng.permutation(1200).tolist()
    rows = [(i, pool[0] if n < 700 else pool[1 + n % 3]) for n, i in enumerate(order)]
    vector = dict(rows)
    for block in (nearest.BLOCK_ROWS, 300):
        monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
        found = {}
        for r in sorted(cosines(table(spark, rows)), key=lambda r: r.rank):
            found.setdefault(r.query_id, []).append(r.vec_id)
        assert found == {
            q: sorted(i for i in vector if i != q and vector[i] == vector[q])[:5]
            for q in vector if q % 50 == 0
        }


def recall(got, rows, every, k):
    ids = np.array([i for i, _ in rows])
    whole = nearest.unit(np.array([v for _, v in rows], dtype=np.float64))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        score = whole @ whole[q]
        score[q] = -np.inf
        best = set(ids[np.argsort(-score, kind="stable")[:k]].tolist())
        mine = sorted(found[int(ids[q])], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, k + 1))
        for r in mine:
            assert abs(r.score - score[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12
        hits += len(best & {r.vec_id for r in mine})
        total += k
    return hits / total


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_over_whole_tables(spark, scale):
    sf_dir = str(TESTDATA / scale)
    rows = [(r.vec_id, r.embedding) for r in registry.table(spark, sf_dir, "embeddings").collect()]
    got = registry.op7_nearest_cosine(spark, sf_dir).collect()
    found = recall(got, rows, 50, 5)
    print("recall", found)
    assert found >= 0.95


@pytest.mark.parametrize("scale, most", [("sf0.01", 0.9), ("sf0.1", 0.7)])
def test_the_stopping_test_ends_searches(spark, scale, most):
    """The share of candidates verified in one block, and with it the recall."""
    rows = registry.table(spark, str(TESTDATA / scale), "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    block = nearest.Block(ids, np.array([r.embedding for r in rows], dtype=np.float64))
    asked = np.flatnonzero(ids % 50 == 0)
    block.search(ids[asked], block.whole[asked], 5, np.full(len(asked), -2.0))
    share = block.verified / len(asked) / len(ids)
    print("verified", scale, share)
    assert 0 < share < most


def test_recall_over_many_cells(spark, monkeypatch):
    """Clusters, dealt into cells of the sample: few cells are searched, and recall stays."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 20))
    rows = [(i, (centres[i % 12] + 0.1 * rng.standard_normal(20)).tolist()) for i in range(3000)]
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 200)
    got = cosines(table(spark, rows))
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert recall(got, rows, 50, 5) >= 0.95


def test_cells_hold_their_points():
    rng = np.random.default_rng(4)
    points = np.concatenate((rng.standard_normal((500, nearest.PROJECTIONS)), np.zeros((300, nearest.PROJECTIONS))))
    cells = nearest.fit_cells(points, 16)
    own = cells.of(points)
    gaps = nearest.box_gaps(points, cells.low, cells.high)
    assert len(cells.low) >= 16 and (gaps[np.arange(len(points)), own] == 0).all()
    assert set(own) == set(range(len(cells.low)))
    assert (nearest.fit_cells(points[:0], 1).of(points) == 0).all()


def test_chi_square():
    assert abs(nearest.chi_square(15.507, 8) - 0.95) < 1e-4
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 1e-2
