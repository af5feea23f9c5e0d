"""Operator 11 against all inner products, and against its SQL."""

import math
import os

import duckdb
import numpy as np
import pytest

from crowdweave.llm import queries as registered
from crowdweave.llm import search

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector string, part int, query string, number int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, "z", 3) for i, v in rows], SCHEMA).repartition(5)


def plain(rows, top=5, step=50):
    """Every query against every candidate, in Python's whole numbers."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    found = []
    for q, a in whole:
        if q is None or q % step:
            continue
        scores = []
        for i, b in whole:
            if i != q:
                s = min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(1 << 63)), (1 << 63) - 1)
                scores.append((-s, i is None, i or 0, i))
        found += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(found, key=repr)


def got(frame_):
    return sorted((tuple(r) for r in frame_.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def drawn(n, dims, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(i, (middle[i % centres] + rng.normal(size=dims) * 0.2).tolist()) for i in range(n)]


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, []), (150, [1.0, None]), (200, [NAN, 1.0]), (250, [INF, 1.0]), (300, [1.0, -2.0, 0.5]), (1, [1.0, 2.0]),
            (2, [1.0, 2.0]), (3, []), (4, [-0.001, 0.001, 3.0]), (None, [1.0, 2.0]), (None, [9.0]), (5, [1e-300, -1e-300]), (-50, [0.5, 0.5]), (7, None),
            (8, [-INF]), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (1, [1.0, 2.0])]
    assert got(search.top_k(frame(spark, rows))) == plain(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0])], [(None, None)], [(0, None), (50, [1.0])], [(0, [1.0]), (50, [2.0])], [(1, [1.0]), (2, [2.0])]):
        found = search.top_k(frame(spark, rows))
        assert found.columns == ["query_id", "rank", "vec_id", "score"] and got(found) == plain(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [2.0**30 + i, -(2.0**25) * i, 1.0]) for i in range(60)] + [(100, [1e200, 1e-3, 0.0]), (101, [1e200, 0.0, 0.0]), (102, [-1e200, 2.0, 1.0])]
    assert got(search.top_k(frame(spark, rows))) == plain(rows)


def test_repeated_query_rows(spark):
    rows = [*drawn(80, 3), (0, [5.0, 5.0, 5.0])]
    found = search.top_k(frame(spark, rows)).collect()
    assert len([r for r in found if r.query_id == 0]) == 10 and not [r for r in found if r.vec_id == r.query_id]


@pytest.mark.parametrize("kind", ["clusters", "noise", "one vector"])
def test_many_parts_and_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(search, "LEAST_PART_ROWS", 100)
    monkeypatch.setattr(search, "PART_ROWS", 150)
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "TILE", 5)
    rows = drawn(1200, 8, centres=1200 if kind == "noise" else 12)
    if kind == "one vector":  # a third of the table, every query near it
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    assert got(search.top_k(frame(spark, rows), step=7)) == plain(rows, step=7)


def test_long_vectors(spark):
    rows = drawn(60, 3000)
    assert got(search.top_k(frame(spark, rows))) == plain(rows)


def test_blocks_below_the_kth_score_are_not_scored(monkeypatch):
    scored = []
    inner = search.inner
    monkeypatch.setattr(search, "inner", lambda a, b: scored.append(len(a) * len(b)) or inner(a, b))
    vectors = np.floor(np.array([v for _, v in sorted(drawn(4096, 16, centres=64), key=lambda r: r[0] % 64)]) * 256)
    ids = np.arange(4096)
    rows = [search._block(0, k, ids[k * 64 : k * 64 + 64].tolist(), vectors[k * 64 : k * 64 + 64])[2:] for k in range(64)]
    asking = ids[::50]
    best = search.Best(asking, vectors[asking], 5)
    best.search(search.Blocks(rows))
    full = vectors[asking] @ vectors.T
    full[np.arange(len(asking)), asking] = -np.inf
    order = np.argsort(-full, axis=1, kind="stable")[:, :5]
    assert (best.ids == order).all() and (best.scores.astype(float) == np.take_along_axis(full, order, axis=1)).all()
    assert sum(scored) < 0.2 * full.size


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (3.0, 1e9, 1e30):
        vectors, queries = (np.floor(rng.normal(size=(n, 9)) * scale) for n in (40, 20))
        reach = search.bounds(queries, vectors.max(axis=0)[None, :], vectors.min(axis=0)[None, :])[:, 0]
        assert all(int(r) >= max(sum(int(x) * int(y) for x, y in zip(q, v, strict=True)) for v in vectors) for q, r in zip(queries, reach, strict=True))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_and_its_sql(spark):
    found = got(registered.QUERIES["op11_block_pruned_search"](spark, FOLDER))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert found == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    assert sorted(con.execute(registered.ORACLE_SQL["op11_block_pruned_search"]).fetchall(), key=repr) == found
