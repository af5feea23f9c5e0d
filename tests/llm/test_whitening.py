"""Operator 12 against a plain solution that holds all vectors at once."""

import math
import os

import numpy as np
import pytest

from crowdweave.llm import queries as registered
from crowdweave.llm import whitening as W

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, n long, component int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, 3) for i, v in rows], SCHEMA).repartition(5)


def plain(rows, components=8):
    """rows of (id, vector), all usable: (id, component) to deviation, whitened up to its sign, explained."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    apart = np.array([[n * a - s for a, s in zip(row, sums, strict=True)] for row in x], object)
    centred = apart.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    deviations = [sum(int(a) ** 2 for a in row) for row in apart]
    return deviations, white, values[:components] / values.sum()


def check(frame_, rows, components=8):
    deviations, white, explained = plain(rows, components)
    found = frame_.collect()
    assert len(found) == len(rows) * len(explained)
    by_id = {(r.vec_id, r.component): r for r in found}
    assert len(by_id) == len(found)
    for k in range(len(explained)):
        got = np.array([by_id[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(got - white[:, k]).max(), np.abs(got + white[:, k]).max()) < 1e-7
        assert all(by_id[i, k + 1].deviation == d and by_id[i, k + 1].n == len(rows) for (i, _), d in zip(rows, deviations, strict=True))
        assert abs(by_id[rows[0][0], k + 1].explained / explained[k] - 1) < 1e-9
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def drawn(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(dims, dims)) * np.linspace(0.05, 1, dims)
    return [(i, (rng.normal(size=dims) @ spread + 3).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 2, 5, 8, 12])
def test_against_plain(spark, dims):
    rows = drawn(300, dims, dims)
    check(W.whitened(frame(spark, rows)), rows, min(dims, 8))


def test_unusable_rows_are_dropped(spark):
    rows = drawn(100, 4)
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 3.0]), (1003, [NAN, 0.0, 0.0, 0.0]), (1004, [INF, 0.0, 0.0, 0.0]),
           (1005, [-INF, 0.0, 0.0, 0.0]), (1006, [1.0] * 5), (1007, [3e38, 0.0, 0.0, 0.0])]
    check(W.whitened(frame(spark, [*bad[:4], *rows, *bad[4:]])), rows, 4)


def test_hot_vector_and_repeated_rows(spark):
    rows = drawn(120, 3) + [(i, [1.0, 2.0, 3.0]) for i in range(1000, 1080)]
    check(W.whitened(frame(spark, rows)), rows, 3)
    twice = W.whitened(frame(spark, rows + rows[:1])).where("vec_id = 0").collect()
    assert len(twice) == 6 and {r.n for r in twice} == {201}
    assert len(W.whitened(frame(spark, [*rows, (None, [0.0, 0.0, 0.0])])).where("vec_id IS NULL").collect()) == 3


def test_tables_without_variance(spark):
    for rows in ([], [(None, None)] * 2, [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        found = W.whitened(frame(spark, rows))
        assert found.collect() == []
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(50)]  # one direction varies
    assert {r.component for r in W.whitened(frame(spark, line)).collect()} == {1}


def test_long_vectors(spark):
    rows = drawn(40, 300)
    found = W.whitened(frame(spark, rows))
    deviations, _, explained = plain(rows)
    got = found.where("component = 1").collect()
    assert {r.vec_id: r.deviation for r in got} == dict(zip(range(40), deviations, strict=True))
    assert abs(got[0].explained / explained[0] - 1) < 1e-9 and got[0].identity_error < 1e-9


def test_deviations_beyond_64_bits():
    wide = W.Whitening(1 << 40, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert wide.deviations(np.array([[1.0, 2.0], [0.0, 0.0]])) == [None, 0]
    assert wide.deviations(np.array([[0.0, 0.0]])) == [0]
    edge = W.Whitening(1 << 31, [1 << 31, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert edge.deviations(np.array([[2.0, 0.0], [2.0, 1.0], [3.0, 0.0]])) == [1 << 62, None, None]


def test_merges_equal_one_stream():
    rows = np.random.default_rng(3).normal(size=(500, 6)) * 40 + 100_000
    whole, merged = W.Moments(6), W.Moments(6)
    whole.add(rows)
    for part in np.split(rows, [0, 1, 17, 300]):
        some = W.Moments(6)
        some.add(part)
        merged.merge(some.n, some.mean, some.products, some.sums)
    centred = rows - rows.mean(axis=0)
    for found in (whole, merged):
        assert found.n == 500 and np.allclose(found.mean, rows.mean(axis=0), rtol=1e-14)
        assert np.allclose(found.products, centred.T @ centred, rtol=1e-9, atol=1e-5)


@pytest.mark.parametrize("dims", [1, 2, 3, 17, 64])
def test_eigen_solve(dims):
    a = np.random.default_rng(dims).normal(size=(dims, dims))
    for matrix in (a + a.T, a @ a.T, np.zeros((dims, dims)), np.eye(dims), np.ones((dims, dims))):
        values, vectors = W.symmetric_eigen(matrix)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-12 * max(1, np.abs(matrix).max() * dims))
        assert np.allclose(vectors.T @ vectors, np.eye(dims), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-11 * max(1, np.abs(matrix).max() * dims))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(registered.QUERIES["op12_embedding_whitening"](spark, FOLDER), rows)
