import math

import numpy as np
import pytest

from crashgrid.llm import whitening
from crashgrid.sources.storage import materialise

SCHEMA = "vec_id long, embedding array<float>, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)


def numbers(vectors):
    return np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100000


def check_against_dense(spark, rows, kept, k=8):
    """All columns against a dense eigen decomposition and whole-number sums."""
    x = numbers([v for _, v in kept])
    n = len(x)
    values, vectors = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int(np.sum(values > 1e-12 * values.sum())))
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == n * k
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    whole = [[int(e) for e in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for (vec_id, _), row, exact in zip(kept, x, whole):
        found = by_id[vec_id]
        assert found[1].deviation == sum((n * e - s) ** 2 for e, s in zip(exact, sums))
        for c in range(k):
            assert found[c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
    for c in range(k):
        mine = np.array([by_id[i][c + 1].whitened for i, _ in kept])
        true = (x - x.mean(0)) @ vectors[:, c] / math.sqrt(values[c])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-8


def test_equals_dense_decomposition_and_drops_bad_rows(spark):
    rng = np.random.default_rng(1)
    turn = rng.standard_normal((12, 12)) * np.linspace(1, 3, 12)
    kept = [(i, [float(e) for e in row]) for i, row in enumerate(rng.standard_normal((200, 12)) @ turn)]
    bad = [(300, None), (301, []), (302, [None] + [1.0] * 11), (303, [float("nan")] * 12), (304, [float("inf")] + [0.0] * 11), (305, [1.0] * 5)]
    check_against_dense(spark, bad[:3] + kept + bad[3:], kept)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(2)
    kept = [(i, [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (40, 2)))]
    check_against_dense(spark, kept, kept)  # rank 2 of 3


def test_equal_variances_still_whiten(spark):
    """Each variance occurs several times, so a Krylov space alone does not hold all components."""
    rows = [(2 * i + j, [float((1 if j else -1) * (4 if i < 5 else 1) * (d == i)) for d in range(10)]) for i in range(10) for j in range(2)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 20 * 8
    assert got[0].identity_error < 1e-9
    shares = {r.component: r.explained for r in got}
    total = 5 * 16 + 5
    assert [shares[i] for i in range(1, 9)] == pytest.approx([16 / total] * 5 + [1 / total] * 3, rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_without_variance_there_are_no_rows(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 0


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (None, [2.0, 3.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    want = [(missing, c) for missing in (False, True) for c in (1, 1, 2, 2)]
    assert sorted((r.vec_id is None, r.component) for r in found) == want


def test_large_entries_stay_exact_or_null(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 3e38])]
    found = {r.vec_id: r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert found[4].deviation is None
    small = rows[:3]
    found = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, small)).collect()}
    whole = [[int(e) for e in row] for row in numbers([v for _, v in small])]
    sums = [sum(c) for c in zip(*whole)]
    exact = {i: sum((3 * e - s) ** 2 for e, s in zip(row, sums)) for (i, _), row in zip(small, whole)}
    assert found == {i: e if e < 2**63 else None for i, e in exact.items()}


def test_blocks_do_not_change_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(e) for e in row]) for i, row in enumerate(rng.standard_normal((100, 6)) * [5, 4, 3, 2, 1, 1])]
    one = whitening.fit(materialise(whitening.number_blocks(frame(spark, rows)), "v"))
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 100)
    many = whitening.fit(materialise(whitening.number_blocks(frame(spark, rows)), "v"))
    assert one.sums == many.sums
    assert np.allclose(one.components, many.components, atol=1e-9)
