import math
import random

import numpy as np
import pytest

from wardline.llm.common import write_table
from wardline.llm.queries import QUERIES
from wardline.llm.whitening import _limbs, _value, covariance, dimension_sums, fit_whitening, integer_vectors, squared_sums, whitened_embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, id string, n int, component string"


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def integers(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def brute(rows, components=16):
    """n, sums, eigenvalues, eigenvectors and trace from a plain loop over the distinct vectors, in long doubles."""
    fit = np.array(sorted({tuple(integers(v)) for _, v in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums)
    cov = np.array([[float(sum(int(a) * int(b) for a, b in zip(centred[:, i], centred[:, j])) / n**3) for j in range(fit.shape[1])] for i in range(fit.shape[1])])
    values, vectors = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values)[:components] if values[i] > 1e-12 * np.trace(cov)]
    return n, sums, values[order], vectors[:, order], np.trace(cov)


def compare(got, rows, components=16):
    n, sums, values, vectors, trace = brute(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], {}).setdefault(r["component"], []).append(r)
    assert len(got) == len(rows) * len(values)
    signs = {}
    for i, v in rows:
        x = np.array([int(c) for c in integers(v)], dtype=object)
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
        for k in range(len(values)):
            want = float(centred @ vectors[:, k] / np.sqrt(values[k]))
            for r in by_id[i][k + 1]:
                if abs(want) > 1e-6:
                    signs.setdefault(k, math.copysign(1, want * r["whitened"]))
                assert r["whitened"] == pytest.approx(signs.get(k, 1) * want, abs=1e-7)
                assert r["n"] == n and int(r["deviation"]) == deviation and r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
                assert r["identity_error"] < 1e-8


def frame(spark, rows):
    return write_table(spark.createDataFrame([(i, v, 1, "x", "y", 3, "z") for i, v in rows], SCHEMA), "vectors")


def test_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(k, 1 + k / 3) for k in range(20)]) for i in range(120)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[3][1])]
    compare(whitened_embeddings(frame(spark, rows).repartition(5)).collect(), rows)


def test_odd_vectors_take_no_part(spark):
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 2.0]), (94, [float("inf"), 0.0, 1.0]), (95, [1.0, 2.0]), (96, [1.0] * 6)]
    got = whitened_embeddings(frame(spark, good + bad)).collect()
    assert {r["id"] for r in got} == set(range(30))
    compare(got, good)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0**30)) for _ in range(4)]) for i in range(40)]
    compare(whitened_embeddings(frame(spark, rows)).collect(), rows)


def test_huge_components_are_held(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [5.0, 3.0])]
    got = whitened_embeddings(frame(spark, rows)).collect()
    assert {r["id"] for r in got} == {0, 1, 2} and all(math.isfinite(r["whitened"]) for r in got)


def test_without_variance(spark):
    assert whitened_embeddings(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitened_embeddings(frame(spark, [])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitened_embeddings(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_polarised_covariance_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-9, 9) for _ in range(5)]) for i in range(50)]
    vectors = integer_vectors(frame(spark, rows).selectExpr("'f' as _w_file", "1L as _w_row", "vec_id as id", "embedding as vector")).select("vector").distinct()
    n, sums = dimension_sums(vectors)
    squares = squared_sums(vectors, [s // n for s in sums])
    x = [integers(v) for _, v in rows]
    assert n == len({tuple(v) for v in x}) and sums == [sum(c) for c in zip(*{tuple(v) for v in x})]
    z = [[a - s // n for a, s in zip(v, sums)] for v in {tuple(v) for v in x}]
    assert all(squares[i, j] == sum((v[i] + (v[j] if i != j else 0)) ** 2 for v in z) for i in range(5) for j in range(i, 5))
    assert np.allclose(covariance(n, sums, squares), np.cov(np.array(x, dtype=float).T, bias=True), rtol=1e-9)


def test_limbs():
    for v in (0, 1, -1, 2**30, 2**61 + 5, 2**140 + 12345, -(2**70)):
        assert _value(_limbs(v)) == v and sum(map(lambda p: p[0] << (30 * p[1]), ((a + b, k) for k, (a, b) in enumerate(zip(_limbs(v), _limbs(7)))))) == v + 7


def test_components_and_queries(spark, small):
    got = QUERIES["op13_embedding_whitening"](spark, small).collect()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    n, sums, values, _, trace = brute(usable(table))
    assert len(got) == len(usable(table)) * 16 and {r["n"] for r in got} == {n}
    assert sorted({r["explained"] for r in got}, reverse=True) == pytest.approx(list(values / trace), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9 and all(isinstance(r["deviation"], int) for r in got)
    assert fit_whitening(integer_vectors(frame(spark, usable(table)[:200]).selectExpr("'f' as _w_file", "1L as _w_row", "vec_id as id", "embedding as vector")), 3).vectors.shape == (len(table[0][1]), 3)
