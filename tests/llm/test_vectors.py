"""Codes against a full search, whitening against a dense eigendecomposition, both with hostile vectors."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from gradewell.llm.vector_codes import choose_pivots, code_report, compress, distances, nearest
from gradewell.llm.vectors import combined
from gradewell.llm.whitening import Spectrum, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, near string, component string, n string"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names the operators use."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(5)


def random_rows(seed, n, dims):
    pick = random.Random(seed)
    rows = [(i, [pick.gauss(0, 0.2) for _ in range(dims)], pick.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(n + i, list(rows[i % 7][1]), 2) for i in range(n // 3)]  # copies of a few
    return rows


ODD = [(900, None, 1), (901, [0.1] * 3, 1), (902, [0.5, None, 0.1, 0.2] * 8, 1), (903, [0.5, float("nan"), 0.1, 0.2] * 8, 1),
       (904, [float("inf")] * 32, 1), (905, [], 1), (None, [0.25] * 32, 3), (906, [-0.0] * 32, None), (906, [1e-20, -1e-20] * 16, None),
       (907, [3e38] * 32, 1)]


def whole(rows, dims):
    out = []
    for i, v, label in rows:
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 2**54 for c in v):
            out.append((i, [math.floor(256 * float(np.float32(c))) for c in v], label))
    return out


def full_search(rows, parts, entries, rounds):
    """The same rules with Python's integers and every distance."""
    size = len(rows[0][1]) // parts
    by_id = defaultdict(list)
    for i, x, _ in rows:
        if i is not None:
            by_id[i].append(x)
    first = [min(by_id[i]) for i in sorted(by_id)[:entries]]
    books = [[x[m * size: (m + 1) * size] for x in first] for m in range(parts)]

    def assign():
        found = []
        for _, x, _ in rows:
            own = []
            for m in range(parts):
                cut = x[m * size: (m + 1) * size]
                own.append(min((sum((a - b) ** 2 for a, b in zip(cut, e)), k) for k, e in enumerate(books[m])))
            found.append(own)
        return found

    for _ in range(rounds):
        found = assign()
        for m in range(parts):
            for k in range(len(books[m])):
                mine = [x[m * size: (m + 1) * size] for (_, x, _), own in zip(rows, found) if own[m][1] == k]
                if mine:
                    books[m][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    codes = ["".join(f"{k:02x}" for _, k in own) for own in found]
    errors = [sum(d for d, _ in own) for own in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(rows, codes, errors)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_like_a_full_search(spark, seed):
    rows = random_rows(seed, 120, 32) + ODD
    got = sorted((tuple(r) for r in code_report(vectors(spark, rows), parts=8, entries=20).collect()), key=repr)
    assert got == full_search(whole(rows, 32), 8, 20, 2)


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    rows, entries = rng.integers(-60, 60, (3000, 4)), rng.integers(-60, 60, (64, 4))
    pivots = choose_pivots(entries)
    code, best, evaluated = nearest(rows, distances(rows, pivots), entries, distances(entries, pivots))
    every = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < every.size / 4


def test_very_large_numbers_stay_exact(spark):
    rows = [(i, [random.Random(i).choice([-1, 1]) * 2.0 ** random.Random(i + k).randint(0, 50) for k in range(8)], i % 2) for i in range(40)]
    got = {r["vec_id"]: r for r in compress(vectors(spark, rows), "vec_id", parts=2, entries=5)[0].collect()}
    want = full_search(whole(rows, 8), 2, 5, 2)
    assert {(i, c, e) for i, c, e, _, _ in want} == {(i, r["code"], int(r["error"])) for i, r in got.items()}
    fits = {r["vec_id"]: r["error"] for r in code_report(vectors(spark, rows), parts=2, entries=5).collect()}
    assert fits == {i: e if e < 2**63 else None for i, _, e, _, _ in want}


def test_codes_of_few_and_no_vectors(spark):
    assert code_report(vectors(spark, [])).collect() == []
    assert code_report(vectors(spark, [(1, None, 1), (2, [None], 1)])).collect() == []
    assert code_report(vectors(spark, [(None, [0.5] * 16, 1)])).collect() == []
    one = code_report(vectors(spark, [(5, [0.5] * 16, None)] * 3)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)] * 3
    # A length that sixteen does not divide is filled with zeros.
    filled = code_report(vectors(spark, [(i, [i / 4] * 5, 1) for i in range(4)])).collect()
    assert sorted((r["code"][:10], r["error"]) for r in filled) == [(f"0{i}" * 5, 0) for i in range(4)]


def test_rank_one_updates_keep_the_decomposition():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 24):
        for _ in range(25):
            rows = np.round(rng.normal(size=(rng.integers(1, 3 * n + 2), n)) * rng.choice([1, 3, 50])) * rng.choice([0, 1], size=n)
            values, vectors = np.zeros(n), np.eye(n)
            for row in rows:
                values, vectors = rank_one(values, vectors, row)
            want = rows.T @ rows
            scale = max(1, np.abs(want).max())
            assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() < 1e-11 * scale
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11
            assert (np.diff(values) >= 0).all()


def test_spectra_of_blocks_single_rows_and_merges_agree():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(400, 6)) * [100, 50, 50, 3, 1, 0] + 1000)
    single, block, left, right = (Spectrum.none(6) for _ in range(4))
    for row in rows:
        single.add(row[None])
    block.add(rows)
    left.add(rows[:5])
    right.add(rows[5:])
    left.merge(right)
    scatter = (rows - rows.mean(axis=0)).T @ (rows - rows.mean(axis=0))
    for s in (single, block, left):
        assert s.n == 400 and np.allclose(s.mean, rows.mean(axis=0))
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-8 * np.abs(scatter).max()


@pytest.mark.parametrize("seed,dims", [(1, 32), (2, 32)])
def test_whitened_like_a_dense_decomposition(spark, seed, dims):
    rows = random_rows(seed, 200, dims) + ODD
    kept = whole(rows, dims)
    x = np.array(sorted({tuple(v) for _, v, _ in kept}), float)
    n, sums, mean = len(x), x.sum(axis=0), x.mean(axis=0)
    values, basis = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = defaultdict(list)
    out = whiten(vectors(spark, rows), "vec_id").collect()
    for r in out:
        got[r["vec_id"], r["component"]].append(r)
    assert len(out) == 4 * len(kept)
    sign = {}
    for k in range(4):
        biggest = max(kept, key=lambda r: abs((np.array(r[1]) - mean) @ basis[:, k]) * (r[0] is not None))
        sign[k] = np.sign((np.array(biggest[1]) - mean) @ basis[:, k] * got[biggest[0], k + 1][0]["whitened"])
    for i, v, _ in kept:
        for k in range(4):
            want = sign[k] * ((np.array(v) - mean) @ basis[:, k]) / np.sqrt(values[k])
            deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
            assert any(abs(r["whitened"] - want) < 1e-9 and r["deviation"] == deviation for r in got[i, k + 1])
    for r in out:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9


def test_whitening_without_variance(spark):
    assert whiten(vectors(spark, []), "vec_id").collect() == []
    assert whiten(vectors(spark, [(1, None, 1)]), "vec_id").collect() == []
    assert whiten(vectors(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 4, 1)]), "vec_id").collect() == []
    two = whiten(vectors(spark, [(1, [0.5] * 4, 1), (2, [1.0] * 4, 1), (2, [1.0] * 4, 1)]), "vec_id").collect()
    assert sorted((r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two) == [
        (1, 1, 2, 1, 1), (2, 1, 2, 1, 1), (2, 1, 2, 1, 1)]


def test_deviation_beyond_a_long_is_null(spark):
    out = whiten(vectors(spark, [(1, [2.0**40, 0.0], 1), (2, [0.0, 1.0], 1)]), "vec_id").collect()
    assert {r["deviation"] for r in out} == {None}


def test_results_of_many_tasks_are_combined_in_levels(spark):
    parts = spark.range(0, 700, 1, 9).selectExpr("id as part", "cast(cast(id as string) as binary) as payload")
    assert combined(parts, lambda p: str(sum(int(b) for b in p)).encode()) == str(sum(range(700))).encode()
    assert combined(parts.where("part < 0"), lambda p: p[0]) is None


