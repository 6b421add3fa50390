"""Hard negatives against brute force, and the walks against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespark.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, x string, tie int, rank int, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "a") for r in rows], SCHEMA)


def plain(rows):
    ok = []
    for n, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        ok.append((n, vec_id, label, [math.floor(256 * v) for v in x]))
    out = []
    for n, vec_id, label, x in ok:
        if vec_id is None or vec_id % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0, m, lab) for m, i, lab, y in ok if m != n)
        name = lambda r: None if r[1] else r[2]
        for p in [r for r in scored if r[4] == label][:5]:
            near = [r for r in scored if r[4] != label and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:3]
            out += [(vec_id, name(p), k, name(r), -p[0], -r[0]) for k, r in enumerate(near, 1)]
    return out


def check(spark, rows):
    got = hardneg.mine(frame(spark, rows).coalesce(1), hardneg.op12_anchor(), hardneg.op12_label()).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    return got


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 4)


def random_rows(n, dim=8, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, dim))
    labels = rng.integers(0, 10, n)
    x = middle[labels] + spread * rng.normal(size=(n, dim))
    return [(i, x[i].round(3).tolist(), int(labels[i])) for i in range(n)]


def test_equals_brute_force(spark):
    assert check(spark, random_rows(600))


def test_blocks_of_anchors(spark, small_blocks):
    assert check(spark, random_rows(400, seed=2))


def test_ties_and_repeated_rows(spark):
    """Equal vectors, equal ids with equal and with other vectors, null ids."""
    rows = [(i, [float(i % 4), 1.0, 0.5], i % 3) for i in range(120)]
    rows += [(50, [1.0, 1.0, 0.5], 2), (50, [1.0, 1.0, 0.5], 2), (50, [3.0, 0.0, 1.0], 1), (None, [1.0, 1.0, 0.5], 2),
             (None, [2.0, 1.0, 0.0], 0)]
    assert check(spark, rows)


def test_rows_that_take_no_part(spark):
    rows = random_rows(200, seed=3) + [(250, None, 1), (300, [1.0] * 8, None), (350, [None] * 8, 1),
                                       (400, [float("nan")] * 8, 2), (450, [float("inf")] * 8, 2)]
    assert {r.anchor_id for r in check(spark, rows)} <= {0, 50, 100, 150}


def test_lengths_zero_and_huge(spark):
    """Vectors of other lengths count as padded; zero vectors score 0; scores pass 2^53."""
    rows = [(0, [1e7, 2e7], 1), (50, [], 1), (100, [0.0, 0.0], 2), (150, [1e7, 2e7, 3.0, 4.0], 2)]
    rows += [(1 + i, [1e7 + i, 2e7 - i / 3], i % 4) for i in range(40)] + [(200 + i, [3.0, i / 2.0, 1.0], i % 4) for i in range(1, 30)]
    assert check(spark, rows)


def test_no_anchor_no_rows(spark):
    assert check(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert hardneg.mine(frame(spark, []), hardneg.op12_anchor(), hardneg.op12_label()).count() == 0


def test_walk_ends_early_and_is_exact():
    """Where bounds tell candidates apart, most are never scored."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.normal(size=(20, 8)) * 0.05 + 1, rng.normal(size=(40_000, 8)) * 0.05 - 1]))
    members = np.floor(256 * (rng.normal(size=(16, 8)) * 0.05 + 1))
    lists, n = hardneg.Lists(x), len(members)
    ids = np.arange(len(x))
    score, who, spent = hardneg.walk(lists, members, lambda m, some: np.ones((len(m), len(some)), bool),
                                     np.full(n, -2 ** 62), np.full(n, 2 ** 62), np.arange(n), (ids, ids), 5)
    whole = (members @ x.T).astype(np.int64)
    for m in range(n):
        assert who[m].tolist() == np.lexsort((ids, -whole[m]))[:5].tolist()
    assert spent <= n * 2 * hardneg.STRETCH


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, members = np.floor(rng.normal(size=(500, 6)) * 300), np.floor(rng.normal(size=(9, 6)) * 300)
    members[0] = 0
    bound = hardneg.Lists(x).bounds(members)
    size = np.sqrt((members ** 2).sum(axis=1))
    assert (members @ x.T <= size[:, None] * bound[None, :] + 1e-6).all()


def test_labels_move_on(spark):
    rows = frame(spark, [(7, [1.0], 9), (8, [1.0], 9), (0, [1.0], 3)])
    assert [r[0] for r in rows.select(hardneg.op12_label()).collect()] == [0, 9, 4]
    assert [r[0] for r in rows.select(F.coalesce(hardneg.op12_anchor(), F.lit(False))).collect()] == [False, False, True]
