"""Nearest neighbours against brute force, with ties, unusable vectors and small tables."""

import numpy as np
import pytest

from salespark.llm import neighbours


def brute(queries, rows, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for name, q in queries:
        q = np.array(q, float)
        score = np.round(unit @ (q / np.linalg.norm(q)), 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != name][:k]
        out[name] = [(int(ids[i]), score[i]) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert set(got) == set(want)
    for name in want:
        assert [i for i, _ in got[name]] == [i for i, _ in want[name]]
        assert [s for _, s in got[name]] == pytest.approx([s for _, s in want[name]], abs=1e-12)


def test_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = found(neighbours.search(vectors.filter("vec_id % 50 = 0"), vectors))
    want = brute([r for r in rows if r[0] % 50 == 0], rows)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.99


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 16) for i in range(300)]  # one vector a third of all
    rows += [(2000, [-v for v in rows[0][1]]), (50, [1.0] * 16)]
    bad = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] + [1.0] * 15),
           (3004, [float("inf")] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, []), (None, [1.0] * 16)]
    vectors = spark.createDataFrame([(*r, 1, "z") for r in rows + bad],
                                    "vec_id long, embedding array<double>, x int, code string").repartition(3)
    queries = vectors.filter("vec_id % 50 = 0")
    got = found(neighbours.search(queries, vectors).filter("query_id <> 50"))  # 50 stands twice: below
    usable = [r for r in rows if r[0] % 50 == 0]
    want = brute([u for u in usable if u[0] != 50], rows)
    same(got, want)
    assert 3000 not in got and all(i < 3000 for v in got.values() for i, _ in v)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(found(neighbours.search(vectors.filter("vec_id % 5 = 0"), vectors)),
         brute([r for r in rows if r[0] % 5 == 0], rows))


def test_few_and_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1e200, 1e200])], "vec_id long, embedding array<double>")
    same(found(neighbours.search(two.filter("vec_id = 0"), two)), {0: [(7, 2 ** -0.5)]})
    none = two.filter("vec_id < 0")
    assert neighbours.search(none, none).collect() == []
    one = two.filter("vec_id = 0")
    assert neighbours.search(one, one).collect() == []


@pytest.mark.parametrize("equal", [False, True])
def test_each_row_of_a_repeated_query_id_has_its_list(spark, equal):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(1, 200) if i != 50]
    twice = [(50, rng.normal(size=12).tolist()) for _ in range(2)]
    if equal:
        twice[1] = twice[0]
    vectors = spark.createDataFrame(rows + twice, "vec_id long, embedding array<double>")
    out = neighbours.search(vectors.filter("vec_id = 50"), vectors).collect()
    assert len(out) == 10
    got = sorted((r["rank"], r.vec_id) for r in out)
    want = sorted((k, i) for q in twice for k, (i, _) in enumerate(brute([q], rows)[50], 1))
    assert got == want


def test_each_length_is_searched(spark):
    """Queries of another length than most vectors neither vanish nor hide the others."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1, 295)]
    rows = [(i, v[:8] if i in (50, 100) or i % 29 == 0 else v) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.search(vectors.filter("vec_id % 50 = 0"), vectors))
    want = {}
    for n in (8, 16):
        of = [r for r in rows if len(r[1]) == n]
        want |= brute([r for r in of if r[0] % 50 == 0], of)
    assert set(want) == {50, 100, 150, 200, 250}
    same(got, want)
