"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from salespark.llm import simhash


def fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    codes = np.array(fps, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1:]) <= distance).tolist():
            a, b = find(i), find(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_documents(docs, texts):
    keys = sorted(texts)
    fps = [fingerprint(texts[k]) for k in keys]
    want = {k: (f"{fp:016x}", keys[root]) for k, fp, root in zip(keys, fps, components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_hot_balls_lose_no_link(spark, monkeypatch):
    """Thousands of fingerprints around a few centres; small blocks deal out hot buckets."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    random.seed(2)
    fps = set()
    for centre in [random.getrandbits(64) for _ in range(3)]:
        for _ in range(400):
            v = centre
            for b in random.sample(range(64), random.randint(0, 5)):
                v ^= 1 << b
            fps.add(v)
    fps |= {random.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    want, got = {}, {}
    for x, root in zip(signed, components(fps)):
        want.setdefault(root, set()).add(x)
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("n", [100, 250_000, 15_000_000, 10**10])
def test_thresholds_satisfy_the_pigeonhole(n):
    near = simhash.cell_distances(np.random.default_rng(0).integers(1, 50, (8, 256)))
    plan = simhash.allot(n, near, 4)
    assert sum(t + 1 for _, _, t in plan) == 5
    cells = [c for first, size, _ in plan for c in range(first, first + size)]
    assert len(cells) == len(set(cells)) and max(cells) < 8


def test_plan_with_probes(spark):
    """Links of a plan with thresholds above zero."""
    random.seed(4)
    base = random.getrandbits(64)
    fps = sorted({base, base ^ 0b1111, base ^ (0xF << 60), base ^ 0x8421, base ^ 0x1F, *(
        random.getrandbits(64) for _ in range(200))})
    signed = np.array(fps, np.uint64).view(np.int64)
    order, plan = list(range(64)), [(0, 4, 1), (4, 4, 2)]
    nodes = spark.createDataFrame([(x,) for x in signed.tolist()], "fp long")
    rows = simhash.signatures(nodes, order, plan).toPandas().sort_values(["part", "value"])
    codes = dict(zip(fps, range(len(fps))))
    met = set()
    for _, group in rows.groupby(["part", "value"]):
        own = [int(np.int64(c).view(np.uint64)) for c in group.code[~group.probe]]
        for c in group.code:
            met |= {frozenset((codes[int(np.int64(c).view(np.uint64))], codes[o])) for o in own}
    for i, a in enumerate(fps):
        for j in range(i + 1, len(fps)):
            if (a ^ fps[j]).bit_count() <= 4:
                assert frozenset((i, j)) in met


def test_edges(spark, edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == len(rows)
    fps = [fingerprint(r.text) for r in rows]
    roots = components(fps)
    want = sorted((r.doc_id if r.doc_id is not None else -1, f"{fp:016x}",
                   min((x.doc_id for x, q in zip(rows, roots) if q == root and x.doc_id is not None), default=-1))
                  for r, fp, root in zip(rows, fps, roots))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint,
                   r.component_id if r.component_id is not None else -1) for r in got) == want
    assert simhash.near_duplicates(no_docs).collect() == []


def test_deduplicated_keeps_one_row_a_component(edge_docs, no_docs, docs, texts):
    kept = simhash.deduplicated(edge_docs).collect()
    assert kept[0].__fields__ == edge_docs.columns
    roots = components([fingerprint(r.text) for r in edge_docs.collect()])
    assert len(kept) == len(set(roots))
    of_kept = components([fingerprint(r.text) for r in kept])
    assert len(set(of_kept)) == len(kept)
    keys = sorted(texts)
    want = {keys[r] for r in components([fingerprint(texts[k]) for k in keys])}
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == want
    assert simhash.deduplicated(no_docs).collect() == []
