"""Merkle manifest against a plain recomputation, and its states against whole hashing."""

import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salespark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, place long, steps string"


def h(*parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h(*(field(v) for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        out.append((run[:at % 8], run[at % 8 + 1:]))
        at //= 8
    return out


def plain(rows):
    """Every digest made anew, whole runs at a time."""
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, text, lang, source, n_chars)
        new = own
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            new = leaf(doc_id, lower, lang, source, n_chars)
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, doc_id, new))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([r[2] for r in sorted(groups[g])]) for g in names}
    upper = climb([trees[g][-1][0] for g in names])
    root, out = upper[-1][0], []
    for k, g in enumerate(names):
        for at, (*_, own, doc_id, new) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], at) + siblings(upper, k)
            cur = new
            for left, right in path:
                cur = h(*left, cur, *right)
            out.append((doc_id, own, trees[g][-1][0], root, h(*(x for l, r in path for x in l + r)), cur, cur == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in manifest.tamper_check(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def row(doc_id, text, lang, source="s", n_chars=3):
    return (doc_id, text, lang, source, n_chars, "x", 1, "y")


def test_blocks_and_rounds(spark, monkeypatch):
    """A group over several blocks of leaves, a lone leaf, and a last run of one."""
    rows = [row(i, f"Text {i} É", "en") for i in range(2 * manifest.BLOCK + 1)]
    rows += [row(i, "AB", "de") for i in range(10_000, 10_009)] + [row(99_999, "Lone", "xx")]
    check(spark, rows)


def test_many_groups(spark):
    check(spark, [row(i, "T", f"g{i % 75}" if i % 75 else None) for i in range(300)])


def test_edges(spark):
    """Nulls in every column, the text ``-``, repeated rows and ids, empty and long texts."""
    rows = [row(None, None, None, None, None), row(None, "Ab", None), row(None, None, None, None, None),
            row(3, "-", "-"), row(3, None, "-"), row(3, "", ""), row(3, "", ""), row(5, "Z" * 300_000, "é"),
            row(6, "日本 ABC 🙂", "+")] + [row(7, "same", "en")] * 20
    check(spark, rows)


def test_one_document_is_the_root(spark):
    check(spark, [row(1, "Alone", "en")])


def test_empty_table(spark):
    assert manifest.tamper_check(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 600), st.data())
def test_resumed_states_equal_whole_hashing(n, data):
    nodes = [h(str(i)) for i in range(n)]
    levels = climb(nodes)
    tree = manifest.Tree(nodes, manifest.levels_above(n))
    assert tree.nodes == levels[-1]
    at, new = data.draw(st.integers(0, n - 1)), h("new")
    path = tree.path(at)
    again = climb([*nodes[:at], new, *nodes[at + 1:]])[-1][0]
    assert manifest.fold(new, path) == again
    # the packed form keeps siblings and states
    back = manifest.path_of(manifest.packed_steps(path))
    assert manifest.fold(new, back) == again and manifest.proof(back) == manifest.proof(path)


def test_fold_never_hashes_the_left_again():
    """A path without its left siblings folds alike: the state holds them."""
    nodes = [h(str(i)) for i in range(64)]
    tree = manifest.Tree(nodes, 2)
    path = [(state, "", right) for state, _, right in tree.path(37)]
    assert manifest.fold(nodes[37], path) == tree.nodes[0]


@pytest.mark.parametrize("n,levels", [(0, 0), (1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (512, 3), (513, 4)])
def test_levels(n, levels):
    assert manifest.levels_above(n) == levels
