"""Merkle manifest of a table, with SHA-256 states kept before each child slot.

A row's leaf is the digest of its fields.  The leaves of a group (language) are its
tree's lowest nodes, in order of doc_id; every ``FAN`` consecutive nodes have one
parent, until one node remains: the group's subroot.  Subroots, in order of the
group, have a tree of their own, whose top is the root.

Work goes by blocks of ``BLOCK`` consecutive nodes, which is a whole number of
levels, so a block's part of the tree needs no other block:

1. leaves are hashed by DataFrame functions, and only digests move from then on;
2. a range partitioning gives every leaf its place in its group (rows of each
   partition and group are counted, and running sums of the counts added), so no
   group, however large, lies in one task;
3. a task hashes a block up to its top; the tops are the nodes of the next round;
4. going down again, each node gets its *steps*: at each level above it the
   siblings on its left and on its right;
5. a block's task hashes its part of the tree once more.  A parent keeps a copy of
   the hash state before each child.  A replaced leaf is folded up by resuming the
   state before its slot with the replacement and the siblings on the right only;
   what stands to the left is never hashed again.  The levels above the block are
   states as well, made from the steps once a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespark.llm import common

FAN = 8
#: Levels and nodes of a block.
LEVELS = 3
BLOCK = FAN ** LEVELS
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODES = "grp string, block long, many long, digests binary, top binary"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**changed: Column) -> Column:
    """Hex digest of a row's fields; ``changed`` stands in for columns by name."""
    return F.sha2(F.concat(*(field_text(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def group_key(lang: Column) -> Column:
    """The group as a text that is never null and sorts like the language, null first."""
    return F.coalesce(F.concat(F.lit("+"), lang.cast("string")), F.lit(""))


def levels_above(many: int) -> int:
    """Levels from ``many`` nodes to the one that remains."""
    n = 0
    while many > 1:
        many, n = -(-many // FAN), n + 1
    return n


def _hex(digests: bytes) -> list[str]:
    text = digests.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i:i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]


class Tree:
    """Part of a tree: ``levels`` levels over given nodes, with a state before each slot."""

    def __init__(self, nodes: list[str], levels: int):
        #: by level, by parent: (state before the slot, left siblings, right siblings) of each child
        self.levels: list[list[tuple]] = []
        for _ in range(levels):
            slots, above = [], []
            for i in range(0, len(nodes), FAN):
                run, state = nodes[i:i + FAN], sha256()
                for k, child in enumerate(run):
                    slots.append((state.copy(), "".join(run[:k]), "".join(run[k + 1:])))
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.levels.append(slots)
            nodes = above
        self.nodes = nodes

    def path(self, at: int) -> list[tuple]:
        """(state, left, right) of a node and of its ancestors."""
        out = []
        for slots in self.levels:
            out.append(slots[at])
            at //= FAN
        return out


def fold(replacement: str, path: list[tuple]) -> str:
    """The top over a replaced node: each level's state goes on from its slot."""
    for state, _, right in path:
        now = state.copy()
        now.update((replacement + right).encode())
        replacement = now.hexdigest()
    return replacement


def proof(path: list[tuple]) -> str:
    """Digest of all siblings of a path, level by level, left to right."""
    return sha256("".join([left + right for _, left, right in path]).encode()).hexdigest()


def packed_steps(path: list[tuple]) -> bytes:
    """Siblings of a path as bytes: per level how many stand left and right, then they."""
    return b"".join([bytes([len(left) // 64, len(right) // 64]) + bytes.fromhex(left + right)
                     for _, left, right in path])


def path_of(steps: bytes) -> list[tuple]:
    """A path from its packed siblings, the state before its slot made anew."""
    out, at = [], 0
    while at < len(steps):
        left, right = steps[at], steps[at + 1]
        middle, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        before = steps[at + 2:middle].hex()
        out.append((sha256(before.encode()), before, steps[middle:end].hex()))
        at = end
    return out


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) and their 0-based ``place`` in their group by ``order``,
    a total order, and ``many``, the rows of the group."""
    keys = ["grp", *order]
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, seq = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for grp in batch.column("grp").to_pylist():
                if grp != now:
                    now, seq = grp, 0
                numbers.append(seq)
                seq += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())],
                [*batch.schema.names, "part", "seq"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())])
    numbered = common.written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "manifest-order")
    counts = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    offsets = counts.select("grp", "part", F.sum("n").over(group).alias("many"),
                            (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(offsets, ["grp", "part"]).select(
        *names, "many", (F.col("before") + F.col("seq")).alias("place"))


def blocks(nodes: DataFrame, digest: str, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row a block of (grp, place, many, ``digest``): its digests in order and its
    top; columns of ``extra`` (name, type long or binary) become arrays or joined bytes."""
    def run(batches):
        import pyarrow as pa

        key, held = None, None

        def closed():
            grp, block = key
            levels = min(LEVELS, levels_above(held["many"]))
            found = _hex(b"".join(held["digest"]))
            top = found
            for _ in range(levels):
                top = _parents(top)
            columns = [pa.array([grp]), pa.array([block]), pa.array([held["many"]]),
                       pa.array([b"".join(held["digest"])], pa.binary()), pa.array([bytes.fromhex(top[0])], pa.binary())]
            for name, kind in extra:
                columns.append(pa.array([held[name]], pa.list_(pa.int64())) if kind == "long"
                               else pa.array([b"".join(held[name])], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["grp", "block", "many", "digests", "top", *(n for n, _ in extra)])

        for batch in batches:
            lists = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i, (grp, place) in enumerate(zip(lists["grp"], lists["place"])):
                if key != (grp, place // BLOCK):
                    if key is not None:
                        yield closed()
                    key, held = (grp, place // BLOCK), {"many": lists["many"][i], "digest": [], **{n: [] for n, _ in extra}}
                held["digest"].append(lists["digest"][i])
                for name, _ in extra:
                    held[name].append(lists[name][i])
        if key is not None:
            yield closed()

    schema = _NODES + "".join(f", {n} {'array<long>' if k == 'long' else k}" for n, k in extra)
    block = F.expr(f"place div {BLOCK}").alias("block")
    return (nodes.select("grp", "place", "many", F.col(digest).alias("digest"), *(n for n, _ in extra), block)
            .repartition("grp", "block").sortWithinPartitions("grp", "place").drop("block").mapInArrow(run, schema))


def _tops(rows: DataFrame) -> DataFrame:
    """The nodes that blocks leave to the next round."""
    return rows.select("grp", F.col("block").alias("place"), F.expr(f"(many + {BLOCK - 1}) div {BLOCK}").alias("many"),
                       F.col("top").alias("digest"))


def raised(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks above (grp, place, many, digest), and (grp, digest) of what remains."""
    rounds = []
    while (nodes.agg(F.max("many")).first()[0] or 0) > 1:
        rounds.append(common.written(blocks(nodes, "digest"), "manifest-nodes"))
        nodes = _tops(rounds[-1])
    return rounds, nodes.select("grp", "digest")


def lowered(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, block, more columns of ``above``, steps) of the nodes under ``rounds``;
    ``above`` has (grp, ..., steps) of every group's one remaining node."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for grp, block, many, digests in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "many", "digests"))):
                nodes = _hex(digests)
                tree = Tree(nodes, min(LEVELS, levels_above(many)))
                n = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * n), pa.array([block] * n, pa.int64()),
                     pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()),
                     pa.array([packed_steps(tree.path(i)) for i in range(n)], pa.binary())],
                    ["grp", "block", "place", "own"])

    more = [c for c in above.columns if c not in ("grp", "steps")]
    found = above.withColumn("block", F.lit(0).cast("long"))
    for rows in reversed(rounds):
        own = rows.select("grp", "block", "many", "digests").mapInArrow(
            run, "grp string, block long, place long, own binary")
        found = own.join(found, ["grp", "block"]).select(
            "grp", F.col("place").alias("block"), *more, F.concat("own", "steps").alias("steps"))
    return found.select("grp", "block", *more, "steps")


@dataclass
class Manifest:
    """A built tree: ``blocks`` of leaves (grp, block, many, digests, top and the given
    columns), ``steps`` (grp, block, subroot, steps to the root) and the root's hex
    digest (None for an empty table)."""

    blocks: DataFrame
    steps: DataFrame | None
    root: str | None


def build(leaves: DataFrame, order: list[str], extra: tuple[tuple[str, str], ...] = ()) -> Manifest:
    """Manifest of (grp, leaf as bytes, columns of ``order`` and ``extra``).

    Leaves of a group go by ``order``; rows equal in it by their leaf, and rows equal
    in that too can change places without any digest changing.
    """
    common.ship(leaves.sparkSession)
    leaves = common.written(leaves.withColumn("__salt", F.monotonically_increasing_id()), "manifest-leaves")
    nodes = placed(leaves, [*order, "leaf", "__salt"])
    rows = common.written(blocks(nodes, "leaf", extra), "manifest-blocks")
    rounds, subroots = raised(_tops(rows))
    subroots = common.written(subroots, "manifest-subroots")
    # subroots by group: the same, as one group
    upper = common.written(placed(subroots.select(
        F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"]), "manifest-groups")
    upper_rounds, top = raised(upper)
    top = top.first()
    if top is None:
        return Manifest(rows, None, None)
    one = top.asDict()
    above = rows.sparkSession.createDataFrame([("", b"")], "grp string, steps binary")
    over = lowered(upper_rounds, above)
    named = upper.join(over.select(F.col("block").alias("place"), "steps"), "place").select(
        F.col("name").alias("grp"), F.col("digest").alias("subroot"), "steps")
    return Manifest(rows, common.written(lowered(rounds, named), "manifest-steps"), bytes(one["digest"]).hex())


def verify(manifest: Manifest, name: str, changed: str) -> DataFrame:
    """One row a leaf: its ``name``, leaf, subroot, root, proof_sha256, folded_root over
    the leaf in ``changed`` and whether that equals the root.  ``name`` (long) and
    ``changed`` (binary) are extra columns of the manifest."""
    schema = f"{name} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = manifest.root
    if root is None:
        return manifest.blocks.sparkSession.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for many, digests, ids, new, subroot, steps in zip(*(batch.column(c).to_pylist() for c in (
                    "many", "digests", name, changed, "subroot", "steps"))):
                nodes = _hex(digests)
                tree, above = Tree(nodes, min(LEVELS, levels_above(many))), path_of(steps)
                paths = [tree.path(i) + above for i in range(len(nodes))]
                folded = [fold(x, p) for x, p in zip(_hex(new), paths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(nodes), pa.array([subroot.hex()] * len(nodes)),
                     pa.array([root] * len(nodes)), pa.array([proof(p) for p in paths]), pa.array(folded),
                     pa.array([f == root for f in folded])], [f.split()[0] for f in schema.split(", ")])

    rows = manifest.blocks.select("grp", "block", "many", "digests", name, changed)
    return rows.join(manifest.steps, ["grp", "block"]).mapInArrow(run, schema)


def tamper_check(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, and each document folded to the root after tampering.

    One row per row of ``docs``.  Where 3 divides the crc32 of doc_id in decimal, the
    text's A-Z are lower-cased and the leaf computed anew; a null doc_id has no
    decimal form and its row is never tampered with.  Nulls of any column are ``-`` in
    a leaf, apart from an empty text (``0:``).  A null language is a group of its own
    and the first; null doc_ids are first in their group; rows of one doc_id go by
    their leaf.  An empty table has no rows.
    """
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    new = F.when(hit, leaf_digest(text=F.translate(text, UPPER, LOWER)))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("lang")).alias("grp"),
        leaf_digest().alias("leaf"), new.alias("changed")).select(
        "doc_id", "grp", F.unhex("leaf").alias("leaf"), F.unhex(F.coalesce("changed", "leaf")).alias("changed"))
    built = build(leaves, ["doc_id"], (("doc_id", "long"), ("changed", "binary")))
    return verify(built, "doc_id", "changed")


def oracle(levels: int = 7, group_levels: int = 2) -> str:
    """The same result as DuckDB SQL, for groups of at most ``FAN ** levels`` rows."""
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(d.doc_id::VARCHAR) + 1), "
           "lambda i: ord(substr(d.doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
           "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")

    def leaf(text: str) -> str:
        values = [text if c == "text" else f"d.{c}" for c in FIELDS]
        return "sha256(" + " || ".join(
            f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"

    lower = f"translate(d.text, '{UPPER}', '{LOWER}')"
    ctes = [f"""d AS (SELECT *, coalesce('+' || lang, '') AS grp FROM documents)""",
            f"""l AS (SELECT d.doc_id, d.grp, {leaf('d.text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('d.text')} END AS changed FROM d)""",
            """n0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY grp) AS many FROM l)""",
            "a0 AS (SELECT grp, place, many, leaf AS digest FROM n0)",
            "p0 AS (SELECT doc_id, grp, leaf, place, many, changed AS folded, '' AS siblings FROM n0)"]

    def climb(prefix: str, path: str, group: str, n: int) -> str:
        """Level by level: nodes ``prefix<k>`` and paths ``path<k>`` of all documents."""
        for k in range(n):
            ctes.append(f"""{prefix}r{k} AS (SELECT {group}, place // {FAN} AS up, min(many) AS many,
  list(digest ORDER BY place) AS run FROM {prefix}{k} GROUP BY {group}, place // {FAN})""")
            ctes.append(f"""{prefix}{k + 1} AS (SELECT {group}, up AS place, (many + {FAN - 1}) // {FAN} AS many,
  CASE WHEN many = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {prefix}r{k})""")
            left, right = f"array_to_string(r.run[1:p.place % {FAN}], '')", f"array_to_string(r.run[p.place % {FAN} + 2:], '')"
            ctes.append(f"""{path}{k + 1} AS (SELECT p.* EXCLUDE (place, many, folded, siblings), p.place // {FAN} AS place,
  (p.many + {FAN - 1}) // {FAN} AS many,
  CASE WHEN p.many = 1 THEN p.folded ELSE sha256({left} || p.folded || {right}) END AS folded,
  CASE WHEN p.many = 1 THEN p.siblings ELSE p.siblings || {left} || {right} END AS siblings
  FROM {path}{k} p JOIN {prefix}r{k} r ON r.{group} = p.{group} AND r.up = p.place // {FAN})""")
        return f"{prefix}{n}"

    subroots = climb("a", "p", "grp", levels)
    ctes.append(f"""b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY encode(grp)) - 1 AS place, count(*) OVER () AS many,
  digest, grp FROM {subroots})""")
    ctes.append(f"""q0 AS (SELECT p.doc_id, p.leaf, p.folded, p.siblings, b.digest AS subroot, b.place, b.many, 0 AS one
  FROM p{levels} p JOIN b0 b ON b.grp = p.grp)""")
    root = climb("b", "q", "one", group_levels)
    return "WITH " + ",\n".join(ctes) + f"""
SELECT q.doc_id, q.leaf, q.subroot, r.digest AS root, sha256(q.siblings) AS proof_sha256,
  q.folded AS folded_root, q.folded = r.digest AS verified FROM q{group_levels} q, {root} r"""
