"""Merkle manifest of a table, with versions made by copying paths.

Leaves of a group are numbered in order and cut into aligned blocks of 2**BLOCK_BITS.
A block's nodes are built in one task; block roots are the leaves of the next level's
blocks, until one node of each group is left. The groups' nodes are then treated as one
more group. A changed leaf makes a version of its block that copies the leaf's
ancestors and shares every other node with the block it was made from; above the block,
the version goes on over the untouched nodes that lie beside its path in the upper
blocks. Those are joined to each block once, whatever number of versions it has.

Digests are lowercase hex SHA-256, of the children's digests as hex text. While a level
has several nodes, every two consecutive ones have a parent, a last single one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occuspan.llm.common import quoted, shared_folder, stage
from occuspan.operators.numbering import number_rows

BLOCK_BITS = 10
PATH = T.ArrayType(T.StructType([T.StructField("left", T.BooleanType()), T.StructField("digest", T.StringType())]))
ARROW_PATH = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
ROOT_GROUP = "root"


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field_text(value: Column) -> Column:
    """A value with its length in bytes, so that neighbouring fields can't be confused; `-` for null."""
    data = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(data).cast("string"), F.lit(":"), data), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, values)).cast("binary"), 256)


class Block:
    """All nodes over consecutive leaves, level by level; never changed once built."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    def root(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[bool, bytes]]:
        """What lies beside the path from a leaf upwards: (is it on the left, digest or empty)."""
        beside = []
        for nodes in self.levels[:-1]:
            other = at ^ 1
            beside.append((bool(at & 1), nodes[other] if other < len(nodes) else b""))
            at >>= 1
        return beside

    def version(self, at: int, leaf: bytes) -> Version:
        """A version of the block with another leaf: its path is copied, all else shared."""
        copied = [leaf]
        for nodes in self.levels[:-1]:
            other = at ^ 1
            pair = [copied[-1]] if other >= len(nodes) else [nodes[other], copied[-1]] if at & 1 else [copied[-1], nodes[other]]
            copied.append(digest(*pair))
            at >>= 1
        return Version(self, copied)


@dataclass(frozen=True)
class Version:
    """A block in which one leaf differs: copied[level] stands for the path's node, the rest is the base's."""

    base: Block
    copied: list[bytes]

    def root(self) -> bytes:
        return self.copied[-1]

    def continued(self, path: list[tuple[bool, bytes]]) -> list[bytes]:
        """The copied nodes above the block, to the root of the whole tree."""
        above = [self.root()]
        for left, beside in path:
            above.append(digest(*([beside, above[-1]] if left else [above[-1], beside] if beside else [above[-1]])))
        return above[1:]


def height(nodes: Column) -> Column:
    """Levels above so many nodes: the bits of their number less one."""
    return F.length(F.regexp_replace(F.bin(F.greatest(nodes - 1, F.lit(0))), "^0", "")).cast("int")


def in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes (__g, __pos, __n, ...) with their block, and the levels that are built inside it."""
    return nodes.withColumns({"__block": F.shiftright("__pos", bits), "__levels": F.least(F.lit(bits), height(F.col("__n")))})


def ordered_leaves(table: pa.Table) -> tuple[Block, list[int]]:
    """The block over a group of rows, and the rows' numbers in leaf order."""
    at = table["__pos"].to_pylist()
    order = sorted(range(len(at)), key=at.__getitem__)
    leaves = table["__node"].to_pylist()
    return Block([leaves[i].encode() for i in order], table["__levels"][0].as_py()), order


def block_roots(nodes: DataFrame) -> DataFrame:
    """One node for each block: __g, __pos, __node."""
    schema = T.StructType([nodes.schema["__g"], T.StructField("__pos", T.LongType()), T.StructField("__node", T.StringType())])

    def build(table: pa.Table) -> pa.Table:
        block, _ = ordered_leaves(table)
        first = table.slice(0, 1)
        return pa.table([first["__g"], first["__block"].cast(pa.int64()), pa.array([block.root().decode()])], names=["__g", "__pos", "__node"])

    return nodes.select("__g", "__pos", "__node", "__block", "__levels").groupBy("__g", "__block").applyInArrow(build, schema)


def paths_within(nodes: DataFrame) -> DataFrame:
    """What lies beside each node's path up to its block's root: __g, __pos, __block, __path."""
    schema = T.StructType(
        [nodes.schema["__g"], T.StructField("__pos", T.LongType()), T.StructField("__block", T.LongType()), T.StructField("__path", PATH)]
    )

    def beside(table: pa.Table) -> pa.Table:
        block, order = ordered_leaves(table)
        paths: list = [None] * len(order)
        for at, row in enumerate(order):
            paths[row] = [{"left": left, "digest": d.decode()} for left, d in block.siblings(at)]
        columns = [table["__g"], table["__pos"].cast(pa.int64()), table["__block"].cast(pa.int64()), pa.array(paths, ARROW_PATH)]
        return pa.table(columns, names=["__g", "__pos", "__block", "__path"])

    return nodes.select("__g", "__pos", "__node", "__block", "__levels").groupBy("__g", "__block").applyInArrow(beside, schema)


def counted(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of nodes of their group."""
    return nodes.join(nodes.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")), "__g")


def climb(leaves: DataFrame, folder: str, name: str, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The node tables of all rounds, leaves first, and what is left: a node for each group."""
    rounds, nodes = [], leaves
    while True:
        rounds.append(nodes)
        roots = stage(block_roots(nodes), folder, f"{name}_roots{len(rounds)}")
        if roots.filter("__pos > 0").isEmpty():
            return rounds, roots.select("__g", "__node")
        nodes = stage(in_blocks(counted(roots), bits), folder, f"{name}_nodes{len(rounds)}")


def descend(rounds: list[DataFrame], top: DataFrame, folder: str, name: str) -> DataFrame:
    """Paths of the first round's blocks to the root: __g, __block, __path. top: __g, __path above the groups' nodes."""
    above = top.select("__g", F.lit(0).cast("long").alias("__block"), "__path")
    for number, nodes in reversed(list(enumerate(rounds[1:]))):
        within = paths_within(nodes).withColumnRenamed("__path", "__within")
        joined = within.join(above, ["__g", "__block"])
        above = stage(joined.select("__g", F.col("__pos").alias("__block"), F.concat("__within", "__path").alias("__path")), folder, f"{name}_paths{number}")
    return above


@dataclass(frozen=True)
class Manifest:
    """A built tree: leaves in blocks, the paths above the blocks, group nodes and the root (None over no rows)."""

    leaves: DataFrame
    paths: DataFrame
    subroots: DataFrame
    root: str | None


def group_key(group: Column) -> Column:
    """A text that orders groups bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build_manifest(rows: DataFrame, leaf: str, order: list[str], group: str, bits: int = BLOCK_BITS) -> Manifest:
    """The tree over the rows' leaf digests: by group, and over the groups.

    leaf names a column of hex digests, never null; order the columns that leaves of a
    group ascend by, nulls first. Rows equal in them ascend by their digest; rows equal
    in that too are leaves of their own. A null group is a group, before all others. All
    columns are kept, under their names. A group may hold any share of the rows: its
    leaves are numbered by range partitions, and no task gets more than a block of them.
    An empty table has no root.
    """
    folder = shared_folder(rows.sparkSession)
    slim = stage(rows.withColumns({"__g": group_key(quoted(group)), "__node": quoted(leaf)}), folder, "leaves")
    numbered = number_rows(slim, "__g", [*order, "__node"], "__pos", folder=f"{folder}/numbered")
    leaves = stage(in_blocks(counted(numbered.withColumn("__pos", F.col("__pos") - 1)), bits), folder, "blocks")
    rounds, subroots = climb(leaves, folder, "group", bits)
    groups = subroots.withColumns({"__of": F.col("__g"), "__g": F.lit(ROOT_GROUP)})
    groups = number_rows(groups, "__g", ["__of"], "__pos", folder=f"{folder}/groups").withColumn("__pos", F.col("__pos") - 1)
    tops = stage(in_blocks(counted(groups), bits), folder, "tops")
    top_rounds, root = climb(tops.drop("__of"), folder, "top", bits)
    found = root.select("__node").first()
    no_path = tops.sparkSession.createDataFrame([(ROOT_GROUP, [])], f"__g string, __path {PATH.simpleString()}")
    above = descend(top_rounds, no_path, folder, "top")
    ranked = tops.join(paths_within(tops).select("__pos", F.col("__path").alias("__within")), "__pos").withColumn("__block", F.shiftright("__pos", bits))
    joined = ranked.join(above.select("__block", F.col("__path").alias("__above")), "__block")
    group_paths = stage(joined.select(F.col("__of").alias("__g"), F.concat("__within", "__above").alias("__path")), folder, "group_paths")
    paths = descend(rounds, group_paths, folder, "group")
    return Manifest(leaves, paths, subroots, found["__node"] if found else None)


RESULT: Mapping[str, T.DataType] = {
    "subroot": T.StringType(),
    "root": T.StringType(),
    "proof": PATH,
    "proof_sha256": T.StringType(),
    "version_root": T.StringType(),
    "copied": T.ArrayType(T.StringType()),
}


def versions(manifest: Manifest, changed: str, keep: list[str], wanted: Iterable[str] = RESULT) -> DataFrame:
    """For each leaf: its proof, and the version that the digest in column `changed` makes of the tree.

    A null in `changed` stands for the leaf itself: its version is made all the same, and
    its root must be the root. `proof` is what lies beside the leaf's path, bottom up, an
    empty digest where a node is alone, `proof_sha256` the digest of all of it; `copied` are the version's own nodes from the leaf
    to the root: everything else is shared with the base. `wanted` selects among these,
    `version_root`, `subroot` and `root`; kept columns named alike give way.
    """
    wanted = list(wanted)
    names = [c for c in keep if c.lower() not in wanted]
    keep = [f"__c{i}" for i in range(len(names))]
    kept = [T.StructField(own, manifest.leaves.schema[c].dataType) for own, c in zip(keep, names, strict=True)]
    schema = T.StructType(kept + [T.StructField(n, RESULT[n]) for n in wanted])
    kinds = {n: ARROW_PATH if n == "proof" else pa.list_(pa.string()) if n == "copied" else pa.string() for n in wanted}
    root = manifest.root
    # The group's node is met after as many levels as the group's leaves need.
    depth = height(F.col("__n")).alias("__depth")
    own = [quoted(c).alias(o) for c, o in zip(names, keep, strict=True)]
    leaves = manifest.leaves.select(*own, quoted(changed).alias("__changed"), "__g", "__pos", "__node", "__block", "__levels", depth)

    def make(table: pa.Table, above: pa.Table) -> pa.Table:
        block, order = ordered_leaves(table)
        path = [(x["left"], x["digest"].encode()) for x in above["__path"][0].as_py()]
        changes, depth = table["__changed"].to_pylist(), table["__depth"][0].as_py()
        within = len(block.levels) - 1
        base = Version(block, [block.root()])
        subroot = [block.root(), *base.continued(path)][depth - within].decode()
        made: dict[str, list] = {n: [None] * len(order) for n in wanted}
        for at, row in enumerate(order):
            version = block.version(at, changes[row].encode() if changes[row] is not None else block.levels[0][at])
            above_block = version.continued(path)
            values = {"subroot": subroot, "root": root, "version_root": (above_block or version.copied)[-1].decode()}
            if "proof_sha256" in made:
                values["proof_sha256"] = digest(*(d for _, d in block.siblings(at) + path)).decode()
            if "copied" in made:
                values["copied"] = [d.decode() for d in version.copied + above_block]
            if "proof" in made:
                values["proof"] = [{"left": left, "digest": d.decode()} for left, d in block.siblings(at) + path]
            for name in wanted:
                made[name][row] = values[name]
        return pa.table([table[c] for c in keep] + [pa.array(made[n], kinds[n]) for n in wanted], names=[*keep, *wanted])

    grouped = leaves.groupBy("__g", "__block").cogroup(manifest.paths.groupBy("__g", "__block"))
    return grouped.applyInArrow(make, schema).select(*(F.col(o).alias(c) for c, o in zip(names, keep, strict=True)), *wanted)
