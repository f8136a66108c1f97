"""A Merkle manifest of a dataset: one root digest over all rows, and for each row a short proof that it belongs to the root.

1. *Leaves.* A row's digest is made of its columns, each with its length, so that no two rows read alike. Rows are numbered along
   their id inside their group (:mod:`ranks`): a group may hold any share of the table.
2. *Levels.* Nodes of a level stand in runs of ``arity``. Each node computes the numbers of its siblings (the number with its
   last bit flipped for two, its slot and an offset for more) and meets them by equijoins on that number; numbers are unique, so
   no join has a hot key. The node in slot zero then emits the parent. A tree with a single node left is done.
3. *Trees.* The roots of the groups, in the order of the groups, are the leaves of one more tree.
4. *Proofs.* Going down again, each node joins its own siblings to those of its parent: a row's path has two strings a level, what
   stands before it in its run and what stands behind. Folding a digest along the path gives the root again, or another one if the row
   was changed.

Defined results:
* a null value is a dash, an empty text is not; texts of any length are hashed as they are;
* rows with equal ids are ordered by their digests, null ids before all others; equal rows have equal digests and a place each;
* a null group is a group and comes first, others follow in the order of their bytes; a group of one row has that row's digest as root;
* an empty table has no nodes, no proofs and no root; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import quoted, stored
from spendlake.llm.ranks import numbered

#: The tree over the roots of all groups. Groups are named by "-" (null) or "=" and their value, so none is called so.
TOP = "top"


def value(column: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: Sequence[Column]) -> Column:
    """The digest of a row's values, as hex text."""
    return F.sha2(F.concat(*[value(c) for c in columns]), 256)


def leaves(rows: DataFrame, columns: Sequence[str], id_col: str, group_col: str, carry: Sequence[Column] = ()) -> DataFrame:
    """(tree, idx, size, id, node, ...): the digest of every row, its number in its group and the group's size, and the columns of ``carry``."""
    group = quoted(group_col).cast("string")
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"), quoted(id_col).alias("id"),
        digest([quoted(c) for c in columns]).alias("node"), F.monotonically_increasing_id().alias("salt"), *carry,
    )
    # Written first: the ranges are found by a pass of their own, which must not read and hash the texts again.
    return numbered(stored(named, "merkle-digests"), [F.col("id").asc_nulls_first(), F.col("node"), F.col("salt")], "idx", "tree", "size").drop("salt")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, size, node) with the siblings before and behind each, joined to one text each."""
    slot = F.pmod("idx", F.lit(arity))
    out = nodes.withColumn("slot", slot)
    for offset in range(1, arity):
        other = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + offset, F.lit(arity))
        shifted = nodes.select("tree", F.col("idx").alias("_sibling"), F.col("node").alias(f"_{offset}"))
        out = out.withColumn("_sibling", other).join(shifted, ["tree", "_sibling"], "left").drop("_sibling")
    # Offset o stands in slot (slot + o) mod arity: from arity - slot on before the node, in order; the others behind it.
    at = lambda o, before: F.when((F.col("slot") + o >= arity) == F.lit(before), F.col(f"_{o}"))
    joined = lambda before: F.concat_ws("", *[at(o, before) for o in range(1, arity)])
    return out.select("tree", "idx", "size", "slot", "node", joined(True).alias("before"), joined(False).alias("behind"))


def levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (tree, idx, size, slot, node, before, behind) of all trees over ``nodes`` (tree, idx, size, node), lowest first; and
    (tree, height, root) of each tree. A tree that is done is in no higher level. Each node knows the size of its level, so no join
    is on the tree."""
    below: list[DataFrame] = []
    roots = None
    while True:
        single = nodes.where("size = 1").select("tree", F.lit(len(below)).alias("height"), F.col("node").alias("root"))
        roots = single if roots is None else roots.unionByName(single)
        more = nodes.where("size > 1")
        if more.isEmpty():
            return below, roots
        met = stored(_siblings(more, arity), "merkle-level")
        below.append(met)
        up = [F.expr(f"idx div {int(arity)}").alias("idx"), F.expr(f"(size + {int(arity) - 1}) div {int(arity)}").alias("size")]
        parent = F.sha2(F.concat("node", "behind"), 256)
        nodes = stored(met.where("slot = 0").select("tree", *up, parent.alias("node")), "merkle-nodes")


def _paths(below: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, path, subroot) of the lowest nodes: the siblings of a node and its ancestors, lowest first. ``top`` (tree, height, path,
    subroot) is what follows above the root of each tree. All joins are on a node's number, so a large tree is no hot key."""
    up = None
    for height in range(len(below), -1, -1):
        done = top.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
        if up is not None:
            level = below[height].select(
                "tree", "idx", F.expr(f"idx div {int(arity)}").alias("_up"), F.array(F.struct("before", "behind")).alias("_own")
            )
            above = up.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_above"), "subroot")
            joined = level.join(above, ["tree", "_up"]).select("tree", "idx", F.concat("_own", "_above").alias("path"), "subroot")
            done = done.unionByName(joined)
        up = done
    return up


def fold(node: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["before"], h, s["behind"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path in one digest."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["behind"]))), 256)


def manifest(
    rows: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source", arity: int = 3, carry: Sequence[Column] = ()
) -> DataFrame:
    """One row per row of ``rows``: ``id``, ``tree``, ``leaf``, ``subroot``, ``root``, ``path`` (of structs before, behind), and the columns of ``carry``."""
    if arity < 2:
        raise ValueError("arity must be 2 at least")
    found = stored(leaves(rows, columns, id_col, group_col, carry), "merkle-leaves")
    below, roots = levels(found.select("tree", "idx", "size", "node"), arity)
    roots = stored(roots, "merkle-roots")
    lots = numbered(roots, [F.col("tree")], "idx", total="size")
    named = stored(lots.select(F.lit(TOP).alias("tree"), "idx", "size", F.col("root").alias("node"), F.col("tree").alias("group"), "height"), "merkle-groups")
    above, top = levels(named.select("tree", "idx", "size", "node"), arity)
    ends = stored(top, "merkle-roots").select("tree", "height", F.array().cast("array<struct<before:string,behind:string>>").alias("path"), F.col("root").alias("subroot"))
    # From the root down to the roots of the groups, then on to the leaves.
    upper = _paths(above, ends, arity).select("idx", "path").join(named.select("idx", "group", "height", F.col("node").alias("subroot")), "idx")
    upper = stored(upper.select(F.col("group").alias("tree"), "height", "path", "subroot"), "merkle-upper")
    path = _paths(below, upper, arity)
    root = top.select("root").first()
    out = found.withColumnRenamed("node", "leaf").join(path, ["tree", "idx"])
    kept = [c for c in found.columns if c not in ("tree", "idx", "size", "id", "node")]
    return out.select("id", "tree", "leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", *kept)
