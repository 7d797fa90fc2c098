"""Merkle manifest of a dataset: a digest of every row, of every source and of the whole, with proofs.

A row's leaf is the SHA-256 of its fields; the leaves of a source, by id, are the bottom of a tree in
which every ``ARITY`` consecutive nodes become their hash (the last run may be shorter, even a single
node) until one is left, the source's subroot; the subroots, by source, are hashed to the root in the
same way. A row's proof is the list of siblings on its way to the root.

No source is ever one task. Rows are range-partitioned by (source, id); a row's place in its source is
its place in the partition plus the rows of the source in earlier partitions. A *superblock* is
ARITY ** HEIGHT consecutive places, a whole subtree.

*Up.* Superblocks are reduced to their top nodes, which are the leaves of the next exchange, in which
a superblock covers ARITY ** HEIGHT times as many rows; two or three exchanges do for any size. The
subroots go through the same exchanges as one more tree.

*Down.* In each exchange, from the root on, the nodes of a superblock are cogrouped with the outer
nodes it needs (one row: the siblings between its top and the root). One function in applyInPandas
redoes the local reduction, joins the local siblings to the outer ones and hands each node's whole
path to the exchange below; at the leaves it hashes the proof and folds the (perhaps tampered) leaf
up to a root.

Defined cases: null fields, ids and sources count as ``-`` and come first in order; rows of one id
follow by leaf; rows equal in all fields have equal leaves and share their places in any order; an
empty text is a field of no bytes; rows with a null id are never tampered; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.session import cut_lineage

ARITY = 3
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "group long, index long, n long, node string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(text: Column | None = None) -> Column:
    """Hash of a row's fields, each with its length in bytes; ``text`` stands in for the column."""
    def field(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def without_newlines() -> Column:
    """The leaf after tampering: texts of ids with an even checksum lose their line feeds."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return F.when(hit, leaf_of(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf_of())


def levels_of(n: int) -> int:
    """How often n nodes are reduced until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def reduced(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The nodes of a superblock and all levels above them, of a tree of ``n`` nodes in this exchange."""
    levels = [nodes]
    for _ in range(min(height, levels_of(n))):
        below = levels[-1]
        levels.append([digest(*below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after a node, and its ancestors, in their runs, level by level."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + ARITY])))
        at //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before, node, after)
    return node


def _text(path: list[tuple[str, str]]) -> str:
    return "".join(f"{before},{after};" for before, after in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in text.split(";")[:-1]]


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``group`` (ordered as ``by``), ``index`` within it and its size ``n``, in an order that begins with ``by``."""
    stored = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    # One row per partition and group in it: ranges are consecutive, so at most their sum.
    spans = stored.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    line = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        F.col("_part").alias("_span"), "_first", *[F.col(c).alias(f"_by_{c}") for c in by],
        F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.min("_first").over(whole).alias("group"), F.sum("_n").over(whole).alias("n"))
    same = F.col("_part") == F.col("_span")
    for column in by:
        same &= F.col(column).eqNullSafe(F.col(f"_by_{column}"))
    return stored.join(spans, same).select(
        *rows.columns, "group", (F.col("_before") + F.col("_at") - F.col("_first")).alias("index"), "n")


def _block(height: int) -> Column:
    return F.expr(f"index div {ARITY ** height}").alias("block")


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """The top node of every superblock."""
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, block = key
        n = int(rows["n"].iloc[0])
        top = reduced(rows.sort_values("index")["node"].tolist(), n, height)[-1]
        return pd.DataFrame({"group": [group], "index": [block], "n": [-(-n // ARITY ** height)], "node": top})

    return cut_lineage(nodes.select("group", "index", "n", "node").groupBy("group", _block(height)).applyInPandas(reduce, _NODE))


def _tree(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes and those of each further exchange; the last have one node per group."""
    tables = [nodes]
    while (tables[-1].agg(F.max("n").alias("n")).first().n or 1) > 1:
        tables.append(_up(tables[-1], height))
    return tables


def _down(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """group, index, node, subroot and whole path of every node."""
    def extend(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        levels = reduced(rows["node"].tolist(), int(rows["n"].iloc[0]), height)
        return rows[["group", "index", "node"]].assign(
            subroot=above["subroot"].iloc[0], path=[_text(siblings(levels, i)) + above["path"].iloc[0] for i in range(len(rows))])

    return cut_lineage(nodes.select("group", "index", "n", "node", _block(height)).groupBy("group", "block").cogroup(
        outer.groupBy("group", "block")).applyInPandas(
        extend, "group long, index long, node string, subroot string, path string"))


def _outer(above: DataFrame) -> DataFrame:
    """Outer nodes of the superblocks below, whose tops are the nodes of ``above``."""
    return above.select("group", F.col("index").alias("block"), "subroot", "path")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    hashed = docs.select(
        F.col("doc_id").cast("long"), "source", leaf_of().alias("node"), without_newlines().alias("changed"),
        F.monotonically_increasing_id().alias("_row"))
    leaves = cut_lineage(_numbered(hashed, ["source"], ["source", "doc_id", "node", "_row"]).drop("source", "_row"))
    tables = _tree(leaves, height)
    subroots = cut_lineage(_numbered(tables[-1].select(F.col("group").alias("of"), "node"), [], ["of"]))
    tops = _tree(subroots.select("group", "index", "n", "node"), height)
    top = tops[-1].first()
    root = top.node if top else ""

    outer = tops[-1].select("group", F.col("index").alias("block"), F.lit(None).cast("string").alias("subroot"), F.lit("").alias("path"))
    for nodes in tops[-2::-1]:
        paths = _down(nodes, outer, height)
        outer = _outer(paths)
    if len(tops) > 1:
        at_subroots = paths.select("index", "path")
    else:
        at_subroots = subroots.select("index", F.lit("").alias("path"))
    outer = subroots.join(at_subroots, "index").select(
        F.col("of").alias("group"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "path")
    for nodes in tables[-2:0:-1]:
        outer = _outer(_down(nodes, outer, height))

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Local reduction, proof joining and folding of a superblock of leaves."""
        rows = rows.sort_values("index")
        leaf, changed = rows["node"].tolist(), rows["changed"].tolist()
        levels = reduced(leaf, int(rows["n"].iloc[0]), height)
        beyond = _path(above["path"].iloc[0])
        outside = "".join(before + after for before, after in beyond)
        proofs, folded, tops = [], [], {}
        for i, node in enumerate(changed):
            inside = siblings(levels, i)
            proofs.append(digest("".join(before + after for before, after in inside), outside))
            local = fold(node, inside)
            if local not in tops:  # all untampered leaves of a superblock come to its top
                tops[local] = fold(local, beyond)
            folded.append(tops[local])
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "leaf": leaf, "subroot": above["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": folded})

    done = leaves.select(F.col("doc_id").cast("string"), "node", "changed", "group", "index", "n", _block(height)).groupBy(
        "group", "block").cogroup(outer.groupBy("group", "block")).applyInPandas(
        finish, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return done.select(
        F.col("doc_id").cast("long"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))
