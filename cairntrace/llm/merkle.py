"""A Merkle manifest of a dataset that stores every third level only.

Rows are leaves, ordered inside their source; every three consecutive nodes make one of the next
level, up to a root per source, and the same again over the sources.  Kept as tables are the leaves
and every third level above them.  A node of one stored level and the 27 nodes of the stored level
below it are an aligned subtree: a proof needs the two levels between, which are made again from
those 27, give their siblings, and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairntrace.functions.rows import once
from cairntrace.llm.common import held_out, parts_for, written

#: Children of a node.
FAN = 3
#: Levels from one stored level to the next, and the nodes of an aligned subtree's lowest level.
STEP = 3
BLOCK = FAN**STEP
#: Rows that a slice of the order holds.
SLICE_ROWS = 400_000

#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `pos`, the place inside the tree from 0 on, and `total`, the tree's rows; written.

    A tree may hold any share of the rows: the order over all trees is cut into slices, rows are
    numbered inside their slice, and a tree's earlier slices are added up.  Rows equal in all of
    `order` are dealt apart by a number of their own.
    """
    n = parts_for(rows, F.lit(1), SLICE_ROWS)
    told = rows.withColumn("__m", F.monotonically_increasing_id())
    sliced = written(
        told.repartitionByRange(n, tree, *order, "__m").withColumn("__slice", F.spark_partition_id()), f"{name}-slices"
    )
    counts = sliced.groupBy(tree, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    of_tree = Window.partitionBy(tree)
    before = of_tree.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(tree).alias("__t"),
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(of_tree).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy(tree, "__slice").orderBy(*order, "__m"))
    placed = sliced.withColumn("__i", inside).join(
        counts, (F.col(tree) == F.col("__t")) & (F.col("__slice") == F.col("__s"))
    )
    pos = (F.col("__before") + F.col("__i") - 1).alias("pos")
    return written(placed.select(*rows.columns, "total", pos), name)


def _above(nodes: Column) -> Column:
    """The next level over an array of digests."""
    firsts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FAN), ""), 256))


def _siblings(nodes: Column, j: Column) -> Column:
    """The other nodes of the run of node `j`, joined: those before it and those after it."""
    first = (j / FAN).cast("int") * FAN
    return F.struct(
        F.array_join(F.slice(nodes, first + 1, j - first), "").alias("before"),
        F.array_join(F.slice(nodes, j + 2, first + FAN - 1 - j), "").alias("after"),
    )


def _blocks(level: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Aligned subtrees of a stored level: (tree, total, block, l0..l2, up, and per carried column an array).

    `l0` are the stored digests, `l1` and `l2` the levels made again, `up` the digest that the block
    ends in: the node of the next stored level, or the root of a tree that is no larger."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    members = F.sort_array(F.collect_list(F.struct("pos", "h", *carried)))
    rows = level.groupBy("tree", "total", block.alias("block")).agg(members.alias("m"))
    names = ["tree", "total", "block"]
    rows = once(rows, {"l0": F.col("m")["h"], **{c: F.col("m")[c] for c in carried}}, names)
    names += list(carried)
    for k in range(STEP - 1):
        rows = once(rows, {**{f"l{i}": F.col(f"l{i}") for i in range(k + 1)}, f"l{k + 1}": _above(F.col(f"l{k}"))}, names)
    steps = F.lit(STEP)
    for k in reversed(range(STEP)):
        steps = F.when(F.col("total") <= FAN**k, F.lit(k)).otherwise(steps)
    levels = [F.col(f"l{k}") for k in range(STEP)]
    tops = F.array(*[F.get(x, F.lit(0)) for x in levels], F.get(_above(levels[-1]), F.lit(0)))
    return rows.select("*", steps.alias("steps"), F.get(tops, steps).alias("up"))


def _members(carried: tuple[str, ...]) -> Column:
    """The nodes of a block's stored level with the siblings on their way to the block's end."""

    def node(j: Column) -> Column:
        lists = [_siblings(F.col(f"l{k}"), (j / FAN**k).cast("int")) for k in range(STEP)]
        return F.struct(
            (F.col("block") * BLOCK + j).alias("pos"),
            F.get(F.col("l0"), j).alias("h"),
            F.slice(F.array(*lists), F.lit(1), F.col("steps")).alias("own"),
            *[F.get(F.col(c), j).alias(c) for c in carried],
        )

    return F.transform(F.sequence(F.lit(0), F.size("l0") - 1), node)


@dataclass(frozen=True)
class Forest:
    """The stored levels of some trees, lowest first: (tree, total, pos, h, ...); and their roots."""

    levels: list[DataFrame]
    roots: DataFrame


def _grown(leaves: DataFrame, name: str) -> Forest:
    """Stored levels over numbered leaves."""
    largest = leaves.agg(F.max("total")).first()[0] or 0
    levels, roots = [leaves], []
    while True:
        made = _blocks(levels[-1].select("tree", "total", "pos", "h"))
        roots.append(made.where(F.col("total") <= BLOCK).select("tree", F.col("up").alias("h")))
        if largest <= BLOCK:
            break
        largest = -(-largest // BLOCK)
        total = F.ceil(F.col("total") / BLOCK).cast("long").alias("total")
        above = made.where(F.col("total") > BLOCK).select("tree", total, F.col("block").alias("pos"), F.col("up").alias("h"))
        levels.append(written(above, f"{name}-level"))
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    return Forest(levels, written(all_roots, f"{name}-roots"))


def _proofs(forest: Forest, ends: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """A row per leaf: (tree, pos, h, carried..., path, and the further columns of `ends`).

    `ends` has per tree (tree, rest, ...) with the path from its root on.  From the highest stored level
    down, a block takes the path of its own node, which its members' paths go on with."""
    told = [c for c in ends.columns if c not in ("tree", "rest")]
    ends = ends.select(F.col("tree").alias("__t"), "rest", *told)
    known: DataFrame | None = None
    for k in reversed(range(len(forest.levels))):
        kept = carried if k == 0 else ()
        blocks = _blocks(forest.levels[k].select("tree", "total", "pos", "h", *kept), kept)
        whole = blocks.where(F.col("total") <= BLOCK).join(ends, F.col("tree") == F.col("__t"))
        if known is not None:
            above = known.select(F.col("tree").alias("__t"), F.col("pos").alias("__p"), F.col("path").alias("rest"), *told)
            part = blocks.where(F.col("total") > BLOCK).join(
                above, (F.col("tree") == F.col("__t")) & (F.col("block") == F.col("__p"))
            )
            whole = whole.unionByName(part.drop("__p"))

        known = whole.select("tree", "rest", *told, F.explode(_members(kept)).alias("x")).select(
            "tree", "x.pos", "x.h", *[f"x.{c}" for c in kept], F.concat("x.own", "rest").alias("path"), *told
        )
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the five fields; null fields count as `-`, so that null and empty differ.
    Null sources make a tree of their own, which comes first; in a tree null ids come first, and rows
    with one id are ordered by their leaf, so equal rows take neighbouring places.  Other columns of
    `docs`, whatever their names, are not read.  Without rows there is no row.

    `folded_root` goes up the untampered proof from the leaf of the tampered row: of a row with even
    crc32 of its id's text (null: empty text) the line feeds of the text are deleted.
    """
    fields = [F.col(f) for f in FIELDS]
    text = F.when(held_out(F.col("doc_id"), 2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    source = F.col("source").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("tree"),
        "doc_id",
        leaf_of(fields).alias("h"),
        leaf_of([*fields[:-1], text]).alias("seen"),
    )
    leaves = _numbered(written(rows, "leaves"), "tree", ["doc_id", "h"], "leaf-level")
    sources = _grown(leaves, "sources")
    subroots = sources.roots.select(F.lit("").alias("one"), F.col("tree").alias("source_key"), "h")
    top_leaves = _numbered(subroots, "one", ["source_key"], "subroot-level").withColumnRenamed("one", "tree")
    top = _grown(top_leaves, "root")
    no_more = F.array().cast("array<struct<before:string,after:string>>")
    ends = top.roots.select("tree", no_more.alias("rest"), F.col("h").alias("root"))
    above = _proofs(top, ends, ("source_key",)).select(
        F.col("source_key").alias("tree"), F.col("path").alias("rest"), F.col("h").alias("subroot"), "root"
    )
    proved = _proofs(sources, above, ("doc_id", "seen"))
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("path", F.col("seen"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    return proved.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.sha2(joined, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
