"""Trees of objects, collections and nodes: closure, reachability, transforms.

Each round is one join whose result is checkpointed in the shared folder, so plans
stay short and a lost executor costs one round.  The driver only learns whether a
round produced rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import vectors as V
from plumbline.functions.joins import by_shuffle
from plumbline.session import cut_lineage


def ancestors(edges: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """All ``(id, ancestor, depth)`` pairs of single-parent edges, by pointer doubling.

    A tree of depth ``d`` takes ``log2(d)`` rounds.  Self-loops mark roots and are
    dropped; a longer cycle ends in an error as soon as an id meets itself.
    """
    jump = cut_lineage(
        edges.where(F.col(parent).isNotNull() & (F.col(child) != F.col(parent)))
        .select(F.col(child).alias("id"), F.col(parent).alias("ancestor")))
    closure = [jump.withColumn("depth", F.lit(1).cast("long"))]
    reach = 1
    while not jump.isEmpty():
        known = reduce(DataFrame.unionByName, closure)
        further = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("__up"), "depth")
        closure.append(cut_lineage(
            jump.join(further, "ancestor").select("id", F.col("__up").alias("ancestor"), (F.col("depth") + reach).alias("depth"))))
        if not closure[-1].where("id = ancestor").isEmpty():
            raise ValueError("parent edges contain a cycle")
        hop = jump.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("__up"))
        jump = cut_lineage(jump.join(hop, "ancestor").select("id", F.col("__up").alias("ancestor")))
        reach *= 2
    return reduce(DataFrame.unionByName, closure)


def parent_chain(edges: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """Ordered ancestor ids per object, nearest first (as long as the tree is deep)."""
    pairs = ancestors(edges, child, parent)
    return pairs.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda e: e["ancestor"]).alias("chain"))


def collection_closure(collections: DataFrame, links: DataFrame, root) -> DataFrame:
    """Collections reachable from ``root`` without passing a hidden one.

    ``collections(id, hide_render)``, ``links(parent_id, child_id)``; a collection
    may be linked from several parents and is reported once.
    """
    shown = collections.where(~F.col("hide_render")).select("id")
    steps = cut_lineage(links.where(F.col("parent_id") != F.col("child_id")).join(
        by_shuffle(shown.withColumnRenamed("id", "child_id")), "child_id", "left_semi"))
    seen = [cut_lineage(shown.where(F.col("id") == root))]
    frontier = seen[0]
    while not frontier.isEmpty():
        known = reduce(DataFrame.unionByName, seen)
        frontier = cut_lineage(
            frontier.withColumnRenamed("id", "parent_id").join(by_shuffle(steps), "parent_id")
            .select(F.col("child_id").alias("id")).distinct().join(by_shuffle(known), "id", "left_anti"))
        seen.append(frontier)
    return reduce(DataFrame.unionByName, seen)


def renderable_objects(closure: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects linked to a reachable collection and not hidden themselves.

    ``objects(object_id, collection_id, hide_render)``.
    """
    return objects.where(~F.col("hide_render")).join(
        by_shuffle(closure.withColumnRenamed("id", "collection_id")), "collection_id", "left_semi").select("object_id").distinct()


def _followed(nodes: DataFrame, matrices: bool) -> tuple[DataFrame, DataFrame]:
    """Every node after its chain was followed to the end, with the way it ended, and the ids that come several times.

    Pointers double: a node holds an ancestor ``up``, the least id ``low`` of the ancestors up to there and, with ``matrices``, the
    product from just below ``up`` down to itself. A node that is its own ``low`` is on a cycle, and so hangs every node that has it as
    ``low`` or points to one that hangs. Depth and cycle length ``d`` take ``log2(d)`` rounds.
    """
    carried = ["matrix"] if matrices else []
    single = nodes.groupBy("id").agg(F.count("*").alias("__n"), F.min(F.struct("parent_id", *carried)).alias("__row"))
    row = {"up": F.col("__row.parent_id"), "low": F.col("__row.parent_id"), "matrix": F.col("__row.matrix")}
    ended = F.when(row["up"].isNull(), "root").when(row["up"] == F.col("id"), "cycle")
    state = cut_lineage(single.select("id", *[row[c].alias(c) for c in ("up", "low", *carried)], ended.alias("ended"), "__n"))
    repeated = state.where("__n > 1").select(F.lit("duplicate").alias("rule"), F.col("id").cast("string").alias("entity_id"), F.col("__n").cast("string").alias("detail"))
    state = state.drop("__n")
    while not state.where("ended IS NULL").isEmpty():
        target = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("low").alias("__low"), F.col("ended").alias("__ended"),
                              *[F.col(c).alias("__m") for c in carried], F.lit(True).alias("__there"))
        met = state.where("ended IS NULL").join(by_shuffle(target), "up", "left")
        there, end = F.coalesce("__there", F.lit(False)), F.col("__ended")
        onwards = there & (end.isNull() | (end != "cycle"))
        moved = met.select(
            "id", F.when(onwards, F.col("__up")).otherwise(F.col("up")).alias("up"), F.least("low", "__low").alias("low"),
            *[F.when(onwards, V.multiply4(F.col("__m"), F.col("matrix"))).otherwise(F.col("matrix")).alias("matrix") for _ in carried],
            F.when(~there, "unknown_parent").otherwise(end).alias("ended"))
        moved = cut_lineage(moved)
        rings = moved.where("ended IS NULL AND low = id").select(F.col("id").alias("low"), F.lit(True).alias("__ring"))
        hung = moved.join(by_shuffle(rings), "low", "left").select(
            "id", "up", "low", *carried, F.coalesce("ended", F.when(F.col("__ring"), "cycle")).alias("ended"))
        state = cut_lineage(state.where("ended IS NOT NULL").unionByName(hung))
    return state, repeated


def _tree_findings(state: DataFrame, repeated: DataFrame) -> DataFrame:
    lost = F.col("ended") == "unknown_parent"
    return state.where("ended <> 'root'").select(
        F.col("ended").alias("rule"), F.col("id").cast("string").alias("entity_id"), F.when(lost, F.col("up").cast("string")).alias("detail")).unionByName(repeated)


def hierarchy_findings(nodes: DataFrame) -> DataFrame:
    """The findings of :func:`hierarchy_transforms`, from ids alone."""
    return _tree_findings(*_followed(nodes, matrices=False))


def hierarchy_transforms(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """World matrix of every node, and findings on the nodes that have none.

    ``nodes(id, parent_id, matrix)`` with row-major 16-element matrices; roots have
    a NULL parent.  A node whose chain ends at an absent id is ``unknown_parent``; one whose chain
    never ends is ``cycle``. An id that comes several times is one node, with the least
    ``(parent_id, matrix)`` of its rows, and a ``duplicate``.
    """
    state, repeated = _followed(nodes, matrices=True)
    return state.where("ended = 'root'").select("id", F.col("matrix").alias("world")), _tree_findings(state, repeated)
