"""Convex hulls of many points per key: thinned by extreme directions, merged as a tree, searched by angle.

The key's extreme points in a fixed set of directions span a polygon; points inside it cannot be
corners and never leave the JVM. The others are reduced inside each task and merged a few
partial hulls at a time, so no task gathers a key. A point is tested against one edge, found by
binary search over the angles of the ring's corners around its centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.joins import measured
from plumbline.functions.linalg import hull_ring
from plumbline.session import cut_lineage

DIRECTIONS = 16
HELD_CORNERS = 50_000  # corners kept by one task before they are handed on
MERGED = 8  # partial hulls that meet in one step


def possible_corners(points: DataFrame) -> DataFrame:
    """The rows ``(key, px, py)`` that are not strictly inside the polygon of their key's extreme points."""
    turns = [2 * math.pi * k / DIRECTIONS for k in range(DIRECTIONS)]
    at = F.struct("px", "py")
    extremes = cut_lineage(points.groupBy("key").agg(*[
        F.max_by(at, F.col("px") * math.cos(t) + F.col("py") * math.sin(t)).alias(f"__e{k}") for k, t in enumerate(turns)]))
    inside = F.lit(True)
    for k in range(DIRECTIONS):
        a, b = F.col(f"__e{k}"), F.col(f"__e{(k + 1) % DIRECTIONS}")
        turn = (b["px"] - a["px"]) * (F.col("py") - a["py"]) - (b["py"] - a["py"]) * (F.col("px") - a["px"])
        inside = inside & ((a == b) | (turn > 0))
    named = measured(extremes.withColumnRenamed("key", "__key"))
    return points.join(named, F.col("key").eqNullSafe(F.col("__key"))).where(~inside).select("key", "px", "py")


def _partial(batches: Iterator[pd.DataFrame], held_corners: int) -> Iterator[pd.DataFrame]:
    """Per task, the rows as partial hulls ``(key, part, ring)`` of each key."""
    held: dict = {}
    task, handed = TaskContext.get().partitionId(), 0

    def hand_on() -> pd.DataFrame:
        out = pd.DataFrame({"key": list(held), "part": [handed * 1_000_003 + task] * len(held), "ring": [r.reshape(-1).tolist() for r in held.values()]})
        held.clear()
        return out

    for batch in batches:
        for key, part in batch.groupby("key", sort=False, dropna=False):
            points = part[["px", "py"]].to_numpy(float)
            held[key] = hull_ring(np.concatenate([held[key], points]) if key in held else points)
        if sum(map(len, held.values())) > held_corners:
            yield hand_on()
            handed += 1
    if held:
        yield hand_on()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    ring = hull_ring(np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rows["ring"]]))
    return pd.DataFrame({"key": [rows["key"].iloc[0]], "slot": [rows["slot"].iloc[0]], "ring": [ring.reshape(-1).tolist()]})


def hulls(points: DataFrame, held_corners: int = HELD_CORNERS) -> DataFrame:
    """``key, ring``: the counterclockwise hull of each key's ``(px, py)`` as flat coordinates.

    Parts are dealt to slots by a hash, and slots meet ``MERGED`` at a time until one is left.
    """
    kind = points.schema["key"].dataType.simpleString()
    parts = cut_lineage(possible_corners(points).mapInPandas(lambda batches: _partial(batches, held_corners), f"key {kind}, part long, ring array<double>"))
    # as many slots as a key has parts, so that each holds one or a few
    most = parts.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    slots = max(1, MERGED ** math.ceil(math.log(most, MERGED))) if most > 1 else 1
    merged = parts.select("key", F.pmod(F.xxhash64("part"), F.lit(slots)).alias("slot"), "ring")
    while True:
        merged = merged.groupBy("key", "slot").applyInPandas(_merge, f"key {kind}, slot long, ring array<double>")
        if slots == 1:
            return merged.select("key", "ring")
        slots //= MERGED
        merged = merged.withColumn("slot", F.floor(F.col("slot") / MERGED))


def _sectors(batches: Iterator[pd.DataFrame], tolerance: float) -> Iterator[pd.DataFrame]:
    """Rings with an area as ``key, cx, cy, starts, edges``: edge i faces the angles from ``starts[i]`` on."""
    for batch in batches:
        rows = []
        for key, flat in zip(batch["key"], batch["ring"]):
            ring = np.asarray(flat, float).reshape(-1, 2)
            if len(ring) < 3:
                continue
            along = np.roll(ring, -1, axis=0) - ring
            along /= np.hypot(along[:, 0], along[:, 1])[:, None]
            outward = np.stack([along[:, 1], -along[:, 0]], axis=1)
            before = np.roll(outward, 1, axis=0)
            # the ring moved outward by the tolerance: where its corners are seen, the binding edge changes
            corner = ring + tolerance * (before + outward) / np.maximum(1 + (before * outward).sum(axis=1), 1e-9)[:, None]
            centre = ring.mean(axis=0)
            angle = np.arctan2(corner[:, 1] - centre[1], corner[:, 0] - centre[0])
            first = int(np.argmin(angle))
            order = np.r_[first:len(ring), 0:first]
            edges = np.concatenate([ring[order], along[order]], axis=1)
            rows.append((key, centre[0], centre[1], np.maximum.accumulate(angle[order]).tolist(), edges.reshape(-1).tolist()))
        yield pd.DataFrame(rows, columns=["__key", "cx", "cy", "starts", "edges"])


def inside_hull(points: DataFrame, rings: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Rows of ``points`` on or inside the ring of their key: no further than ``tolerance`` outside any edge. Rings without area hold nothing."""
    kind = points.schema[key].dataType.simpleString()
    sectors = rings.mapInPandas(lambda batches: _sectors(batches, tolerance), f"__key {kind}, cx double, cy double, starts array<double>, edges array<double>")
    met = points.join(measured(cut_lineage(sectors)), points[key].eqNullSafe(F.col("__key")))
    met = met.withColumn("__angle", F.atan2(F.col("py") - F.col("cy"), F.col("px") - F.col("cx")))
    count = F.size("starts")

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        go_up = (s["hi"] - s["lo"] > 1) & (F.get("starts", middle) <= F.col("__angle"))
        return F.struct(F.when(go_up, middle).otherwise(s["lo"]).alias("lo"), F.when(go_up | (s["hi"] - s["lo"] <= 1), s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(count + 2)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(-1).alias("lo"), count.alias("hi")), halve, lambda s: F.when(s["lo"] < 0, count - 1).otherwise(s["lo"]))
    met = met.withColumn("__edge", found * 4)
    ax, ay, ux, uy = (F.get("edges", F.col("__edge") + k) for k in range(4))
    return met.where(ux * (F.col("py") - ay) - uy * (F.col("px") - ax) >= -tolerance).drop("__key", "cx", "cy", "starts", "edges", "__angle", "__edge")
