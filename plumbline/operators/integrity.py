"""Completeness, membership, diff and reference checks between record sets.

Two-sided comparisons tag both sides, union them and aggregate by key.  That is one
shuffle with map-side combining, so repeated or very frequent keys never meet in a
join, and neither side has to fit anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the components of a frame and the variant each belongs to
RAW_COMPONENTS = ("rgb", "raw_camera", "raw_depth", "raw_confidence")
CLEAN_COMPONENTS = ("clean_depth", "clean_confidence")
CORRECTED_COMPONENTS = ("corrected_camera",)
COMPONENTS = RAW_COMPONENTS + CLEAN_COMPONENTS + CORRECTED_COMPONENTS
# fixed values: what each depth and pose variant needs besides the photo
VARIANT_NEEDS = {
    ("raw", "raw"): ("rgb", "raw_camera", "raw_depth", "raw_confidence"),
    ("raw", "corrected"): ("rgb", "corrected_camera", "raw_depth", "raw_confidence"),
    ("clean", "raw"): ("rgb", "raw_camera", "clean_depth", "clean_confidence"),
    ("clean", "corrected"): ("rgb", "corrected_camera", "clean_depth", "clean_confidence"),
}


def both_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """``keys`` + ``in_left, in_right, repeated`` + ``left_*, right_*`` payloads, one row per key.

    ``repeated`` tells that a side holds the key more than once; its payload is then only one of several.
    """

    def tagged(df: DataFrame, side: str) -> DataFrame:
        flags = [F.lit(s == side).alias(f"in_{s}") for s in ("left", "right")]
        if not payload:
            return df.select(*keys, *flags)
        mine = F.struct(*[F.col(c) for c in payload])
        return df.select(*keys, *flags, *[(mine if s == side else F.lit(None)).alias(f"__{s}") for s in ("left", "right")])

    # plain flags aggregate by hash; payload structs need a sort, so they are only carried when asked for
    kept = [F.max(f"__{s}").alias(f"__{s}") for s in ("left", "right")] if payload else []
    merged = tagged(left, "left").unionByName(tagged(right, "right")).groupBy(*keys).agg(
        F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"),
        F.greatest(F.count_if("in_left"), F.count_if("in_right")).alias("__most"), *kept)
    return merged.select(
        *keys, "in_left", "in_right", (F.col("__most") > 1).alias("repeated"), *[F.col(f"__{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in payload])


def missing_orphan(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``missing`` (expected, not found) and ``orphan`` (found, not expected) keys."""
    sides = both_sides(expected, found, keys).where(F.col("in_left") != F.col("in_right"))
    return sides.select(*keys, F.when(F.col("in_left"), "missing").otherwise("orphan").alias("kind"))


def exact_membership(declared: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared and actual sets must be equal: rows ``missing`` or ``undeclared``."""
    sides = both_sides(declared, actual, keys).where(F.col("in_left") != F.col("in_right"))
    return sides.select(*keys, F.when(F.col("in_left"), "missing").otherwise("undeclared").alias("kind"))


def required_subset(required: DataFrame, supplied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys no supplied row covers."""
    return both_sides(required, supplied, keys).where("in_left AND NOT in_right").select(*keys)


def component_flags(components: DataFrame, frame: Sequence[str], names: Sequence[str] = COMPONENTS) -> DataFrame:
    """One row per frame with a boolean per component (the set of components is fixed)."""
    return components.groupBy(*frame).agg(
        *[F.coalesce(F.bool_or(F.col("component") == n), F.lit(False)).alias(n) for n in names])


def _with_capture_options(flags: DataFrame, capture: str) -> DataFrame:
    options = flags.groupBy(capture).agg(
        F.bool_or("rgb").alias("has_rgb"),
        F.bool_or(F.col("clean_depth") | F.col("clean_confidence")).alias("has_clean"),
        F.bool_or("corrected_camera").alias("has_corrected"),
    )
    return flags.join(options, capture)


def component_completeness(components: DataFrame, capture: str = "capture_id", frame: str = "frame_id") -> DataFrame:
    """Findings ``(capture, frame, component, kind)`` against the photo ids.

    Raw components are always required; the clean pair and the corrected cameras
    become required for every frame once any frame of the capture has them.  A
    capture without photos gets one ``no_rgb`` finding.
    """
    flags = _with_capture_options(component_flags(components, [capture, frame]), capture)
    required = {n: F.lit(True) for n in RAW_COMPONENTS[1:]}
    required |= {n: F.col("has_clean") for n in CLEAN_COMPONENTS}
    required |= {n: F.col("has_corrected") for n in CORRECTED_COMPONENTS}
    verdicts = [
        F.when(need & (F.col(n) != F.col("rgb")),
               F.struct(F.lit(n).alias("component"), F.when(F.col("rgb"), "missing").otherwise("orphan").alias("kind")))
        for n, need in required.items()
    ]
    differing = flags.where("has_rgb").select(
        capture, frame, F.explode(F.array_compact(F.array(*verdicts))).alias("f")
    ).select(capture, frame, "f.component", "f.kind")
    empty = flags.where("NOT has_rgb").select(capture).distinct().select(
        capture, F.lit(None).cast(flags.schema[frame].dataType).alias(frame), F.lit("rgb").alias("component"), F.lit("no_rgb").alias("kind"))
    return differing.unionByName(empty)


def component_counts(components: DataFrame, capture: str = "capture_id", frame: str = "frame_id") -> DataFrame:
    """Frames per component and the variants present, one row per capture."""
    flags = component_flags(components, [capture, frame])
    counted = flags.groupBy(capture).agg(*[F.count_if(F.col(n)).alias(n) for n in COMPONENTS])
    return counted.withColumns({
        "depth_variants": F.when(F.col("clean_depth") + F.col("clean_confidence") > 0, "raw,clean").otherwise("raw"),
        "pose_variants": F.when(F.col("corrected_camera") > 0, "raw,corrected").otherwise("raw"),
    })


def variant_matrix_audit(components: DataFrame, capture: str = "capture_id", frame: str = "frame_id") -> DataFrame:
    """Every photo frame × every variant combination its capture has: usable or not."""
    flags = _with_capture_options(component_flags(components, [capture, frame]), capture).where("rgb")
    combos = []
    for (depth, pose), needs in VARIANT_NEEDS.items():
        present = (F.lit(True) if depth == "raw" else F.col("has_clean")) & (F.lit(True) if pose == "raw" else F.col("has_corrected"))
        usable = F.lit(True)
        for n in needs:
            usable = usable & F.col(n)
        combos.append(F.when(present, F.struct(
            F.lit(depth).alias("depth_variant"), F.lit(pose).alias("pose_variant"), usable.alias("usable"))))
    return flags.select(capture, frame, F.explode(F.array_compact(F.array(*combos))).alias("c")).select(capture, frame, "c.*")


def assemble_frames(components: DataFrame, depth_variant: str = "raw", pose_variant: str = "raw",
                    capture: str = "capture_id", frame: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """Complete frames of one variant, and findings for frames that miss a component."""
    needs = VARIANT_NEEDS[(depth_variant, pose_variant)]
    flags = component_flags(components.where(F.col("component").isin(*needs)), [capture, frame], needs)
    absent = F.array_compact(F.array(*[F.when(~F.col(n), n) for n in needs]))
    checked = flags.select(capture, frame, absent.alias("absent"))
    complete = checked.where(F.size("absent") == 0).select(capture, frame)
    broken = checked.where(F.size("absent") > 0).select(
        F.lit("missing_component").alias("rule"),
        F.concat_ws("/", F.col(capture).cast("string"), F.col(frame).cast("string")).alias("entity_id"),
        F.array_join("absent", ",").alias("detail"))
    return complete, broken


def content_hash(df: DataFrame, content: str, name: str = "sha256") -> DataFrame:
    """SHA-256 of bytes or UTF-8 text."""
    return df.withColumn(name, F.sha2(F.col(content), 256))


def buffer_hash(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], kind: str = "f4") -> DataFrame:
    """SHA-256 per key of its numbers as one little-endian buffer (``f4``, ``i4``, ``i1``, ``u1``), rows in ``order``.

    ``buffer_sha256`` is NULL where a number is NULL or not finite in that kind. Rows are dealt by key, sorted and hashed as
    they stream by, so the buffer of one object is never held.
    """
    keys, order, values = list(keys), list(order), list(values)
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        held, digest, ok = None, None, True
        for batch in batches:
            out = []
            if len(batch):
                numbers = batch[values].to_numpy(dtype=np.float64, na_value=np.nan)
                fits = np.isfinite(numbers).all(axis=1)
                with np.errstate(all="ignore"):
                    coded = np.where(fits[:, None], numbers, 0).astype(f"<{kind}")
                fits &= np.isfinite(coded.astype(np.float64)).all(axis=1)
                names = list(batch[keys].itertuples(index=False, name=None))
                starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for a, b in zip(starts, starts[1:]):
                    if names[a] != held or digest is None:
                        if digest is not None:
                            out.append((*held, digest.hexdigest() if ok else None))
                        held, digest, ok = names[a], hashlib.sha256(), True
                    digest.update(coded[a:b].tobytes())
                    ok = ok and bool(fits[a:b].all())
            yield pd.DataFrame(out, columns=[*keys, "buffer_sha256"])
        if digest is not None:
            yield pd.DataFrame([(*held, digest.hexdigest() if ok else None)], columns=[*keys, "buffer_sha256"])

    dealt = rows.select(*dict.fromkeys([*keys, *order, *values])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, f"{fields}, buffer_sha256 string")


def set_identity_hash(df: DataFrame, keys: Sequence[str], name: str, sha256: str) -> DataFrame:
    """Order-independent identity of a ``name -> sha256`` set per key.

    Leaves ``sha256:name`` are hashed, gathered by leading hex digits and hashed
    again, three levels deep.  No list ever holds a whole set: a set of a billion
    members gathers about a thousand leaves at a time.
    """
    leaves = df.select(*keys, F.sha2(F.concat_ws(":", F.col(sha256), F.col(name).cast("string")), 256).alias("__h")).distinct()
    out = leaves
    for digits in (5, 2, 0):
        prefix = F.substring("__h", 1, digits) if digits == 5 else F.substring("__p", 1, digits)
        out = out.groupBy(*keys, prefix.alias("__p")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(
                F.struct(F.col("__h" if digits == 5 else "__p").alias("o"), F.col("__h").alias("h")))), lambda e: e["h"]), ""), 256).alias("__h"))
    return out.select(*keys, F.col("__h").alias("identity"))


def inventory_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("group", "name"), sha256: str = "record_sha256") -> DataFrame:
    """``added``, ``removed`` and ``changed`` names per group of two snapshots; a name that one snapshot repeats is ``duplicate``."""
    sides = both_sides(old, new, keys, [sha256])
    kind = (
        F.when(F.col("repeated"), "duplicate").when(~F.col("in_left"), "added").when(~F.col("in_right"), "removed")
        .when(~F.col(f"left_{sha256}").eqNullSafe(F.col(f"right_{sha256}")), "changed")
    )
    return sides.select(*keys, kind.alias("change")).where(F.col("change").isNotNull())


def name_order(inventory: DataFrame, keys: Sequence[str] = ("group", "name")) -> DataFrame:
    """An inventory sorted by group and name (a range-partitioned sort)."""
    return inventory.orderBy(*keys)


def snapshots_comparable(old: DataFrame, new: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Header versions that differ between two snapshots; compare only when empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).cast("string").alias("value")) for v in versions])).alias("p")
    return missing_orphan(old.select(pairs).select("p.*"), new.select(pairs).select("p.*"), ["version", "value"])


def preservation_check(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Every baseline property must still be there, once, and equal; additions are allowed."""
    sides = both_sides(before, after, keys, [value]).where("in_left")
    broken = F.when(F.col("repeated"), "duplicate").when(~F.col("in_right"), "lost").when(~F.col(f"left_{value}").eqNullSafe(F.col(f"right_{value}")), "changed")
    return sides.select(*keys, broken.alias("kind")).where(F.col("kind").isNotNull())


def artifact_verify(recorded: DataFrame, present: DataFrame, keys: Sequence[str] = ("path",), sha256: str = "sha256",
                    allow_extra: bool = False) -> DataFrame:
    """Recorded hash against present hash: ``missing``, ``changed``, ``undeclared`` and repeated (``duplicate``) files."""
    sides = both_sides(recorded, present, keys, [sha256])
    kind = F.when(F.col("repeated"), "duplicate").when(~F.col("in_right"), "missing").when(
        F.col("in_left") & ~F.col(f"left_{sha256}").eqNullSafe(F.col(f"right_{sha256}")), "changed")
    if not allow_extra:
        kind = kind.when(~F.col("in_left"), "undeclared")
    return sides.select(*keys, kind.alias("kind")).where(F.col("kind").isNotNull())


def join_component_manifest(components: DataFrame, manifest: DataFrame, keys: Sequence[str], sha256: str = "sha256") -> DataFrame:
    """Frame components whose hash differs from, or is absent in, the preserved archive."""
    wanted = manifest.select(*keys, F.col(sha256).alias("archive_sha256"))
    joined = components.join(wanted, list(keys), "left")
    return joined.where(~F.col(sha256).eqNullSafe(F.col("archive_sha256")))


def tree_equal(manifest: DataFrame, extracted: DataFrame, keys: Sequence[str] = ("path", "is_dir")) -> DataFrame:
    """Extracted tree against manifest: ``missing`` and ``stale`` entries."""
    sides = both_sides(manifest, extracted, keys).where(F.col("in_left") != F.col("in_right"))
    return sides.select(*keys, F.when(F.col("in_left"), "missing").otherwise("stale").alias("kind"))


def duplicate_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key(child: DataFrame, fk: str, parent: DataFrame, pk: str, rule: str, entity: str) -> DataFrame:
    """Findings for non-NULL references that resolve to nothing."""
    known = parent.select(F.col(pk).alias(fk)).distinct()
    orphans = child.where(F.col(fk).isNotNull()).join(known, fk, "left_anti")
    return orphans.select(F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity_id"), F.col(fk).cast("string").alias("detail"))


def observation_fk(observations: DataFrame, sources: DataFrame, features: DataFrame) -> DataFrame:
    """Observation→source and feature→observation references plus unique ids.

    ``features`` is the bridge ``(feature_id, observation_id)``.
    """
    unknown_source = foreign_key(observations, "source_id", sources, "id", "unknown_source", "id")
    unknown_observation = foreign_key(features, "observation_id", observations, "id", "unknown_observation", "feature_id")
    out = unknown_source.unionByName(unknown_observation)
    for label, df, key in (("observation", observations, ["id"]), ("source", sources, ["id"]),
                           ("feature_observation", features, ["feature_id", "observation_id"])):
        repeated = duplicate_ids(df, key).select(
            F.lit(f"duplicate_{label}").alias("rule"), F.col(key[0]).cast("string").alias("entity_id"), F.col("n").cast("string").alias("detail"))
        out = out.unionByName(repeated)
    return out


def contract_fk(objects: DataFrame, materials: DataFrame, sources: DataFrame, views: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """References of a delivery job.

    ``objects(id, material, sources[])``, ``materials(id, sources[])``,
    ``views(id, required_objects[])``, ``lights(id, ceiling_objects[])``.
    """
    def flat(df: DataFrame, column: str) -> DataFrame:
        return df.select("id", F.explode(column).alias("ref"))

    out = foreign_key(objects, "material", materials, "id", "unknown_object_material", "id")
    edges = [("unknown_object_source", flat(objects, "sources"), sources),
             ("unknown_material_source", flat(materials, "sources"), sources),
             ("unknown_view_object", flat(views, "required_objects"), objects)]
    if lights is not None:
        edges.append(("unknown_light_ceiling", flat(lights, "ceiling_objects"), objects))
    for rule, child, parent in edges:
        out = out.unionByName(foreign_key(child, "ref", parent, "id", rule, "id"))
    return out


def used_source_closure(sources: DataFrame, objects: DataFrame, materials: DataFrame) -> DataFrame:
    """Sources some object or material refers to."""
    used = objects.select(F.explode("sources").alias("id")).unionByName(materials.select(F.explode("sources").alias("id"))).distinct()
    return sources.join(used, "id", "left_semi")


def membership_receipt(membership: DataFrame, receipt: DataFrame, keys: Sequence[str] = ("room_id", "group", "ordinal"),
                       name: str = "target_name") -> DataFrame:
    """Targets must be the same names in the same order: ``missing``, ``extra``, ``renamed``; repeated places are ``duplicate``."""
    sides = both_sides(membership, receipt, keys, [name])
    kind = (F.when(F.col("repeated"), "duplicate").when(~F.col("in_right"), "missing").when(~F.col("in_left"), "extra")
            .when(~F.col(f"left_{name}").eqNullSafe(F.col(f"right_{name}")), "renamed"))
    return sides.select(*keys, F.col(f"left_{name}").alias("declared"), F.col(f"right_{name}").alias("received"), kind.alias("kind")).where(
        F.col("kind").isNotNull())


def group_target_counts(membership: DataFrame, totals: DataFrame, room: str = "room_id") -> DataFrame:
    """Targets per group and whether the room's declared total equals their sum.

    ``totals`` is ``(room_id, total_native_targets)``.  Unique names are counted
    from names already reduced per room, and a name in two groups is a duplicate.
    """
    names = membership.groupBy(room, "group", "target_name").agg(F.count("*").alias("n"))
    groups = names.groupBy(room, "group").agg(F.sum("n").alias("target_count"))
    rooms = names.groupBy(room, "target_name").agg(F.sum("n").alias("uses")).groupBy(room).agg(
        F.count("*").alias("unique_targets"), F.count_if(F.col("uses") > 1).alias("duplicate_names"))
    checked = rooms.join(totals, room, "left").withColumn(
        "total_matches", F.coalesce((F.col("total_native_targets") == F.col("unique_targets")) & (F.col("duplicate_names") == 0), F.lit(False)))
    return groups.join(checked, room)


def material_override_match(declared: DataFrame, received: DataFrame, keys: Sequence[str] = ("ordinal",),
                            columns: Sequence[str] = ("object_id", "original_material_id", "render_material_id", "intent")) -> DataFrame:
    """Override rows must agree position by position; a position used twice is ``duplicate``."""
    sides = both_sides(declared, received, keys, columns)
    same = F.col("in_left") & F.col("in_right")
    for c in columns:
        same = same & F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    kind = F.when(F.col("repeated"), "duplicate").when(~F.col("in_right"), "missing").when(~F.col("in_left"), "extra").when(~same, "different")
    return sides.select(*keys, kind.alias("kind")).where(F.col("kind").isNotNull())


def scan_manifest(captures: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifest whose normalised ``capture_root`` is the capture's ``source`` path."""
    roots = manifests.withColumn("source", normal_path(F.col("capture_root"))).drop("capture_root")
    return captures.withColumn("source", normal_path(F.col("source"))).join(roots, "source", "left")


def normal_path(path: Column) -> Column:
    """Collapse ``//``, ``/./`` and trailing slashes; resolve ``name/..`` pairs."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(resolved, "/"))


def scan_job_inputs(declared: DataFrame, files: DataFrame, folder: str = "job_dir") -> DataFrame:
    """Resolve declared relative paths, then compare declared and actual SHA-256.

    ``declared(label, job_dir, path, sha256)``, ``files(path, sha256)``.
    """
    absolute = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", F.col(folder), F.col("path")))
    resolved = declared.withColumn("resolved_path", normal_path(absolute))
    actual = files.select(F.col("path").alias("resolved_path"), F.col("sha256").alias("actual_sha256"))
    status = (F.when(F.col("actual_sha256").isNull(), "missing")
              .when(~F.col("sha256").eqNullSafe(F.col("actual_sha256")), "hash_mismatch").otherwise("ok"))
    return resolved.join(actual, "resolved_path", "left").withColumn("status", status)


def evidence_closure(bindings: DataFrame, sources: DataFrame, images: DataFrame, fields: Sequence[str],
                     documentary_fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Check every source an object cites, and the original behind every derivative.

    ``bindings(object_id, source_id)``; ``sources(source_id, kind, identity map,
    uncertainty, image, original_source_id)``; ``images(image, sha256, metadata
    map)``.  Returns findings and the audited source ids.  A derivative points at
    an original and an original at nothing, so one extra join closes the chain.
    """
    cited = bindings.select("source_id").distinct()
    known = sources.join(cited, "source_id", "left_semi")
    derived = known.where("kind = 'qualified-upright' AND uncertainty IS NOT NULL AND uncertainty <> ''")
    originals = sources.where("kind = 'original'").select(F.col("source_id").alias("original_source_id"))
    reached = derived.select("original_source_id").distinct().join(originals, "original_source_id", "left_semi")
    audited = cited.unionByName(reached.withColumnRenamed("original_source_id", "source_id")).distinct()
    resolvable = sources.where("uncertainty IS NOT NULL AND uncertainty <> ''").select("source_id")

    def rows(df: DataFrame, rule: Column, entity: str, detail: Column) -> DataFrame:
        return df.select(rule.alias("rule"), F.col(entity).cast("string").alias("entity_id"), detail.cast("string").alias("detail"))

    unresolved = rows(bindings.join(resolvable, "source_id", "left_anti"), F.lit("unresolved_source"), "object_id", F.col("source_id"))
    chain = sources.join(audited, "source_id", "left_semi").where("uncertainty IS NOT NULL AND uncertainty <> ''")
    visual = chain.where(F.col("kind").isin("original", "qualified-upright"))
    pictured = visual.join(images.select("image", F.col("sha256").alias("__sha"), F.col("metadata").alias("__meta")), "image", "left")
    absent = F.col("__sha").isNull()
    identity = F.col("identity")
    checks = [
        *[F.when(F.coalesce(identity[f], F.lit("")) == "", F.struct(F.lit("identity_missing").alias("rule"), F.lit(f).alias("detail"))) for f in fields],
        F.when(~identity["source_id"].eqNullSafe(F.col("source_id").cast("string")), F.struct(F.lit("identity_source_id").alias("rule"), F.lit(None).cast("string").alias("detail"))),
        F.when(absent, F.struct(F.lit("image_absent").alias("rule"), F.col("image").alias("detail"))),
        F.when(~absent & ~identity["sha256"].eqNullSafe(F.col("__sha")), F.struct(F.lit("image_bytes_differ").alias("rule"), F.col("image").alias("detail"))),
        *[F.when(~absent & ~F.col("__meta")[f].eqNullSafe(identity[f]), F.struct(F.lit("image_metadata_differs").alias("rule"), F.lit(f).alias("detail"))) for f in fields],
    ]
    picture_findings = rows(pictured.select("source_id", F.explode(F.array_compact(F.array(*checks))).alias("c")), F.col("c.rule"), "source_id", F.col("c.detail"))
    lost = rows(derived.join(originals, "original_source_id", "left_anti"), F.lit("original_missing"), "source_id", F.col("original_source_id"))
    documentary = chain.where("kind = 'documentary-unlocated'")
    doc_checks = [
        *[F.when(F.coalesce(identity[f], F.lit("")) == "", F.struct(F.lit("identity_missing").alias("rule"), F.lit(f).alias("detail"))) for f in documentary_fields],
        F.when(~identity["source_id"].eqNullSafe(F.col("source_id").cast("string")), F.struct(F.lit("identity_source_id").alias("rule"), F.lit(None).cast("string").alias("detail"))),
        F.when(F.col("image").isNotNull() | ~identity["locator"].eqNullSafe(F.lit("unlocated")), F.struct(F.lit("invented_image").alias("rule"), F.col("image").alias("detail"))),
    ]
    doc_findings = rows(documentary.select("source_id", F.explode(F.array_compact(F.array(*doc_checks))).alias("c")), F.col("c.rule"), "source_id", F.col("c.detail"))
    other = rows(chain.where(~F.coalesce(F.col("kind"), F.lit("")).isin("original", "qualified-upright", "documentary-unlocated")),
                 F.lit("unsupported_kind"), "source_id", F.col("kind"))
    out = unresolved
    for more in (picture_findings, lost, doc_findings, other):
        out = out.unionByName(more)
    return out, audited
