"""JSON documents: strict parsing and scene records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCENE_SCHEMA = (
    "name string, vertices_world_m array<array<double>>, polygons array<array<int>>, "
    "loop_triangles array<struct<vertex_indices:array<int>,polygon_index:int>>"
)


def scan_strict_json(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``doc`` (VARIANT) and ``valid``: an object without repeated keys, NaN or infinities."""
    v = F.try_parse_json(F.col(text))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return documents.withColumns({"doc": F.when(is_object, v), "valid": F.coalesce(is_object, F.lit(False))})


def read_json_texts(spark: SparkSession, root: str) -> DataFrame:
    """Whole JSON files as ``path, text``; a file that is not UTF-8 has a NULL text, which no scan takes for valid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def _scene_documents(documents: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``*keys, problem, objects``: what is wrong with a document as a whole, else its records."""
    rows = scan_strict_json(documents.select(*keys, F.col(text).alias("__t")), "__t")
    rows = rows.withColumn("__d", F.from_json("__t", f"struct<objects:array<struct<{_fields()}>>>"))
    problem = F.when(~F.col("valid"), "not_strict_json").when(F.col("__d.objects").isNull(), "no_objects")
    return rows.select(*keys, problem.alias("problem"), F.col("__d.objects").alias("objects"))


def _sound(o: Column) -> Column:
    """Whether a record fits: a vertex has three finite numbers, a face three vertices or more, a triangle three; indices stay inside their lists."""
    inside = lambda a, n: F.forall(a, lambda i: i.isNotNull() & (i >= 0) & (i < n))
    n = F.size(o["vertices_world_m"])
    vertex = F.forall(o["vertices_world_m"], lambda p: (F.size(p) == 3) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x)))
    face = F.forall(o["polygons"], lambda r: (F.size(r) >= 3) & inside(r, n))
    triangle = F.forall(o["loop_triangles"], lambda t: (F.size(t["vertex_indices"]) == 3) & inside(t["vertex_indices"], n)
                        & (t["polygon_index"] >= 0) & (t["polygon_index"] < F.size(o["polygons"])))
    return F.coalesce(o["name"].isNotNull() & vertex & face & triangle, F.lit(False))


def scan_scene_records(documents: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scene object records to vertex, face and triangle tables: the records that fit, of documents that are strict JSON.

    :func:`check_scene_documents` names all the others, by the same rules.
    """
    sound = _scene_documents(documents, keys, text).where("problem IS NULL").select(*keys, F.explode("objects").alias("o")).where(_sound(F.col("o")))
    objects = sound.select(*keys, "o")
    name = F.col("o.name").alias("object_id")
    vertices = objects.select(*keys, name, F.posexplode("o.vertices_world_m").alias("vertex", "p")).select(
        *keys, "object_id", "vertex", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])
    faces = objects.select(*keys, name, F.posexplode("o.polygons").alias("face", "vertices"))
    triangles = objects.select(*keys, name, F.posexplode("o.loop_triangles").alias("triangle", "t")).select(
        *keys, "object_id", F.col("t.polygon_index").alias("face"), "triangle", F.col("t.vertex_indices").alias("vertices"))
    return vertices, faces, triangles


def check_scene_documents(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Findings: scene documents that are no strict JSON object or hold no objects, and each record that does not fit, with its place.

    The scan has no rows of these, and rows of every other record.
    """
    entity = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("entity_id")
    rows = _scene_documents(documents, keys, text)
    whole = rows.where("problem IS NOT NULL").select(F.col("problem").alias("rule"), entity, F.lit(None).cast("string").alias("detail"))
    records = rows.where("problem IS NULL").select(entity, F.posexplode("objects").alias("place", "o")).where(~_sound(F.col("o")))
    return whole.unionByName(records.select(F.lit("record_does_not_fit").alias("rule"), "entity_id", F.col("place").cast("string").alias("detail")))


def _fields() -> str:
    return SCENE_SCHEMA.replace("name string", "name:string").replace("vertices_world_m array", "vertices_world_m:array").replace(
        "polygons array", "polygons:array").replace("loop_triangles array", "loop_triangles:array").replace(", ", ",")
