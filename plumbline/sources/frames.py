"""Capture files: frame index, cameras, depth, confidence and color images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import png

# fixed values: where each component lives below a capture, as regular expressions
COMPONENT_PATTERNS = {
    "rgb": r"keyframes/images/([^/]+)\.jpg\z",
    "clean_depth": r"keyframes/depth/([^/]+)\.Clean\.png\z",
    "raw_depth": r"keyframes/depth/([^/]+)\.png\z",
    "clean_confidence": r"keyframes/confidence/([^/]+)\.Clean\.png\z",
    "raw_confidence": r"keyframes/confidence/([^/]+)\.png\z",
    "raw_camera": r"keyframes/cameras/([^/]+)\.json\z",
    "corrected_camera": r"keyframes/corrected_cameras/([^/]+)\.json\z",
}
IMAGE_BYTES_PER_BATCH = 400_000  # unpacked bytes of images that are decoded and handed to Spark at a time, an image at least


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root`` as ``path, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "content")


def scan_frame_index(files: DataFrame) -> DataFrame:
    """File paths to ``capture_root, component, frame_id``; other files are dropped.

    Ids that are ``.`` or ``..`` are not frames.  Works on listings without content.
    """
    path = F.col("path")
    tests = F.coalesce(*[
        F.when(path.rlike(p), F.struct(F.lit(c).alias("component"), F.regexp_extract(path, p, 1).alias("frame_id")))
        for c, p in COMPONENT_PATTERNS.items()])
    found = files.withColumn("__c", tests).where(F.col("__c").isNotNull())
    root = F.regexp_replace(F.regexp_extract(path, r"\A(.*?)/?keyframes/[^/]+/[^/]+\z", 1), "/+$", "")
    out = found.withColumns({"capture_root": root, "component": F.col("__c.component"), "frame_id": F.col("__c.frame_id")}).drop("__c")
    return out.where(~F.col("frame_id").isin("", ".", ".."))


def scan_camera(documents: DataFrame, text: str = "text") -> DataFrame:
    """Camera JSON text to ``width..cy``, ``pose`` and ``tracking_segment``.

    Missing or non-numeric fields, and segments that are no whole numbers, become NULL for :func:`check_camera` to report; the
    last pose row defaults to (0, 0, 0, 1) when none of it is given.
    """
    v = F.try_parse_json(F.col(text))
    number = lambda name: F.when(  # noqa: E731  (booleans are not numbers here)
        F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"),
        F.try_variant_get(v, f"$.{name}", "double"))
    given = F.coalesce(*[number(f"t_3{j}") for j in range(4)]).isNotNull()
    rows = [number(f"t_{i}{j}") for i in range(3) for j in range(4)]
    segment = F.try_variant_get(v, "$.tracking_segment", "variant")
    last = [F.when(given, number(f"t_3{j}")).otherwise(1.0 if j == 3 else 0.0) for j in range(4)]
    return documents.withColumns({
        **{n: number(n) for n in ("width", "height", "fx", "fy", "cx", "cy")},
        "pose": F.array(*rows, *last), "tracking_segment": F.when(F.schema_of_variant(segment).rlike("^(BIGINT|INT)"), F.try_variant_get(v, "$.tracking_segment", "int"))})


def _pixel_rows(keys: list[str], bit_depth: int, color_type: int, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function from image bytes to pixel rows; broken images are skipped."""

    def rows(held: list[tuple[tuple, np.ndarray]]) -> pd.DataFrame:
        grids = png.samples(np.stack([image for _, image in held]), bit_depth, color_type)
        count, height, width, channels = grids.shape
        v, u = np.divmod(np.arange(height * width, dtype=np.int32), width)
        named = pd.DataFrame([key for key, _ in held], columns=keys)
        frame = {k: np.repeat(named[k].to_numpy(), height * width) for k in keys} | {"v": np.tile(v, count).astype(np.int32), "u": np.tile(u, count).astype(np.int32)}
        flat = grids.reshape(-1, channels).astype(np.int32)
        return pd.DataFrame(frame | {n: flat[:, i] for i, n in enumerate(names)})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0  # images of one size
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    image = png.lines(bytes(row.content), bit_depth, color_type)
                except png.UnsupportedImage:
                    continue
                if held and (held[0][1].shape != image.shape or size + image.size > IMAGE_BYTES_PER_BATCH):
                    yield rows(held)
                    held, size = [], 0
                held.append((tuple(getattr(row, k) for k in keys), image))
                size += image.size
        if held:
            yield rows(held)

    return decode


def _scan_image(images: DataFrame, keys: list[str], bit_depth: int, color_type: int, names: list[str]) -> DataFrame:
    types = {k: images.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join([*(f"{k} {t}" for k, t in types.items()), "v int, u int", *(f"{n} int" for n in names)])
    return images.select(*keys, "content").mapInPandas(_pixel_rows(keys, bit_depth, color_type, names), schema)


def scan_depth(images: DataFrame, keys: list[str]) -> DataFrame:
    """16-bit gray PNG bytes to exact ``v, u, depth_mm`` rows."""
    return _scan_image(images, keys, 16, 0, ["depth_mm"])


def check_image_bytes(images: DataFrame, keys: list[str], bit_depth: int, color_type: int) -> DataFrame:
    """Findings: images that do not decode to the last byte; the scans have no pixels of them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for row in batch.itertuples(index=False):
                try:
                    png.lines(bytes(row.content), bit_depth, color_type)
                except png.UnsupportedImage as problem:
                    bad.append(("image_not_decodable", "/".join(str(getattr(row, k)) for k in keys), str(problem)))
            yield pd.DataFrame(bad, columns=["rule", "entity_id", "detail"])

    return images.select(*keys, "content").mapInPandas(rows, "rule string, entity_id string, detail string")


def image_facts(images: DataFrame, key: str = "path") -> DataFrame:
    """What the bytes of PNG images say: ``length, sha256, decoded, max_alpha`` per ``key``.

    An image is decoded to its last sample; ``max_alpha`` is 255 without an alpha channel, and 16-bit
    alpha is scaled to 8 bits without becoming 0 above 0. NULL and broken bytes are not decoded.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch[key], batch["content"]):
                try:
                    _, _, depth, color = png.header(bytes(content))
                    if depth not in (8, 16) or color not in png.SAMPLES_PER_PIXEL:
                        raise png.UnsupportedImage(f"bit depth {depth} color type {color}")
                    grid = png.decode(bytes(content), depth, color)
                    alpha = int(grid[:, :, -1].max(initial=0)) if color in (4, 6) else 255
                    out.append((name, grid.size > 0, -(-alpha * 255 // 65535) if depth == 16 and color in (4, 6) else alpha))
                except (png.UnsupportedImage, TypeError):
                    out.append((name, False, None))
            frame = pd.DataFrame(out, columns=[key, "decoded", "max_alpha"])
            frame["max_alpha"] = frame["max_alpha"].astype("Int32")
            frame["length"], frame["sha256"] = batch["length"].to_numpy(), batch["sha256"].to_numpy()
            yield frame

    kind = images.schema[key].dataType.simpleString()
    sized = images.select(key, "content", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
    return sized.mapInPandas(rows, f"{key} {kind}, decoded boolean, max_alpha int, length long, sha256 string")


def scan_confidence(images: DataFrame, keys: list[str]) -> DataFrame:
    """8-bit gray PNG bytes to ``v, u, confidence`` rows."""
    return _scan_image(images, keys, 8, 0, ["confidence"])


def scan_rgb_png(images: DataFrame, keys: list[str]) -> DataFrame:
    """8-bit RGB PNG bytes to ``v, u, r, g, b`` rows."""
    return _scan_image(images, keys, 8, 2, ["r", "g", "b"])


def scan_rgb(spark: SparkSession, root: str) -> DataFrame:
    """Photo files (JPEG and others) through Spark's image source, as ``path, v, u, r, g, b``."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    raw = images.select("image.*").select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n"), "data")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                # samples come blue first; one channel means gray
                grid = np.frombuffer(r.data, np.uint8).reshape(-1, r.n).astype(np.int32)
                v, u = np.divmod(np.arange(r.height * r.width, dtype=np.int32), r.width)
                b, g, red = (grid[:, 0], grid[:, 1], grid[:, 2]) if r.n >= 3 else (grid[:, 0],) * 3
                yield pd.DataFrame({"path": r.path, "v": v.astype(np.int32), "u": u.astype(np.int32), "r": red, "g": g, "b": b})

    return raw.mapInPandas(rows, "path string, v int, u int, r int, g int, b int")


def image_headers(images: DataFrame, keys: list[str]) -> DataFrame:
    """``width, height, bit_depth, color_type`` of PNG bytes; NULL when it is no PNG."""
    content = F.col("content")
    is_png = (F.substring(F.hex(content), 1, 16) == "89504E470D0A1A0A") & (F.substring(F.hex(content), 25, 8) == "49484452")
    at = lambda first, length: F.conv(F.substring(F.hex(F.substring(content, 1, 33)), first, length), 16, 10).cast("int")
    return images.select(*keys, *[F.when(is_png, at(p, n)).alias(name) for name, p, n in (
        ("width", 33, 8), ("height", 41, 8), ("bit_depth", 49, 2), ("color_type", 51, 2))])


def check_depth_images(images: DataFrame, entity: Column, keys: list[str]) -> DataFrame:
    """Depth images must be 16-bit gray PNG, whatever a decoder would make of them."""
    from plumbline.rules import findings

    heads = image_headers(images, keys)
    wrong = ~F.coalesce((F.col("bit_depth") == 16) & (F.col("color_type") == 0), F.lit(False))
    return findings(heads, entity, {"depth_not_16_bit_gray": (wrong, F.concat_ws("/", "bit_depth", "color_type"))})
