"""Registered queries: surface patches, plane fits, registration, support polygons."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from plumbline.operators import pixels as P
from plumbline.operators import registration as R
from plumbline.operators import surfaces as S
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import PIXEL, rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views

# --- patches on pixels ------------------------------------------------------

W.SQL["patches"] = """SELECT o_orderkey AS patch_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS capture_id, o_orderkey % 100 AS frame_id,
 CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'upright90cw' END AS orientation, (o_custkey * 3) % 170 AS x0, (o_orderkey * 7) % 150 AS y0,
 (o_custkey * 3) % 170 + 20 + o_custkey % 60 AS x1, (o_orderkey * 7) % 150 + 20 + o_orderkey % 50 AS y1 FROM orders"""
W.SQL["selected"] = """SELECT patch_id, p.* FROM px p JOIN patches t ON t.capture_id = p.capture_id AND t.frame_id = p.frame_id
 WHERE CASE WHEN orientation = 'raw' THEN 2 * u ELSE 255 - 2 * v END BETWEEN x0 AND x1 AND CASE WHEN orientation = 'raw' THEN 2 * v ELSE 2 * u END BETWEEN y0 AND y1"""


def patches(spark, sf):
    """Axis-aligned photo polygons from orders, half of them on rotated images."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x0, y0 = (c * 3) % 170, (k * 7) % 150
    x1, y1 = x0 + 20 + c % 60, y0 + 20 + k % 50
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return W.table(spark, sf, "orders").select(
        k.alias("patch_id"), F.when(c % 3 == 0, "A").when(c % 3 == 1, "N").otherwise("R").alias("capture_id"), (k % 100).alias("frame_id"),
        F.when(k % 2 == 0, "raw").otherwise("upright90cw").alias("orientation"), F.lit(W.RGB_SIZE[1]).alias("rgb_height"),
        F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("polygon"))


def selected(spark, sf):
    mapped = P.map_depth_to_rgb_pixel(W.px(spark, sf), W.DEPTH_SIZE, W.RGB_SIZE)
    return S.polygon_select_pixels(mapped, patches(spark, sf))


@query(with_views("px patches selected", "SELECT patch_id, capture_id, frame_id, v, u, depth_mm, confidence FROM selected"))
def polygon_select_pixels(spark, sf):
    return selected(spark, sf).select("patch_id", *PIXEL, "depth_mm", "confidence")


@query(with_views("patches", """, moved AS (SELECT patch_id, orientation, patch_id % 13 = 6 AS broken, x1 + CASE WHEN patch_id % 7 = 3 THEN 60 ELSE 0 END AS right_x, y0 - CASE WHEN patch_id % 11 = 5 THEN 30 ELSE 0 END AS top_y FROM patches)
SELECT 'polygon_invalid' AS rule, CAST(patch_id AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS detail FROM moved WHERE broken
UNION ALL SELECT 'polygon_outside_image', CAST(patch_id AS VARCHAR), CASE WHEN orientation = 'raw' THEN '384x256' ELSE '256x384' END FROM moved
WHERE NOT broken AND (top_y < 0 OR right_x >= CASE WHEN orientation = 'raw' THEN 384 ELSE 256 END)"""))
def check_patch_polygons(spark, sf):
    """Patches of which some are moved over an edge of their image, and some have lost a number."""
    k = F.col("patch_id")
    moved = lambda p: F.struct((p["x"] + F.when(k % 7 == 3, 60).otherwise(0)).alias("x"), (p["y"] - F.when(k % 11 == 5, 30).otherwise(0)).alias("y"))
    broken = F.array(F.struct(F.lit(float("nan")).alias("x"), F.lit(1.0).alias("y")))
    rows = patches(spark, sf).withColumn("rgb_width", F.lit(W.RGB_SIZE[0]))
    ring = F.transform("polygon", moved)
    return S.check_patch_polygons(rows.withColumn("polygon", F.when(k % 13 == 6, F.concat(F.slice(ring, 1, 3), broken)).otherwise(ring)))


@query("""SELECT 'normal_at_right_angles' AS rule, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END || '/' || CAST(c_custkey AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS detail
FROM customer WHERE c_custkey % 4 = 1""")
def check_support_normals(spark, sf):
    """The floors, a quarter of them stood upright."""
    upright = F.transform("vertices", lambda p: F.array(p[0], p[2], p[1]))
    rows = floors(spark, sf).withColumn("vertices", F.when(F.col("polygon_ordinal") % 4 == 1, upright).otherwise(F.col("vertices")))
    return S.check_support_normals(rows, ["capture_id"], (0.0, 1.0, 0.0))


@query(with_views("px patches selected", """SELECT patch_id, count(*) AS native_patch_pixels, count(*) FILTER (WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) AS eligible_pixels,
 round(count(*) FILTER (WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) / CAST(count(*) AS DOUBLE), 6) AS eligible_fraction FROM selected GROUP BY patch_id"""))
def patch_summary(spark, sf):
    return rounded(S.patch_summary(selected(spark, sf)), "eligible_fraction")


@query(with_views("px patches selected", """SELECT patch_id, string_agg(CAST(confidence AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY confidence) AS histogram
 FROM (SELECT patch_id, confidence, count(*) AS n FROM selected GROUP BY patch_id, confidence) GROUP BY patch_id"""))
def patch_confidence_map(spark, sf):
    maps = P.confidence_map(selected(spark, sf), ["patch_id"])
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return maps.select("patch_id", F.array_join(F.transform(F.map_entries("histogram"), entry), ",").alias("histogram"))


# --- plane fits -------------------------------------------------------------

W.SQL["plane_points"] = """SELECT patch_id, x, CASE WHEN patch_id = 200 THEN 2 * x ELSE y END AS y,
 CASE WHEN patch_id = 200 THEN x ELSE 0.3 * x - 0.2 * y + (l_linenumber - 4) * 0.002 + CASE WHEN l_quantity <= 2 THEN 0.5 ELSE 0 END END AS z
 FROM (SELECT *, CAST(CASE WHEN l_orderkey % 501 = 1 THEN 200 WHEN l_orderkey % 500 = 0 THEN 100 + l_suppkey % 10 ELSE l_suppkey % 20 END AS INTEGER) AS patch_id,
  (l_partkey % 100) / CAST(10 AS DOUBLE) AS x, (l_orderkey % 90) / CAST(10 AS DOUBLE) AS y FROM lineitem)"""


def plane_points(spark, sf):
    """Tilted planes with noise and outliers; a few patches too small, one a line."""
    k = F.col("l_orderkey")
    df = W.table(spark, sf, "lineitem").select(
        F.when(k % 501 == 1, 200).when(k % 500 == 0, 100 + F.col("l_suppkey") % 10).otherwise(F.col("l_suppkey") % 20).cast("int").alias("patch_id"),
        ((F.col("l_partkey") % 100) / F.lit(10.0)).alias("x"), ((k % 90) / F.lit(10.0)).alias("y"), "l_linenumber", "l_quantity")
    line = F.col("patch_id") == 200
    z = 0.3 * F.col("x") - 0.2 * F.col("y") + (F.col("l_linenumber") - 4) * 0.002 + F.when(F.col("l_quantity") <= 2, 0.5).otherwise(0.0)
    return df.select("patch_id", "x", F.when(line, F.col("x") * 2).otherwise(F.col("y")).alias("y"), F.when(line, F.col("x")).otherwise(z).alias("z"))


def _fit_sql(rejection: float) -> str:
    """Unrolled fit rounds; the smallest eigenvector comes from the cubic's closed form."""
    ctes = []
    for k in range(6):
        if k == 0:
            source, keep = "plane_points p", "true"
        else:
            source = f"plane_points p JOIN fit{k - 1} f USING (patch_id)"
            keep = f"f.ok AND abs((p.x - f.cx) * f.nx + (p.y - f.cy) * f.ny + (p.z - f.cz) * f.nz) <= {rejection}"
        parts = ", ".join(f"covar_pop(CASE WHEN {keep} THEN p.{a} END, CASE WHEN {keep} THEN p.{b} END) AS {a}{b}"
                          for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
        means = ", ".join(f"avg(CASE WHEN {keep} THEN p.{a} END) AS c{a}" for a in "xyz")
        ctes.append(f"mom{k} AS (SELECT patch_id, count(*) AS n, count(*) FILTER (WHERE {keep}) AS kept, {means}, {parts} FROM {source} GROUP BY patch_id)")
        ctes.append(f"""ea{k} AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS pp FROM mom{k})""")
        ctes.append(f"""eb{k} AS (SELECT *, q + 2 * pp * cos(acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * pp * pp * pp)))) / 3 + 2 * pi() / 3) AS l FROM ea{k})""")
        ctes.append(f"""ec{k} AS (SELECT *, xy * yz - xz * (yy - l) AS ax, xz * xy - (xx - l) * yz AS ay, (xx - l) * (yy - l) - xy * xy AS az,
 xy * (zz - l) - xz * yz AS ex, xz * xz - (xx - l) * (zz - l) AS ey, (xx - l) * yz - xy * xz AS ez,
 (yy - l) * (zz - l) - yz * yz AS dx, yz * xz - xy * (zz - l) AS dy, xy * yz - (yy - l) * xz AS dz FROM eb{k})""")
        ctes.append(f"""ed{k} AS (SELECT *, ax * ax + ay * ay + az * az AS sa, ex * ex + ey * ey + ez * ez AS sb, dx * dx + dy * dy + dz * dz AS sd FROM ec{k})""")
        pick = lambda c: f"CASE WHEN sa >= sb AND sa >= sd THEN a{c} / sqrt(sa) WHEN sb >= sd THEN e{c} / sqrt(sb) ELSE d{c} / sqrt(sd) END AS n{c}"
        ctes.append(f"fit{k} AS (SELECT patch_id, n, kept, cx, cy, cz, {pick('x')}, {pick('y')}, {pick('z')}, n >= 30 AND kept >= 30 AND patch_id <> 200 AS ok FROM ed{k})")
    ctes.append(f"""fin AS (SELECT patch_id, count(*) FILTER (WHERE abs((p.x - f.cx) * f.nx + (p.y - f.cy) * f.ny + (p.z - f.cz) * f.nz) <= {rejection}) AS inliers FROM plane_points p JOIN fit5 f USING (patch_id) GROUP BY patch_id)""")
    ctes.append("""plane AS (SELECT patch_id, f.n, CASE WHEN f.n < 30 THEN 'too_few_samples' WHEN patch_id = 200 THEN 'no_span' WHEN NOT f.ok OR inliers < 30 THEN 'too_few_inliers' ELSE 'fitted' END AS status,
 inliers, CASE WHEN ny < 0 THEN -nx ELSE nx END AS nx, CASE WHEN ny < 0 THEN -ny ELSE ny END AS ny, CASE WHEN ny < 0 THEN -nz ELSE nz END AS nz, cx, cy, cz FROM fit5 f JOIN fin USING (patch_id))""")
    return ", " + ",\n".join(ctes)


REJECTION = 0.02


@query(with_views("plane_points", _fit_sql(REJECTION) + """
SELECT patch_id, n, status, CASE WHEN status = 'fitted' THEN inliers END AS inlier_count, CASE WHEN status = 'fitted' THEN n - inliers END AS rejected_count,
 CASE WHEN status = 'fitted' THEN round(nx, 6) END AS nx, CASE WHEN status = 'fitted' THEN round(ny, 6) END AS ny, CASE WHEN status = 'fitted' THEN round(nz, 6) END AS nz,
 CASE WHEN status = 'fitted' THEN round(cx * nx + cy * ny + cz * nz, 6) END AS plane_offset FROM plane"""))
def plane_fit(spark, sf):
    fits = S.plane_fit(plane_points(spark, sf), ["patch_id"], REJECTION)
    return rounded(fits.select("patch_id", "n", "status", "inlier_count", "rejected_count", "nx", "ny", "nz", "plane_offset"),
                   "nx", "ny", "nz", "plane_offset")


@query(with_views("plane_points", _fit_sql(REJECTION) + """, r AS (SELECT patch_id, p.x, p.y, p.z, abs((p.x - f.cx) * nx + (p.y - f.cy) * ny + (p.z - f.cz) * nz) AS residual, ny, inliers, n
 FROM plane_points p JOIN plane f USING (patch_id) WHERE status = 'fitted')
SELECT patch_id, max(inliers) AS inlier_count, max(n) - max(inliers) AS rejected_count, round(degrees(acos(least(1.0, abs(max(ny))))), 6) AS tilt_degrees,
 round(quantile_cont(residual, 0.5), 6) AS all_median, round(quantile_cont(residual, 0.95), 6) AS all_p95, round(max(residual), 6) AS all_max,
 round(quantile_cont(residual, 0.5) FILTER (WHERE residual <= 0.02), 6) AS inlier_median, round(quantile_cont(residual, 0.95) FILTER (WHERE residual <= 0.02), 6) AS inlier_p95,
 round(max(residual) FILTER (WHERE residual <= 0.02), 6) AS inlier_max,
 round(min(z) FILTER (WHERE residual <= 0.02), 6) AS min_z, round(max(z) FILTER (WHERE residual <= 0.02), 6) AS max_z FROM r GROUP BY patch_id"""))
def plane_attributes(spark, sf):
    points = plane_points(spark, sf)
    out = S.plane_attributes(points, S.plane_fit(points, ["patch_id"], REJECTION), ["patch_id"], REJECTION)
    out = out.drop("min_x", "min_y", "max_x", "max_y")
    return rounded(out, *[c for c in out.columns if c not in ("patch_id", "inlier_count", "rejected_count")])


# --- transforms and registration --------------------------------------------

W.SQL["vec"] = """SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy, CAST(embedding[3] AS DOUBLE) AS sz,
 CAST(embedding[4] AS DOUBLE) * 0.01 AS ex, CAST(embedding[5] AS DOUBLE) * 0.01 AS ey, CAST(embedding[6] AS DOUBLE) * 0.01 AS ez,
 CAST(CASE label % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 0 END AS DOUBLE) AS c, CAST(CASE label % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 1 END AS DOUBLE) AS s
 FROM embeddings"""


def _yaw(key):
    k = key % 4
    c = F.when(k == 0, 1.0).when(k == 1, 0.6).when(k == 2, 0.8).otherwise(0.0)
    s = F.when(k == 0, 0.0).when(k == 1, 0.8).when(k == 2, 0.6).otherwise(1.0)
    return c, s


def rotation_matrix(key):
    """Exact-rational yaw and an integer shift per label."""
    c, s = _yaw(key)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, zero, s, key.cast("double"), zero, one, zero, one, -s, zero, c, -key.cast("double"), zero, zero, zero, one)


def vectors(spark, sf):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return W.table(spark, sf, "embeddings").select(
        "vec_id", "label", e(1).alias("sx"), e(2).alias("sy"), e(3).alias("sz"),
        (e(4) * 0.01).alias("ex"), (e(5) * 0.01).alias("ey"), (e(6) * 0.01).alias("ez"))


def label_transforms(spark, sf):
    return W.table(spark, sf, "embeddings").select("label").distinct().withColumn("matrix", rotation_matrix(F.col("label")))


def landmarks(spark, sf):
    """Landmarks whose fit rows follow the transform exactly and whose check rows carry noise."""
    c, s = _yaw(F.col("label"))
    check = F.col("vec_id") % 5 == 0
    noise = lambda n: F.when(check, F.col(n)).otherwise(0.0)
    return vectors(spark, sf).select(
        "vec_id", "label", F.when(check, "check").otherwise("fit").alias("role"), "sx", "sy", "sz",
        (c * F.col("sx") + s * F.col("sz") + F.col("label") + noise("ex")).alias("tx"),
        (F.col("sy") + 1 + noise("ey")).alias("ty"),
        (c * F.col("sz") - s * F.col("sx") - F.col("label") + noise("ez")).alias("tz"))


@query(with_views("vec", "SELECT vec_id, round(c * sx + s * sz + label, 9) AS x, round(sy + 1, 9) AS y, round(c * sz - s * sx - label, 9) AS z FROM vec"))
def transform_points(spark, sf):
    points = vectors(spark, sf).select("vec_id", "label", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    return rounded(S.transform_points(points, label_transforms(spark, sf), ["label"]).select("vec_id", "x", "y", "z"), "x", "y", "z", places=9)


@query(with_views("vec", """SELECT vec_id, round(c * sx + s * sz, 9) AS nx, round(sy, 9) AS ny, round(c * sz - s * sx, 9) AS nz,
 round(ex + (c * sx + s * sz) * label + sy - (c * sz - s * sx) * label, 9) AS plane_offset FROM vec"""))
def transform_plane(spark, sf):
    planes = vectors(spark, sf).select("vec_id", "label", F.col("sx").alias("nx"), F.col("sy").alias("ny"), F.col("sz").alias("nz"), F.col("ex").alias("plane_offset"))
    out = S.transform_plane(planes, label_transforms(spark, sf), ["label"]).select("vec_id", "nx", "ny", "nz", "plane_offset")
    return rounded(out, "nx", "ny", "nz", "plane_offset", places=9)


@query(with_views("vec", """SELECT label, count(*) AS n, 'fitted' AS status, round(max(c), 6) + 0.0 AS m00, round(max(s), 6) + 0.0 AS m02, CAST(1 AS DOUBLE) AS m11,
 round(-max(s), 6) + 0.0 AS m20, CAST(label AS DOUBLE) AS t0, CAST(1 AS DOUBLE) AS t1, CAST(-label AS DOUBLE) + 0.0 AS t2 FROM vec WHERE vec_id % 5 <> 0 GROUP BY label"""))
def rigid_fit(spark, sf):
    """Fit rows carry no noise, so the fit must return the known transform."""
    fit = R.rigid_fit(landmarks(spark, sf), ["label"])
    entry = lambda i, name: (F.round(F.col("matrix")[i], 6) + 0.0).alias(name)
    return fit.select("label", "n", "status", entry(0, "m00"), entry(2, "m02"), entry(5, "m11"), entry(8, "m20"), entry(3, "t0"), entry(7, "t1"), entry(11, "t2"))


@query(with_views("vec", """SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'check' ELSE 'fit' END AS role,
 CASE WHEN vec_id % 5 = 0 THEN round(sqrt(ex * ex + ey * ey + ez * ez), 8) ELSE 0 END AS error_m FROM vec"""))
def landmark_residuals(spark, sf):
    marks = landmarks(spark, sf)
    return rounded(R.landmark_residuals(marks, label_transforms(spark, sf), ["label"]).select("vec_id", "role", "error_m"), "error_m", places=8)


@query(with_views("vec", """, e AS (SELECT label, CASE WHEN vec_id % 5 = 0 THEN 'check' ELSE 'fit' END AS role,
 CASE WHEN vec_id % 5 = 0 THEN sqrt(ex * ex + ey * ey + ez * ez) ELSE 0 END AS error_m FROM vec)
SELECT label, role, count(*) AS n, round(quantile_cont(error_m, 0.5), 8) AS median, round(quantile_cont(error_m, 0.95), 8) AS p95, round(max(error_m), 8) AS max FROM e GROUP BY label, role"""))
def residual_summary_by_role(spark, sf):
    """Fitted transforms, not the known ones: the whole registration path."""
    marks = landmarks(spark, sf)
    residuals = R.landmark_residuals(marks, R.rigid_fit(marks, ["label"]), ["label"])
    return rounded(R.residual_summary_by_role(residuals, ["label"]), "median", "p95", "max", places=8)


W.SQL["scope"] = """SELECT s_nationkey AS capture_id, s_suppkey AS frame_id, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 END AS tracking_segment FROM supplier"""


def _scope(spark, sf):
    frames = W.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("capture_id"), F.col("s_suppkey").alias("frame_id"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 3).alias("tracking_segment"))
    ledger = W.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("capture_id"), (F.col("n_nationkey") % 3).cast("long").alias("tracking_segment"), F.col("n_name").alias("target_frame"),
        rotation_matrix(F.col("n_nationkey")).alias("matrix"), (F.col("n_regionkey") != 2).alias("accepted"))
    return R.apply_registration_scope(frames, ledger)


@query(with_views("scope", """SELECT capture_id, frame_id, tracking_segment, n_name AS target_frame FROM scope JOIN nation ON n_nationkey = capture_id AND n_nationkey % 3 = tracking_segment WHERE n_regionkey <> 2"""))
def apply_registration_scope(spark, sf):
    return _scope(spark, sf)[0].select("capture_id", "frame_id", "tracking_segment", "target_frame")


@query(with_views("scope", """SELECT 'no_accepted_scope' AS rule, CAST(capture_id AS VARCHAR) || '/' || CAST(frame_id AS VARCHAR) AS entity_id, CAST(tracking_segment AS VARCHAR) AS detail
FROM scope WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = capture_id AND n_nationkey % 3 = tracking_segment AND n_regionkey <> 2)"""))
def registration_scope_findings(spark, sf):
    return _scope(spark, sf)[1]


# --- support polygons and repeat comparison ---------------------------------

W.SQL["floors"] = """SELECT c_custkey AS polygon_ordinal, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS capture_id,
 c_custkey % 13 - 3 AS x0, c_custkey % 13 - 2 + c_custkey % 3 AS x1, (c_custkey * 7) % 17 - 5 AS z0, (c_custkey * 7) % 17 - 4 + c_nationkey % 2 AS z1, (c_custkey % 5) * CAST(0.7 AS DOUBLE) AS y FROM customer"""


def floors(spark, sf):
    """Horizontal rectangles at five heights."""
    k = F.col("c_custkey")
    x0, z0 = k % 13 - 3, (k * 7) % 17 - 5
    x1, z1, y = x0 + 1 + k % 3, z0 + 1 + F.col("c_nationkey") % 2, (k % 5) * 0.7
    corner = lambda x, z: F.array(x.cast("double"), y, z.cast("double"))
    return W.table(spark, sf, "customer").select(
        k.alias("polygon_ordinal"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("capture_id"),
        F.array(corner(x0, z0), corner(x1, z0), corner(x1, z1), corner(x0, z1)).alias("vertices"))


@query(with_views("px cam pts floors", """, m AS (SELECT p.capture_id, p.frame_id, p.v, p.u, f.polygon_ordinal, p.y - f.y AS s,
 row_number() OVER (PARTITION BY p.capture_id, p.frame_id, p.v, p.u ORDER BY abs(p.y - f.y), f.polygon_ordinal) AS r
 FROM pts p JOIN floors f ON f.capture_id = p.capture_id AND p.x BETWEEN f.x0 - 1e-9 AND f.x1 + 1e-9 AND p.z BETWEEN f.z0 - 1e-9 AND f.z1 + 1e-9)
SELECT p.capture_id, p.frame_id, p.v, p.u, m.polygon_ordinal AS supporting_polygon, round(m.s, 9) AS residual_m, m.s IS NOT NULL AS overlap
FROM pts p LEFT JOIN m ON r = 1 AND m.capture_id = p.capture_id AND m.frame_id = p.frame_id AND m.v = p.v AND m.u = p.u"""))
def nearest_support_polygon(spark, sf):
    out = S.nearest_support_polygon(W.pts(spark, sf), floors(spark, sf), ["capture_id"], ["frame_id", "v", "u"], source_normal=(0.0, 1.0, 0.0))
    return rounded(out.select(*PIXEL, "supporting_polygon", "residual_m", "overlap"), "residual_m", places=9)


@query("""WITH c AS (SELECT l_orderkey AS point_id, l_partkey AS polygon_ordinal, round((l_linenumber - 4) * 0.1, 1) AS residual_m FROM lineitem)
SELECT point_id, polygon_ordinal, residual_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY abs(residual_m), polygon_ordinal, residual_m) AS r FROM c) WHERE r = 1""")
def closest_support(spark, sf):
    """Line items as candidate supports of their order, with many equal distances."""
    c = W.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("point_id"), F.col("l_partkey").alias("polygon_ordinal"), F.round((F.col("l_linenumber") - 4) * 0.1, 1).alias("residual_m"))
    return S.closest_support(c, ["point_id"])


def label_pairs(spark, sf):
    """Each label with the next one that exists."""
    labels = W.table(spark, sf, "embeddings").select("label").distinct()
    return labels.select(F.col("label").alias("first"), F.lead("label").over(Window.orderBy("label")).alias("second")).where("second IS NOT NULL")


_HULL = """, pair AS (SELECT a, b FROM (SELECT label AS a, lead(label) OVER (ORDER BY label) AS b FROM (SELECT DISTINCT label FROM vec)) WHERE b IS NOT NULL),
{points},
edge AS (SELECT i.pair_id, i.px AS ax, i.py AS ay, j.px AS bx, j.py AS by FROM bp i JOIN bp j ON i.pair_id = j.pair_id AND i.vec_id <> j.vec_id
 WHERE NOT EXISTS (SELECT 1 FROM bp k WHERE k.pair_id = i.pair_id AND k.vec_id <> i.vec_id AND k.vec_id <> j.vec_id
  AND (j.px - i.px) * (k.py - i.py) - (j.py - i.py) * (k.px - i.px) < 0)),
inside AS (SELECT * FROM ap p WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.pair_id = p.pair_id
 AND ((e.bx - e.ax) * (p.py - e.ay) - (e.by - e.ay) * (p.px - e.ax)) / sqrt((e.bx - e.ax) ** 2 + (e.by - e.ay) ** 2) < -1e-9))
"""


@query(with_views("vec", _HULL.format(points="""ap AS (SELECT a AS pair_id, vec_id, sx AS px, sy AS py FROM pair JOIN vec ON label = a),
bp AS (SELECT a AS pair_id, vec_id, sx AS px, sy AS py FROM pair JOIN vec ON label = b)""") + "SELECT pair_id, vec_id FROM inside"))
def convex_overlap(spark, sf):
    """Vectors of one label inside the hull of the next label's vectors."""
    flat = vectors(spark, sf).select("vec_id", "label", F.col("sx").alias("px"), F.col("sy").alias("py"))
    pairs = label_pairs(spark, sf)
    first = flat.join(pairs.select(F.col("first").alias("label")), "label").withColumnRenamed("label", "pair_id")
    second = flat.join(pairs.select(F.col("second").alias("label"), F.col("first").alias("pair_id")), "label").select("pair_id", "px", "py")
    return S.convex_overlap(first, second, "pair_id").select("pair_id", "vec_id")


_PATCH_PLANE = """plane AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) % 2 AS odd, CASE WHEN label < (SELECT max(label) FROM vec) THEN 1 END AS fitted,
 CASE WHEN label < 5 THEN 'wall' ELSE 'floor' END AS surface FROM (SELECT DISTINCT label FROM vec)),
sound AS (SELECT p.a, p.b, x.odd FROM pair p JOIN plane x ON x.label = p.a JOIN plane y ON y.label = p.b WHERE x.fitted = 1 AND y.fitted = 1 AND x.surface = y.surface),
ap AS (SELECT a AS pair_id, vec_id, sx AS px, CASE WHEN odd = 0 THEN sy ELSE 0.8 * sy - 0.6 * sz END AS py, odd FROM sound JOIN vec ON label = a),
bp AS (SELECT a AS pair_id, vec_id, sx AS px, CASE WHEN odd = 0 THEN sy ELSE 0.8 * sy - 0.6 * sz END AS py FROM sound JOIN vec ON label = b)"""


def _compared(spark, sf):
    labels = W.table(spark, sf, "embeddings").select("label").distinct()
    up, down = Window.orderBy("label"), Window.orderBy(F.desc("label"))
    labels = labels.select("label", F.row_number().over(up).alias("place"), F.row_number().over(down).alias("left"))
    odd, fitted = F.col("place") % 2 == 0, F.col("left") > 1
    pick = lambda even, other: F.when(fitted, F.when(odd, F.array(*map(F.lit, other))).otherwise(F.array(*map(F.lit, even))))
    number = lambda even, other: F.when(fitted, F.when(odd, F.lit(other)).otherwise(F.lit(even)))
    planes = labels.select(
        F.col("label").alias("patch_id"), F.when(F.col("label") < 5, "wall").otherwise("floor").alias("physical_surface"), F.lit("site").alias("analysis_frame"),
        number(0.0, 0.0).alias("cx"), number(0.0, 0.0).alias("cy"), number(0.0, 0.0).alias("cz"),
        number(0.0, 0.0).alias("nx"), number(0.0, 0.6).alias("ny"), number(1.0, 0.8).alias("nz"),
        pick((1.0, 0.0, 0.0), (1.0, 0.0, 0.0)).alias("basis_u"), pick((0.0, 1.0, 0.0), (0.0, 0.8, -0.6)).alias("basis_v"))
    pairs = label_pairs(spark, sf).select(F.col("first").alias("pair_id"), "first", "second")
    points = vectors(spark, sf).select(F.col("label").alias("patch_id"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    return S.compare_patches(pairs, planes, points)


@query(with_views("vec", _HULL.format(points=_PATCH_PLANE) + """, gap AS (SELECT pair_id, abs(CASE WHEN odd = 0 THEN 0.6 * py ELSE -0.6 * py END) AS g FROM inside),
st AS (SELECT pair_id, count(*) AS n, round(quantile_cont(g, 0.5), 8) AS med, round(quantile_cont(g, 0.95), 8) AS p95, round(max(g), 8) AS mx FROM gap GROUP BY pair_id)
SELECT p.a AS pair_id, p.a AS first, p.b AS second, CASE WHEN x.fitted = 1 AND y.fitted = 1 THEN 'measured' ELSE 'not measured' END AS status,
 CASE WHEN x.fitted = 1 AND y.fitted = 1 THEN coalesce(st.n, 0) END AS overlap_samples, med AS separation_median_m, p95 AS separation_p95_m, mx AS separation_max_m,
 CASE WHEN x.fitted = 1 AND y.fitted = 1 THEN round(degrees(acos(0.8)), 6) END AS normal_angle_degrees
FROM pair p JOIN plane x ON x.label = p.a JOIN plane y ON y.label = p.b LEFT JOIN st ON st.pair_id = p.a
WHERE NOT coalesce(x.fitted = 1 AND y.fitted = 1 AND x.surface <> y.surface, false)"""))
def compare_patches(spark, sf):
    """Labels as patches on two alternating planes; one pair crosses surfaces, one is unfitted."""
    out, _ = _compared(spark, sf)
    out = rounded(out, "separation_median_m", "separation_p95_m", "separation_max_m", places=8)
    return rounded(out, "normal_angle_degrees")


@query("""WITH l AS (SELECT DISTINCT label FROM embeddings), p AS (SELECT label AS a, lead(label) OVER (ORDER BY label) AS b FROM l), m AS (SELECT max(label) AS last FROM l)
SELECT 'different_surface' AS rule, CAST(a AS VARCHAR) AS entity_id, CAST(a AS VARCHAR) || '/' || CAST(b AS VARCHAR) AS detail FROM p, m WHERE b < last AND a < 5 AND b >= 5""")
def compare_patches_findings(spark, sf):
    """The pairs that the comparison refuses: fitted patches of different surfaces."""
    return _compared(spark, sf)[1]
