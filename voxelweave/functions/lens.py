"""Lenses: distortion, cropping and scaling of intrinsics, and older calibration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def distorted_places(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, coefficients: Column) -> DataFrame:
    """Where in the distorted image (sx, sy) each pixel of the undistorted one comes from. coefficients: k1, k2, p1, p2, k3, the usual
    order; missing ones count as 0."""
    k1, k2, p1, p2, k3 = (F.coalesce(F.get(coefficients, F.lit(i)), F.lit(0.0)) for i in range(5))
    u, v = (F.col("x") - cx) / fx, (F.col("y") - cy) / fy
    q = u * u + v * v
    radial = 1 + k1 * q + k2 * q * q + k3 * q * q * q
    sx = u * radial + 2 * p1 * u * v + p2 * (q + 2 * u * u)
    sy = v * radial + p1 * (q + 2 * v * v) + 2 * p2 * u * v
    return pixels.withColumns({"sx": fx * sx + cx, "sy": fy * sy + cy})


def scaled_intrinsics(cameras: DataFrame, width: int, height: int, left: Column | int = 0, top: Column | int = 0) -> DataFrame:
    """Intrinsics after a crop (so many pixels from the left and the top go) and a resize of the image to a size. cameras: fx, fy, cx, cy,
    width, height."""
    sx, sy = F.lit(width) / F.col("width"), F.lit(height) / F.col("height")
    return cameras.withColumns({"fx": F.col("fx") * sx, "fy": F.col("fy") * sy, "cx": (F.col("cx") - left) * sx, "cy": (F.col("cy") - top) * sy}).withColumns({"width": F.lit(width), "height": F.lit(height)})


def cropped(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Pixels of a window, counted from its corner."""
    return pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


#: Fields of the two older kinds of calibration, one file for each camera: fixed values of the formats.
LEGACY = (
    "serial_number long, camera_index long, image_width int, image_height int, width int, height int, focal double, focal_y double, win_translate array<double>, k1_deg2 double, k2_deg4 double, k3_deg6 double,"
    "rotate_mat array<double>, rotate array<double>, translate array<double>, colTrans_mat array<double>, colTrans_vec array<double>, cx double, cy double, x_focallen double, y_focallen double,"
    "radial_poly array<double>, extrinsics struct<mtx:array<double>>, colour_transform array<double>"
)


def legacy_rig(spark: SparkSession, folder: str, size: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """Camera files of either older kind as rig rows, numbered in the order of their names: kind, serial, size, intrinsics, rotation and
    translation, distortion (k1, k2, p1, p2, k3) and colour correction. Solver files are told by their focal length or radial polynomial;
    recorder files place the principal point at the middle of the image plus the window's offset."""
    from pyspark.sql.window import Window

    from voxelweave.functions import geometry as G

    files = spark.read.schema(LEGACY).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.col("_metadata.file_path"))
    nth = F.row_number().over(Window.orderBy("path")) - 1  # a file is a camera, so a rig is small
    c = files.withColumn("nth", nth)
    at = lambda name, i: F.coalesce(F.get(F.col(name), F.lit(i)), F.lit(0.0))
    num = lambda name, other=0.0: F.coalesce(F.col(name), other if not isinstance(other, float) else F.lit(other))
    matrix = lambda a, width, rows: F.array(*[F.slice(a, width * i + 1, 3) for i in range(rows)])
    identity = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    zeros = F.array(*[F.lit(0.0)] * 3)
    turn = F.array(*[F.array(*row) for row in G.rodrigues(tuple(F.col("rotate")[i] for i in range(3)))])
    mtx = F.col("extrinsics.mtx")
    solver = F.col("x_focallen").isNotNull() | F.col("radial_poly").isNotNull()
    either = lambda a, b, d: F.when(solver, F.coalesce(b, a, F.lit(d))).otherwise(F.coalesce(a, F.lit(d)))
    c = c.withColumns({"_w": either(F.col("image_width"), F.col("width"), size[0]), "_h": either(F.col("image_height"), F.col("height"), size[1])})
    pick = lambda s, r: F.when(solver, s).otherwise(r)
    colors = F.coalesce(F.col("colTrans_mat"), F.col("colour_transform"))
    return c.select(
        F.when(solver, "solver").otherwise("recorder").alias("kind"),
        F.col("nth").cast("int").alias("camera_index"),
        pick(F.coalesce("serial_number", "nth"), F.coalesce("serial_number", "camera_index", "nth")).alias("serial"),
        F.col("_w").alias("width"),
        F.col("_h").alias("height"),
        pick(num("x_focallen"), num("focal")).alias("fx"),
        pick(F.coalesce("y_focallen", num("x_focallen")), F.coalesce("focal_y", num("focal"))).alias("fy"),
        pick(num("cx"), F.col("_w") / 2 + at("win_translate", 0)).alias("cx"),
        pick(num("cy"), F.col("_h") / 2 + at("win_translate", 1)).alias("cy"),
        pick(F.when(mtx.isNotNull(), matrix(mtx, 4, 3)).otherwise(identity), F.coalesce(F.when(F.col("rotate_mat").isNotNull(), matrix(F.col("rotate_mat"), 3, 3)), F.when(F.col("rotate").isNotNull(), turn), identity)).alias("rotation"),
        pick(F.when(mtx.isNotNull(), F.array(mtx[3], mtx[7], mtx[11])).otherwise(zeros), F.coalesce("translate", zeros)).alias("translation"),
        pick(F.array(at("radial_poly", 1), at("radial_poly", 2), F.lit(0.0), F.lit(0.0), at("radial_poly", 3)), F.array(num("k1_deg2"), num("k2_deg4"), F.lit(0.0), F.lit(0.0), num("k3_deg6"))).alias("dist_coeffs"),
        F.when(colors.isNotNull(), matrix(colors, 3, 3)).alias("color_correction"),
        F.when(colors.isNotNull(), F.coalesce("colTrans_vec", zeros)).alias("color_offset"),
    )
