"""Readers of capture folders, rigs, manifests and blobs. Older calibrations: voxelweave.functions.lens.legacy_rig."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RIG = (
    "version string, rig_id string, created string, cameras array<struct<camera_index:int,serial:string,image_size:array<int>,camera_matrix:array<array<double>>,"
    "dist_coeffs:array<double>,rvec:array<double>,tvec:array<double>,rotation:array<array<double>>,color_correction:array<array<double>>,exposure:double,reprojection_error:double>>"
)
MANIFEST = "version string, fps int, frames int, segments array<struct<start_frame:long,end_frame:long,url:string,bytes:long,frames:array<struct<frame:long,offset:long,size:long,keyframe:boolean>>>>, lod_levels array<struct<level:int,splats:long>>"


def frames(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,exr,tif,tiff}") -> DataFrame:
    """(camera_index, frame_id, path, length): image files of folders named cam_NN, numbered by sorted path. No content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    cam = F.regexp_extract("path", r"cam_(\d+)", 1)
    rows = files.where(cam != "").select(cam.cast("int").alias("camera_index"), "path", "length")
    nth = F.row_number().over(Window.partitionBy("camera_index").orderBy("path")) - 1
    return rows.withColumn("frame_id", nth.cast("long"))


def rig(spark: SparkSession, path: str) -> DataFrame:
    """One row per camera of a rig file: intrinsics, and rotation from the file or from its rotation vector."""
    from voxelweave.functions import geometry as G

    c = spark.read.schema(RIG).option("multiLine", "true").json(path).select("rig_id", F.posexplode("cameras").alias("nth", "c"))
    r = G.rodrigues(tuple(F.col("c.rvec")[i] for i in range(3)))
    turn = F.array(*[F.array(*row) for row in r])
    k = F.col("c.camera_matrix")
    return c.select(
        "rig_id",
        F.coalesce("c.camera_index", "nth").alias("camera_index"),
        "c.serial",
        *[k[i][j].alias(n) for n, i, j in (("fx", 0, 0), ("fy", 1, 1), ("cx", 0, 2), ("cy", 1, 2))],
        F.coalesce("c.rotation", turn).alias("rotation"),
        F.col("c.tvec").alias("translation"),
        "c.dist_coeffs",
        "c.color_correction",
    )


def manifest_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame of a manifest, with its segment."""
    m = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    s = m.select("fps", F.posexplode("segments").alias("segment", "s"))
    return s.select("fps", "segment", "s.start_frame", "s.end_frame", "s.url", F.inline("s.frames"))


def segment_of(manifest: DataFrame, wanted: DataFrame, block: int = 1024) -> DataFrame:
    """The segment that each wanted frame lies in. Segments and frames meet in blocks of frames, a segment in each block that it covers, so
    the join is an equi-join however many segments there are."""
    s = manifest.select("segment", "start_frame", "end_frame", "url").distinct()
    s = s.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_frame") / block), F.floor(F.col("end_frame") / block))))
    rows = wanted.withColumn("_block", F.floor(F.col("frame") / block))
    return rows.join(s, "_block").where(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).drop("_block")


def padded_sources(samples: DataFrame, k: int) -> DataFrame:
    """Exactly k source views for each sample: the last is repeated, surplus ones are left out."""
    s = F.col("sources")
    return samples.withColumn("sources", F.slice(F.concat(s, F.array_repeat(F.element_at(s, -1), k)), 1, k))
