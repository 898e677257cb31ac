"""Writers: per-frame files, JSON stats and manifests. Every writer goes through Spark's committers, so retries leave no halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import binary as B
from voxelweave.sources.frame_files import write_files

#: The 59 attributes of a splat in a PLY file (positions, three constant colour terms, 45 others, opacity, scales, rotation): fixed order.
PLY_COLUMNS = ["x", "y", "z", *[f"f_dc_{i}" for i in range(3)], *[f"f_rest_{i}" for i in range(45)], "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]


def ply_payloads(splats: DataFrame, binary: bool = True) -> DataFrame:
    """(frame_id, payload): one PLY for each frame with all attributes of its splats; colour bands that a splat lacks are 0."""
    import numpy as np
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("splat_id")
        sh = np.zeros((len(p), 48))
        for i, own in enumerate(p["sh"]):
            sh[i, : len(own)] = own
        rows = np.concatenate([p[["px", "py", "pz"]].to_numpy(float), sh, p[["opacity", "sx", "sy", "sz", "qw", "qx", "qy", "qz"]].to_numpy(float)], 1)
        return pd.DataFrame({"frame_id": [p["frame_id"].iloc[0]], "payload": [B.ply(PLY_COLUMNS, rows, binary)]})

    columns = ["frame_id", "splat_id", "px", "py", "pz", "sx", "sy", "sz", "qw", "qx", "qy", "qz", "opacity", "sh"]
    return splats.select(*columns).groupBy("frame_id").applyInPandas(run, "frame_id long, payload binary")


def mesh_payloads(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh_id, payload): one GLB for each mesh. vertices: mesh_id, vid from 0, x, y, z and whatever of nx, ny, nz, u, v, and r, g, b (0 to
    255) there is; faces: mesh_id, fid, i0, i1, i2."""
    import numpy as np
    import pandas as pd

    def run(name: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("vid"), f.sort_values("fid")
        part = lambda *cols: v[list(cols)].to_numpy(float) if set(cols) <= set(v.columns) else None
        rgb = part("r", "g", "b")
        colors = None if rgb is None else np.concatenate([rgb, np.full((len(rgb), 1), 255.0)], 1)
        return pd.DataFrame({"mesh_id": [name[0]], "payload": [B.mesh_glb(part("x", "y", "z"), part("nx", "ny", "nz"), f[["i0", "i1", "i2"]].to_numpy(), part("u", "v"), colors)]})

    return vertices.groupBy("mesh_id").cogroup(faces.groupBy("mesh_id")).applyInPandas(run, "mesh_id long, payload binary")


def splat_payloads(splats: DataFrame, compressed: bool = False) -> DataFrame:
    """(frame_id, payload): one GLB of points for each frame, with plain attributes or with a compressed chunk inside."""
    import pandas as pd

    from voxelweave.operators.codec import _arrays

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, frame = _arrays(p), int(p["frame_id"].iloc[0])
        return pd.DataFrame({"frame_id": [frame], "payload": [B.chunk_glb(B.spz_keyframe(*a), len(p), frame) if compressed else B.splats_glb(*a)]})

    return splats.groupBy("frame_id").applyInPandas(run, "frame_id long, payload binary")


def sample_metadata(samples: DataFrame, cameras: DataFrame) -> DataFrame:
    """(rig, frame_id, target, cameras, metadata): what goes beside the images of a training sample, as JSON: the parameters of its target and
    of its sources in order, and the counts. samples: rig, frame_id, target, sources; cameras: rig, camera_index and parameters."""
    own = F.struct(*[c for c in cameras.columns if c != "rig"])
    named = cameras.select("rig", F.col("camera_index").alias("_c"), own.alias("_p"))
    views = samples.select("rig", "frame_id", "target", F.posexplode(F.concat(F.array("target"), "sources")).alias("_n", "_c"))
    held = views.join(named, ["rig", "_c"]).groupBy("rig", "frame_id", "target").agg(F.array_sort(F.collect_list(F.struct("_n", "_p"))).alias("_v"))
    listed = F.transform("_v", lambda v: v["_p"])
    facts = F.struct(F.col("frame_id"), F.col("target"), (F.size("_v") - 1).alias("sources"))
    return held.select("rig", "frame_id", "target", F.to_json(F.struct(listed.alias("cameras"))).alias("cameras"), F.to_json(facts).alias("metadata"))


def write_payloads(payloads: DataFrame, folder: str, pattern: str = "frame_%06d.bin", key: str = "frame_id") -> None:
    """One file for each payload, named by its key; other files of the folder go."""
    write_files(payloads.select(F.format_string(pattern, F.col(key)).alias("name"), "payload"), folder)


def write_stats(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(chunks: DataFrame, fps: int) -> DataFrame:
    """One JSON row: totals and segments in order. chunks: start_frame, end_frame, bytes, is_keyframe."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    seg = F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "bytes", "is_keyframe")))
    out = chunks.agg(seg.alias("segments"), F.sum("bytes").alias("total_bytes"), F.sum(n).alias("frames"), F.count("*").alias("chunks"))
    out = out.withColumns({"fps": F.lit(fps), "duration_s": F.col("frames") / fps, "mean_chunk_bytes": F.expr("CASE WHEN chunks > 0 THEN total_bytes div chunks ELSE 0 END")})
    return out.select(F.to_json(F.struct("fps", "frames", "duration_s", "total_bytes", "mean_chunk_bytes", "segments")).alias("json"))
