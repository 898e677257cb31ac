"""Sources and sinks: capture streams, and files of frames that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave.functions import binary as B
from voxelweave.operators import codec as D
from voxelweave.plans.codec_queries import spz_round_trip  # noqa: F401  registered first
from voxelweave.plans.registry import oracle_sql_of, query
from voxelweave.sources import capture as C
from voxelweave.sources import views as V
from voxelweave.sources import writers as W
from voxelweave.sources.scratch import fresh


def captured(spark, d):
    """A capture message for each vector: four cameras of 4 x 4 grey pixels, the fourth without data in every fifth frame."""
    level = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 1) * 127.5)))), 2, "0")

    def image(c: int):
        grey = F.unhex(F.array_join(F.transform(F.slice("embedding", 16 * c + 1, 16), lambda x: level(x.cast("double"))), ""))
        held = grey if c < 3 else F.when(F.col("vec_id") % 5 != 0, grey)
        none = F.lit(None)
        fields = [("camera_index", F.lit(c)), ("serial_number", F.lit(900 + c)), ("width", F.lit(4)), ("height", F.lit(4)), ("channels", F.lit(1)), ("bit_depth", F.lit(8)), ("cpu_data", held)]
        fields += [("gpu_ptr", F.lit(0).cast("long")), ("shm_handle", none.cast("string")), ("alpha_data", none.cast("binary")), ("depth_data", none.cast("binary"))]
        return F.struct(*[v.alias(k) for k, v in fields])

    v = V.table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) = 64")
    metrics = F.struct((F.col("vec_id") % 20 / 2.0).alias("capture_latency_ms"), F.lit(0.25).alias("sync_delta_ms"), F.lit(0).alias("dropped_frames"), F.array(F.lit(1.0), F.lit(2.5)).alias("per_camera_latency_ms"))
    return v.select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") * 33_333_333).alias("timestamp_ns"), F.lit(4).alias("num_cameras"), F.array(*map(image, range(4))).alias("images"), metrics.alias("metrics"))


_IMAGES = """v AS (SELECT vec_id AS frame_id, c AS camera_index, [CAST(x AS DOUBLE) for x in embedding] AS e, c < 3 OR vec_id % 5 <> 0 AS held FROM embeddings, range(4) t(c) WHERE len(embedding) = 64)"""
_HEX = "CASE WHEN held THEN array_to_string([printf('%02X', CAST(greatest(0, least(255, floor((x + 1) * 127.5))) AS INTEGER)) for x in e[16*camera_index+1:16*camera_index+16]], '') END"


@query("capture_stream", f"WITH {_IMAGES} SELECT frame_id, CAST(frame_id * 33333333 AS BIGINT) AS timestamp_ns, CAST(camera_index AS INTEGER) AS camera_index, CAST(900 + camera_index AS INTEGER) AS serial_number, {_HEX} AS pixels, CAST(frame_id % 20 AS DOUBLE) / 2 AS latency_ms FROM v")
def capture_stream(spark, d):
    """Messages are recorded as segments of a capture folder and come back as a stream; its rows are those of a table."""
    folder, table = fresh(spark, "capture"), fresh(spark, "captured")
    C.write_capture(captured(spark, d), folder)
    stream = C.read_capture(spark, folder, stream=True)
    rows = stream.where("error IS NULL").select("frame_id", "timestamp_ns", F.col("metrics.capture_latency_ms").alias("latency_ms"), F.explode("images").alias("i"))
    rows = rows.select("frame_id", "timestamp_ns", "i.camera_index", "i.serial_number", F.hex("i.cpu_data").alias("pixels"), "latency_ms")
    rows.writeStream.option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start(table, format="parquet").awaitTermination()
    return spark.read.schema(rows.schema).parquet(table)


@query("capture_acks", "SELECT vec_id AS frame_id, vec_id % 5 <> 0 AS accepted, CAST(vec_id % 20 AS DOUBLE) / 2 AS processing_latency_ms FROM embeddings WHERE len(embedding) = 64")
def capture_acks(spark, d):
    folder = fresh(spark, "capture")
    C.write_capture(captured(spark, d), folder)
    return C.acknowledged(C.read_capture(spark, folder))


_LABELLED, _IN_BLOCKS = "CAST(label AS BIGINT) AS frame_id", "vec_id // 256 AS frame_id"
_SPLATS = V.SPLATS.replace(_LABELLED, _IN_BLOCKS)


def _splats(spark, d):
    """Splats in frames of at most 256, so that their number grows with the table and their size does not."""
    return V.splats(spark, d).withColumn("frame_id", F.expr("splat_id div 256"))


def _files(spark, payloads, suffix):
    """(frame_id, payload) of payloads that were written as files."""
    folder = fresh(spark, suffix)
    W.write_payloads(payloads, folder, f"frame_%06d.{suffix}")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"frame_*.{suffix}").load(folder)
    return found.select(F.regexp_extract("path", r"frame_(-?\d+)\.", 1).cast("long").alias("frame_id"), F.col("content").alias("payload"))


_FIELDS = ["x", "y", "z", "f_dc_0", "f_rest_0", "f_rest_44", "opacity", "rot_0"]


@query(
    "ply_files",
    f"WITH {_SPLATS} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY splat_id) - 1 AS n, CAST(px AS FLOAT)::DOUBLE AS x, CAST(py AS FLOAT)::DOUBLE AS y, CAST(pz AS FLOAT)::DOUBLE AS z, CAST(sh[1] AS FLOAT)::DOUBLE AS f_dc_0, CAST(sh[4] AS FLOAT)::DOUBLE AS f_rest_0, CAST(sh[48] AS FLOAT)::DOUBLE AS f_rest_44, round(opacity, 5) AS opacity, round(qw, 5) AS rot_0 FROM splats",
)
def ply_files(spark, d):
    """Splat frames as PLY files, one a frame, read back."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for frame, payload in zip(batch["frame_id"], batch["payload"], strict=True):
                names, values = B.parse_ply(bytes(payload))
                out = pd.DataFrame({c: values[:, names.index(c)].astype(float) for c in _FIELDS})
                out.insert(0, "n", range(len(out)))
                out.insert(0, "frame_id", frame)
                yield out

    rows = _files(spark, W.ply_payloads(_splats(spark, d)), "ply").mapInPandas(run, "frame_id long, n long, " + ", ".join(f"{c} double" for c in _FIELDS))
    return rows.withColumns({c: F.round(c, 5) for c in ("opacity", "rot_0")})


@query("spz_files", oracle_sql_of("spz_round_trip").replace(_LABELLED, _IN_BLOCKS))
def spz_files(spark, d):
    """The same as compressed keyframe files."""
    out = D.decode_frames(_files(spark, D.encode_frames(_splats(spark, d), "spz"), "spz"), "spz")
    return out.select("frame_id", "splat_id", F.round("opacity", 6).alias("opacity"), F.round("py", 4).alias("py"), F.round("sx", 4).alias("sx"), F.round("qw", 6).alias("qw"), F.round(F.col("sh")[47], 6).alias("sh47"))


_BOUNDS = ", ".join(f"CAST({f}(p{c}) AS FLOAT)::DOUBLE AS {f}_{c}" for f in ("min", "max") for c in "xyz")


@query("glb_files", f"WITH {_SPLATS} SELECT frame_id, count(*) AS splats, 20::INTEGER AS attributes, {_BOUNDS} FROM splats GROUP BY 1")
def glb_files(spark, d):
    """The same as glTF files of points: what their documents say of them."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for frame, payload in zip(batch["frame_id"], batch["payload"], strict=True):
                document, _ = B.parse_glb(bytes(payload))
                own = document["meshes"][0]["primitives"][0]["attributes"]
                at = document["accessors"][own["POSITION"]]
                rows.append((frame, at["count"], len(own), *at["min"], *at["max"]))
            yield pd.DataFrame(rows, columns=["frame_id", "splats", "attributes", *[f"{f}_{c}" for f in ("min", "max") for c in "xyz"]])

    bounds = ", ".join(f"{f}_{c} double" for f in ("min", "max") for c in "xyz")
    return _files(spark, W.splat_payloads(_splats(spark, d)), "glb").mapInPandas(run, f"frame_id long, splats long, attributes int, {bounds}")
