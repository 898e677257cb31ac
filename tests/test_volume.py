"""The block-sparse volume against one that holds every voxel; the mesh of a sphere seen from around."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import fusion as U
from voxelweave.operators import volume as Z

SIZE, FOCUS, RADIUS = 40, 45.0, 0.5
VOXEL, BAND = 0.06, 0.15


def turned(a):
    """World to camera of an eye on a circle that looks at the origin."""
    eye = np.array([2 * math.cos(a), 0.3, 2 * math.sin(a)])
    z = -eye / np.linalg.norm(eye)
    x = np.cross(z, (0.0, 1.0, 0.0))
    x /= np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    return r, -r @ eye


@pytest.fixture(scope="module")
def views(spark):
    pixels, rig = [], []
    for frame, radius in ((1, RADIUS), (2, 0.4)):
        for c in range(6):
            r, t = turned(c * math.pi / 3 + 0.1)
            rig.append((frame, c, FOCUS, FOCUS, SIZE / 2, SIZE / 2, r.tolist(), t.tolist(), SIZE, SIZE))
            eye = -r.T @ t
            for y in range(SIZE):
                for x in range(SIZE):
                    d = r.T @ np.array([(x - SIZE / 2) / FOCUS, (y - SIZE / 2) / FOCUS, 1.0])
                    b, k = d @ eye, eye @ eye - radius**2
                    root = b * b - d @ d * k
                    hit = float((-b - root**0.5) / (d @ d)) if root > 0 else None
                    pixels.append((frame, c, x, y, hit, 255 if (x + y) % 13 else 0, float(100 + c)))
    depth = spark.createDataFrame(pixels, "frame_id long, camera_index long, x long, y long, depth double, alpha int, color double").cache()
    return depth, spark.createDataFrame(rig, "frame_id long, camera_index long, fx double, fy double, cx double, cy double, rotation array<array<double>>, translation array<double>, width int, height int").cache()


@pytest.fixture(scope="module")
def folded(views):
    return Z.fold(*views, VOXEL, BAND, 0.5, 4.0, color="color").cache()


def test_bricks_hold_what_a_whole_volume_holds(spark, views, folded):
    depth, rig = views
    n = 24
    half = n // 2
    v = spark.range(2 * n**3).select((F.col("id") % 2 + 1).alias("frame_id"), F.expr("id div 2").alias("voxel_id"))
    v = v.select("frame_id", (F.col("voxel_id") * 2 + F.col("frame_id") - 1).alias("voxel_id"), *[((F.expr(f"voxel_id div {n**k} % {n}") - half + 0.5) * VOXEL).alias(f"w{c}") for k, c in enumerate("xyz")])
    key = lambda f, x, y, z: (f, *(round(w / VOXEL - 0.5) for w in (x, y, z)))
    usable = depth.where("depth IS NOT NULL")
    dense = {key(r.frame_id, r.wx, r.wy, r.wz): (r.tsdf, r.weight, r.color) for r in U.tsdf(v, usable, rig, BAND, color="color").join(v, "voxel_id").collect()}
    sparse = {(r.frame_id, r.vx, r.vy, r.vz): (r.sdf, r.weight, r.color) for r in folded.collect()}
    near = {k for k, d in dense.items() if abs(d[0]) < 1}
    assert near <= set(sparse)
    assert all(sparse[k] == pytest.approx(dense[k]) for k in set(sparse) & set(dense))
    inner = {k for k in sparse if all(-half <= c < half for c in k[1:])}
    assert inner <= set(dense) and len(near) > 500


def test_mesh_of_a_sphere(folded):
    vertices, faces = Z.mesh(folded, VOXEL)
    v = {(r.mesh_id, r.vid): r for r in vertices.collect()}
    f = faces.collect()
    assert len({(r.mesh_id, r.fid) for r in f}) == len(f) and {(r.mesh_id, i) for r in f for i in (r.i0, r.i1, r.i2)} == set(v)
    for mesh, radius in ((1, RADIUS), (2, 0.4)):
        far = np.array([math.dist((r.x, r.y, r.z), (0, 0, 0)) for k, r in v.items() if k[0] == mesh])
        assert len(far) > 150 and abs(np.median(far) - radius) < 0.03
        assert all(100 <= r.color <= 105 for k, r in v.items() if k[0] == mesh)
        edges = {}
        for r in f:
            if r.mesh_id == mesh:
                for a, b in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0)):
                    edges[a, b] = edges.get((a, b), 0) + 1
        assert max(edges.values()) == 1  # every face is turned like its neighbours
        inside = sum((b, a) in edges for a, b in edges)
        assert inside > 0.8 * len(edges)
    assert Z.mesh(folded.where("weight > 1000"), VOXEL)[1].count() == 0


def test_work_follows_the_surface(views):
    depth, rig = views
    bricks = Z.allocated(depth, rig, VOXEL / 2, BAND / 2, 0.5, 4.0)
    n = bricks.where("frame_id = 1").count()
    whole = (2 * (RADIUS + BAND) / (Z.SIDE * VOXEL / 2) + 1) ** 3
    assert 0 < n < whole
    seen = Z.in_view(bricks, rig, VOXEL / 2)
    assert seen.count() <= 6 * bricks.count()
    away = rig.withColumn("rotation", F.transform("rotation", lambda r: F.transform(r, lambda x: -x))).withColumn("translation", F.transform("translation", lambda x: -x))
    assert Z.in_view(bricks, away, VOXEL / 2).count() == 0
