"""Geometry, fusion, mesh, camera and image operators on tiny tables."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.functions import color as C
from voxelweave.functions import geometry as G
from voxelweave.functions import quantize as Q
from voxelweave.operators import camera as K
from voxelweave.operators import fusion as U
from voxelweave.operators import image as I  # noqa: E741
from voxelweave.operators import mesh as M
from voxelweave.operators import spatial as S
from voxelweave.sources import views as V


SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_vector_algebra(spark):
    a, b = lit(1, 2, 3), lit(4, 5, 6)
    r = one(spark, *G.add(a, b), *G.sub(b, a), G.dot(a, b), *G.cross(a, b), G.length(lit(3, 4, 0)), *G.normalize(lit(0, 0, 0)), *G.normalize(lit(0, 2, 0)), G.angular_distance(lit(1, 0, 0), lit(0, 1, 0)))
    assert list(r) == pytest.approx([5, 7, 9, 3, 3, 3, 32, -3, 6, -3, 5, 0, 0, 0, 0, 1, 0, math.pi / 2])


def test_projection_round_trip(spark):
    p = lit(0.3, -0.2, 2.0)
    u, v = G.project(p, 100.0, 100.0, 32.0, 24.0)
    r = one(spark, *G.unproject(u, v, p[2], 100.0, 100.0, 32.0, 24.0), G.project(lit(0, 0, -1), 1.0, 1.0, 0.0, 0.0)[0])
    assert list(r)[:3] == pytest.approx([0.3, -0.2, 2.0]) and r[3] is None


def test_rodrigues_and_rigid_inverse(spark):
    m = G.rodrigues(lit(0, 0, math.pi / 2))
    r = one(spark, *G.transform([[*row, F.lit(0.0)] for row in m], lit(1, 0, 0)))
    assert list(r) == pytest.approx([0, 1, 0], abs=1e-12)
    full = [[*row, F.lit(float(t))] for row, t in zip(m, (1, 2, 3), strict=True)]
    back = one(spark, *G.transform(G.rigid_inverse(full), G.transform(full, lit(5, 6, 7))))
    assert list(back) == pytest.approx([5, 6, 7])


def test_ray_triangle_and_barycentric(spark):
    a, b, c = lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0)
    r = one(spark, G.ray_triangle(lit(0.2, 0.2, 1), lit(0, 0, -1), a, b, c), G.ray_triangle(lit(2, 2, 1), lit(0, 0, -1), a, b, c), G.ray_triangle(lit(0.2, 0.2, 1), lit(1, 0, 0), a, b, c), *G.barycentric(lit(0.25, 0.25), lit(0, 0), lit(1, 0), lit(0, 1)), *G.barycentric(lit(0, 0), lit(0, 0), lit(1, 1), lit(2, 2)))
    assert list(r) == pytest.approx([1, -1, -1, 0.5, 0.25, 0.25, -1, -1, -1])


def test_color_and_quantisation(spark):
    r = one(spark, C.linear_to_srgb8(F.lit(0.0)), C.linear_to_srgb8(F.lit(1.0)), C.sh_dc_color(F.lit(0.0)), C.psnr(F.lit(0.0)), C.falloff(F.lit(9.0), F.lit(1.0)), Q.to_u16(F.lit(0.5), F.lit(0.0), F.lit(1.0)), Q.to_u16(F.lit(0.5), F.lit(1.0), F.lit(1.0)), Q.spz(F.lit(0.5), F.lit(1.0), F.lit(1.0), 255), Q.quat_i8(F.lit(-0.999)), Q.from_log_scale_u16(Q.log_scale_u16(F.lit(0.02))))
    assert list(r)[:4] == pytest.approx([0, 255, 0.5, 100.0]) and r[4] is None
    assert list(r)[5:9] == [32768, 32768, 0, -126] and r[9] == pytest.approx(0.02, rel=1e-3)


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(i % 2), int(i % 3), *map(float, rng.random(3)), float(rng.integers(1, 4)) / 4) for i in range(160)]
    s = spark.createDataFrame(rows, "splat_id long, frame_id long, worker_id long, px double, py double, pz double, opacity double")
    got = {(r.a_splat_id, r.b_splat_id) for r in S.cross_worker_pairs(s, 0.2).collect()}
    near = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[3:6], b[3:6], strict=True)) < 0.04
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and near(a, b)}
    assert got == pairs
    best = {a[0]: max([a] + [b for b in rows if (a[0], b[0]) in pairs], key=lambda r: (r[6], -r[0]))[0] for a in rows}
    assert {r.splat_id: r.winner_id for r in S.winners(s, 0.2).collect()} == best
    merged = {r.splat_id: (r.px, r.merged) for r in S.merge(s, 0.2).collect()}
    by = {r[0]: r for r in rows}
    for k in merged:
        mine = [by[i] for i, w in best.items() if w == k]
        assert best[k] == k and merged[k][1] == len(mine)
        assert merged[k][0] == pytest.approx(sum(r[6] * r[3] for r in mine) / sum(r[6] for r in mine))
    assert S.merge(s.limit(0), 0.2).count() == 0


def test_merged_splats_keep_rotation_and_colour_bands_of_the_survivor(spark):
    rows = [(0, 1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.2, [1.0, 1.0, 1.0, 7.0, 8.0]), (0, 2, 1, 0.05, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.6, [3.0, 3.0, 3.0, 4.0, 5.0])]
    splats = spark.createDataFrame(rows, "frame_id int, splat_id int, worker_id int, px double, py double, pz double, sx double, sy double, sz double, qw double, qx double, qy double, qz double, opacity double, sh array<double>")
    (r,) = S.merge(splats, 0.2).collect()
    assert (r.splat_id, r.merged, r.qw, r.qx, r.qy, r.qz) == (2, 2, 0.0, 1.0, 0.0, 0.0)
    assert list(r.sh) == pytest.approx([2.5, 2.5, 2.5, 4.0, 5.0]) and r.sh0 == pytest.approx(2.5)


def test_marching_cubes_sphere_is_closed(spark):
    n, radius = 12, 0.35
    tris = U.marching_cubes(V.sdf_grid(spark, SF, n).where(f"vx < {n}")).collect()
    point = lambda t, k: tuple(round(t[f"p{k}{v}"], 6) for v in "xyz")
    faces = [(point(t, 0), point(t, 1), point(t, 2)) for t in tris]
    edges = collections.Counter(e for a, b, c in faces for e in ((a, b), (b, c), (c, a)))
    assert all(edges[(b, a)] == k for (a, b), k in edges.items())
    vertices = {p for f in faces for p in f}
    assert len(vertices) - len(edges) // 2 + len(faces) == 2
    area = sum(np.linalg.norm(np.cross(np.subtract(b, a), np.subtract(c, a))) / 2 for a, b, c in faces) / n**2
    assert area == pytest.approx(4 * math.pi * radius**2, rel=0.06)
    assert len(U.case_table()) == 256 and U.case_table()[0][1] == [] == U.case_table()[255][1]


def test_volume_dims():
    assert U.volume_dims((0, 0, 0), (2.5, 2.5, 0.0), 0.004) == (625, 625, 1)


def cube(spark):
    v = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    f = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, i0 long, i1 long, i2 long")


def test_cube_cleaning_and_normals(spark):
    v, f = cube(spark)
    bad = f.unionByName(spark.createDataFrame([(12, 0, 0, 1)], f.schema))
    assert M.clean(bad, v).count() == 12
    assert M.validity(f, v).first().valid and not M.validity(f, v.where("vid < 7")).first().valid and not M.validity(f.limit(0), v).first().valid
    for r in M.vertex_normals(f, v).collect():
        n, p = (r.nx, r.ny, r.nz), [(r.vid >> k & 1) - 0.5 for k in range(3)]
        assert math.hypot(*n) == pytest.approx(1) and sum(a * b for a, b in zip(n, p, strict=True)) > 0
    assert [r.vid for r in M.compaction(f).orderBy("new_id").collect()][:4] == [0, 2, 1, 3]
    nv, nf = M.cluster(v, f, 10.0)
    assert nv.count() == 1 and nf.count() == 0


def test_occlusion(spark):
    v = spark.createDataFrame([(0, -5.0, -5.0, 0.0), (1, 5.0, -5.0, 0.0), (2, 0.0, 5.0, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, i0 long, i1 long, i2 long")
    p = spark.createDataFrame([(7, 10, 0.0, 0.0, -1.0), (7, 11, 0.0, 0.0, 1.0), (7, 12, 9.0, 9.0, -1.0), (7, 0, -5.0, -5.0, 0.0)], "frame_id long, vid long, x double, y double, z double")
    eye = spark.createDataFrame([(7, 0.0, 0.0, 5.0)], "frame_id long, ex double, ey double, ez double")
    assert {r.vid for r in M.occluded(p, f, v, eye).collect()} == {10}
    rng = np.random.default_rng(3)
    pts = [(7, 100 + i, *map(float, rng.uniform(-12, 12, 2)), -1.0) for i in range(200)]
    slanted = spark.createDataFrame([(7, 7.5, -9.0, 5.0)], eye.schema)
    got = {r.vid for r in M.occluded(spark.createDataFrame(pts, p.schema), f, v, slanted).collect()}

    def hidden(o):
        a, b, c = (np.array(x, float) for x in ((-5, -5, 0), (5, -5, 0), (0, 5, 0)))
        d = np.array((7.5, -9.0, 5.0)) - o
        q = o + d * (-o[2] / d[2])
        side = [np.cross(y - x, q - x)[2] for x, y in ((a, b), (b, c), (c, a))]
        return min(side) > 0

    assert got == {i for _, i, *o in pts if hidden(np.array(o))} and 0 < len(got) < 200


def test_camera_rigs(spark):
    ring = [(g, k, 3 * math.cos(k * math.pi / 4), 0.0, 3 * math.sin(k * math.pi / 4)) for g in (0, 1) for k in range(8)]
    ring = spark.createDataFrame(ring, "rig long, camera_index long, x double, y double, z double")
    picked = K.select_spread(ring, 4, (3.0, 0.0, 0.0)).orderBy("rig", "nth").collect()
    assert [(r.rig, r.camera_index) for r in picked] == [(g, k) for g in (0, 1) for k in (0, 4, 2, 6)]
    some = ring.withColumn("valid", F.col("camera_index").isin(1, 2))
    assert {r.camera_index for r in K.select_spread(some, 4).collect()} == {1, 2}
    assert {(r.cameras, r.valid) for r in K.valid_counts(some).collect()} == {(8, 2)}
    assert K.select_spread(ring, 0).count() == 0 and K.select_spread(ring.limit(0), 3).count() == 0
    w = [r.weight for r in K.isolation_weights(ring.where("camera_index % 2 = 0")).collect()]
    assert sum(w) == pytest.approx(2) and all(x == pytest.approx(0.25) for x in w)
    near = {(r.target, r.nth): r.source for r in K.source_views(ring.where("rig = 0"), 2).collect()}
    assert near[0, 0] == 1 and near[0, 1] == 5 and near[4, 0] == 3  # the nearest, then the farthest from it
    few = [(r.target, r.source) for r in K.source_views(ring.where("rig = 0 AND camera_index < 3"), 2).orderBy("target", "nth").collect()]
    assert few == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    frames = ring.select("rig", "camera_index").crossJoin(spark.range(2).withColumnRenamed("id", "frame_id")).where("NOT (frame_id = 1 AND camera_index = 1)")
    got = {(r.rig, r.frame_id, r.target): list(r.sources) for r in K.training_samples(frames, K.source_views(ring, 2), every=4).collect()}
    assert got[0, 0, 0] == [1, 5] and got[0, 1, 0] == [5] and set(k[2] for k in got if k[1] == 0) == {0, 4}
    split = K.split(spark.range(100).withColumnRenamed("id", "k"), "k", 0.8, 42)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 80, "val": 20}
    assert K.split(spark.range(1).withColumnRenamed("id", "k"), "k", 0.1, 1).first().split == "train"


def test_numbers_and_sums_over_ranges(spark):
    from voxelweave.operators.sync import numbered

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    got = {r.k: r.n for r in numbered(rows, "k", "n").collect()}
    assert got == {k: k for k in range(1000)}
    value = {r.k: r.v for r in rows.collect()}
    sums = {r.k: r.s for r in M.prefix_sum(rows, "k", "v", "s").collect()}
    assert sums == {k: sum(value[i] for i in range(k)) for k in range(1000)}


def test_view_matrices_and_boxes(spark):
    m = np.array(G.look_at((0, 0, 5), (0, 0, 0)))
    assert (m @ [0, 0, 0, 1])[:3] == pytest.approx([0, 0, -5]) and (m @ [1, 0, 5, 1])[:3] == pytest.approx([1, 0, 0])
    p = np.array(G.perspective(math.pi / 2, 1.0, 0.1, 100.0))
    near, far = p @ [0, 0, -0.1, 1], p @ [0, 0, -100, 1]
    assert near[2] / near[3] == pytest.approx(-1) and far[2] / far[3] == pytest.approx(1)
    assert G.orbit((1, 2, 3), 2.0, 0.0, 0.0) == pytest.approx((1, 2, 5))
    low, high = lit(-1, -1, -1), lit(1, 1, 1)
    r = one(spark, G.ray_box(lit(0, 0, 5), lit(0, 0, -1), low, high), G.ray_box(lit(0, 0, 5), lit(0, 0, 1), low, high), G.ray_box(lit(2, 0, 5), lit(0, 0, -1), low, high), G.ray_box(lit(0, 0, 0), lit(1, 1, 0), low, high))
    assert list(r) == [True, False, False, True]
    turn, shift = F.array(*[F.array(*map(F.lit, row)) for row in ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))]), F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    assert list(one(spark, *G.camera_position(turn, shift))) == pytest.approx([-2, 1, -3])


def test_mesh_pipeline_and_flat_arrays(spark):
    v, f = cube(spark)
    bad = f.unionByName(spark.createDataFrame([(12, 0, 0, 1)], f.schema))
    loose = v.unionByName(spark.createDataFrame([(99, 9.0, 9.0, 9.0)], v.schema))
    vertices, faces, metrics = M.pipeline(bad, loose)
    assert (vertices.count(), faces.count()) == (8, 12)
    rows = {r.stage: r for r in metrics.collect()}
    assert (rows["input"].faces, rows["clean"].faces, rows["output"].vertices) == (13, 12, 8) and rows["output"].valid and rows["output"].kept == pytest.approx(12 / 13)
    assert all(abs(r.nx) + abs(r.ny) + abs(r.nz) > 0 for r in vertices.collect())
    flat = M.to_flat(f.withColumn("mesh_id", F.lit(5)), v.withColumn("mesh_id", F.lit(5)))
    back_v, back_f = M.from_flat(flat)
    assert sorted(tuple(r)[1:] for r in back_v.collect()) == sorted(map(tuple, v.collect()))
    assert sorted(tuple(r)[1:] for r in back_f.collect()) == sorted(map(tuple, f.collect()))
    assert M.from_flat(spark.createDataFrame([(1, [1.0], [2])], "mesh_id long, positions array<double>, indices array<long>"))[0].count() == 0
    uv = M.unwrap(f, v).collect()
    assert {r.chart for r in uv} == set(range(6)) and all(0 <= r.u <= 1 and 0 <= r.v <= 1 for r in uv)


def test_legacy_rigs(spark, tmp_path):
    import json

    from voxelweave.functions import lens as L

    (tmp_path / "a.json").write_text(json.dumps({"focal": 900, "image_width": 640, "image_height": 480, "win_translate": [2, -3], "k1_deg2": 0.1, "k3_deg6": 0.3, "rotate": [0, 0, math.pi / 2], "translate": [1, 2, 3], "serial_number": 77, "colTrans_mat": [1, 0, 0, 0, 1, 0, 0, 0, 1]}))
    (tmp_path / "b.json").write_text(json.dumps({"x_focallen": 800, "cx": 300, "cy": 200, "radial_poly": [0, 0.5, 0.25, 0.125], "extrinsics": {"mtx": [1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6, 0, 0, 0, 1]}}))
    a, b = L.legacy_rig(spark, str(tmp_path)).orderBy("camera_index").collect()
    assert (a.kind, a.serial, a.fx, a.fy, a.cx, a.cy) == ("recorder", 77, 900, 900, 322, 237) and list(a.dist_coeffs) == [0.1, 0, 0, 0, 0.3] and list(a.translation) == [1, 2, 3]
    assert np.allclose(a.rotation, [[0, -1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-12) and a.color_correction[1] == [0, 1, 0]
    assert (b.kind, b.serial, b.width, b.height, b.fy, b.cx) == ("solver", 1, 1920, 1080, 800, 300) and list(b.dist_coeffs) == [0.5, 0.25, 0, 0, 0.125] and list(b.translation) == [4, 5, 6] and b.color_correction is None


def test_flow_and_masks(spark):
    value = lambda x, y: ((x * 31 + y * 17 + x * y) % 101) / 100.0
    rows = [(f, x, y, value(x - f, y)) for f in (0, 1) for x in range(16) for y in range(16)]
    img = spark.createDataFrame(rows, "frame_id long, x long, y long, v double")
    got = {(r.bx, r.by): (r.dx, r.dy) for r in I.flow(img).collect()}
    assert got == {(i, j): (1, 0) for i in (0, 1) for j in (0, 1)}
    px = img.select("frame_id", F.lit(0).alias("camera_index"), "x", "y", "v")
    half = px.select("frame_id", "camera_index", "x", "y", F.lit(0.5).alias("mask")).where("x < 8")
    assert I.masked(px, half, "v").agg(F.sum("v")).first()[0] == pytest.approx(px.agg(F.sum(F.when(F.col("x") < 8, F.col("v") / 2).otherwise(F.col("v")))).first()[0])


def test_gutters_are_filled_in_each_frame(spark):
    rows = [(f, x, y, None if x == 1 else float(10 * f + y)) for f in range(4) for x in range(3) for y in range(3)]
    atlas = spark.createDataFrame(rows, "frame_id int, x int, y int, v double")
    got = {(r.frame_id, r.x, r.y): r.v for r in I.fill_gutter(atlas).collect()}
    mean = lambda f, y: sum(10 * f + k for k in (y - 1, y, y + 1) if 0 <= k < 3) / sum(0 <= k < 3 for k in (y - 1, y, y + 1))
    assert got == {(f, x, y): pytest.approx(mean(f, y) if x == 1 else v) for f, x, y, v in rows}
    assert I.fill_gutter(atlas.where("frame_id = 0").drop("frame_id")).columns == ["x", "y", "v"]


def test_image_filters(spark):
    img = V.pixels(spark, SF, 12, 9).where("frame_id < 2")
    same = {r.frame_id: r.psnr for r in I.psnr_by_frame(img, img).collect()}
    assert set(same.values()) == {100.0}
    assert all(r.ssim == pytest.approx(1) for r in I.ssim_by_frame(img, img).collect())
    mask = img.select("frame_id", "x", "y", F.lit(255).alias("alpha"))
    assert I.erode(mask, "alpha").where("alpha = 255").count() == 2 * 10 * 7 and I.opening(mask, "alpha").where("alpha = 0").count() == 0
    out = I.resize(img, 12, 9, 12, 9).join(img.withColumnRenamed("x", "tx").withColumnRenamed("y", "ty").withColumnRenamed("v", "w"), ["frame_id", "tx", "ty"])
    assert out.where("abs(v - w) > 1e-12").count() == 0


def test_views_look_as_large_as_they_are(spark):
    """What frames are repeated by must not look as small as the frames: the planner would broadcast it through the driver."""
    for df in (V.pixels(spark, SF), V.depth(spark, SF), V.voxels(spark, SF), V.sdf_grid(spark, SF), *V.height_field(spark, SF)):
        assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 8 * df.count()


def test_square_filters_of_a_sparse_image(spark):
    px = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 1, 3), (1, 4, 0, 9), (2, 0, 1, 5)], "frame_id long, x long, y long, alpha int")
    assert {(r.frame_id, r.x, r.y): r.alpha for r in I.dilate(px, "alpha").collect()} == {(1, 0, 0): 7, (1, 1, 1): 7, (1, 4, 0): 9, (2, 0, 1): 5}
    assert {r.alpha for r in I.erode(px, "alpha").collect()} == {0}


def test_radius_join_repeats_only_cells_in_reach(spark):
    px = spark.createDataFrame([(i, (i * 37 % 101) / 50 - 1, (i * 53 % 97) / 50 - 1, (i * 71 % 89) / 50 - 1) for i in range(400)], "splat_id long, px double, py double, pz double").withColumn("frame_id", F.lit(1))
    wide = S.around(S.with_cells(px, 0.3), 0.3).count()
    assert 400 * 18 < wide < 400 * 24  # not all 27
    brute = px.alias("a").crossJoin(px.alias("b")).where("pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) < 0.09").count()
    assert S.grid_join(px, px, 0.3).count() == brute
    middle = spark.createDataFrame([(0.15, 0.15, 0.15)], "px double, py double, pz double")
    assert S.around(S.with_cells(middle, 0.3), 0.3).count() == 27  # the far corner is 0.26 away


def test_resize_does_not_broadcast_its_targets(spark):
    """The distinct frames are few once they are counted; what is made of them is not, and must not go through the driver."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        df = I.resize(V.pixels(spark, SF), 48, 32, 24, 16)
        assert len(df.collect()) == 10 * 24 * 16
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _join_conditions(df):
    return "\n".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_what_cameras_see_is_worked_out_once(spark):
    """Filters on where a point is seen must not write its rotation out in the join's condition."""
    points = U.unproject(V.depth(spark, SF), V.depth_rig(spark, SF), 1.52, 1.58)
    assert "r_rotation" not in _join_conditions(U.seen_in(points, V.depth_rig(spark, SF)))


def test_texel_views_are_worked_out_once(spark):
    t = spark.createDataFrame([(0, 0, 0, 0, 0.2, 0.3, 0.5)], "frame_id long, fid long, tx int, ty int, w0 double, w1 double, w2 double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, i0 long, i1 long, i2 long")
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    c = spark.createDataFrame([(0, 0, 0.3, 0.5, 2.0), (0, 1, 0.3, 0.5, -2.0)], "frame_id long, camera_index long, x double, y double, z double")
    out = M.texel_views(t, f, v, c)
    assert [(r.camera_index, round(r.distance, 6), round(r.n_dot_c, 6)) for r in out.collect()] == [(0, 2.0, 1.0)]
    assert "SQRT" not in _join_conditions(out).upper()


def test_compaction_neither_sorts_corners_nor_deals_ranges_again(spark):
    _, f = V.height_field(spark, SF)
    out = M.compaction(f)
    assert sorted(r.new_id for r in out.collect()) == list(range(10 * 576))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "row_number" not in plan


def test_marching_cubes_look_edges_up(spark):
    """The ends of an edge come from the table of cases; a condition for each edge made the generated code too large to be compiled."""
    out = U.marching_cubes(V.sdf_grid(spark, SF))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 30
