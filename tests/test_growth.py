"""What must not grow faster than the input: plans and counts of rows, on small tables."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelweave.operators import fusion as U
from voxelweave.operators import graph
from voxelweave.operators import image as I
from voxelweave.operators import simplify as Q
from voxelweave.operators import spatial as S
from voxelweave.sources import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many_frames(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("many")
    for name in ("customer", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", at)
    spark.range(6000).selectExpr("id AS s_suppkey", "'n' AS s_name", "1 AS s_nationkey", "0.0D AS s_acctbal").write.parquet(f"{at}/supplier.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["degenerate_faces", "eval_summary", "mesh_validity", "masked_images", "mesh_pipeline", "planar_unwrap", "psnr_by_frame", "quality_gate", "ssim_by_frame", "surface_points"])
def test_repeated_frames_are_not_broadcast(spark, many_frames, name):
    """The driver collected what frames were repeated to."""
    joins = re.findall(r"BroadcastHashJoin \[(\w+)#", plan(entry.queries()[name](spark, many_frames)))
    assert set(joins) <= {"chart", "_part"}  # six charts, and the parts of an order


def test_match_makes_few_pairs(spark, monkeypatch):
    """pairs within the whole radius only for who has nothing near."""
    rnd = random.Random(3)
    rows = lambda n, first: [(first + i, *[rnd.gauss(0, 0.1) for _ in range(3)], [rnd.random() * 0.05 for _ in range(3)]) for i in range(n)]
    new, old = rows(300, 0), rows(300, 1000)
    old += [(5000 - i, *old[0][1:]) for i in range(200)]  # copies
    new += [(900, 0.9, 0.0, 0.0, [0.0] * 3), (901, 9.0, 0.0, 0.0, [0.0] * 3)]  # far from most, from all
    made, real = [], S.grid_join

    def counted(*a, **k):
        out = real(*a, **k)
        made.append(out.count())
        return out

    monkeypatch.setattr(S, "grid_join", counted)
    schema = "splat_id long, px double, py double, pz double, sh array<double>"
    got = {r[0]: r[1] for r in S.match(*(spark.createDataFrame(x, schema) for x in (new, old)), 0.8, 0.8, 0.1).collect()}

    def cost(n, o):
        d = sum((n[k] - o[k]) ** 2 for k in (1, 2, 3)) ** 0.5
        return (d + 0.1 * sum(abs(x - y) for x, y in zip(n[4], o[4], strict=True)) / 3, o[0]) if d < 0.8 else (9, None)

    best = [min(cost(n, o) for o in old) for n in new]
    assert got == {n[0]: b[1] if b[0] < 0.8 else None for n, b in zip(new, best, strict=True)}
    assert sum(made) < 40_000  # of 151,000


def test_reprojection_sorts_nothing(spark):
    """the most confident wins a pixel, then the nearest."""
    d = spark.createDataFrame([(1, 0, 0, 0, 2.0, 5), (1, 0, 0, 0, 1.5, 5), (1, 0, 0, 0, 1.0, 4), (1, 0, 0, 0, 0.5, 1)], "frame_id long, camera_index long, x long, y long, depth double, confidence long")
    out = U.reproject(d, (0.0, 0.0, 0.0), 30.0, 30.0, 0.0, 0.0, 32, 24, threshold=3)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 0, 1.5, 5)]
    assert "SortAggregate" not in plan(out)


def test_mean_over_frames_by_blocks(spark):
    """no array holds all frames of a pixel."""
    frames = [*range(-40, 300, 2), 7, 7]
    px = spark.createDataFrame([(f, x, 0, (f * 37 + x) % 11 / 10.0) for f in frames for x in (0, 1)], "frame_id long, x long, y long, v double")
    got = {r["x"]: r["v"] for r in I.ema_frames(px, "v", 0.4, block=16).collect()}
    for x in (0, 1):
        s = None
        for f in sorted(frames):
            v = (f * 37 + x) % 11 / 10.0
            s = v if s is None else s * 0.6 + v * 0.4
        assert got[x] == pytest.approx(s, abs=1e-12)


def test_small_groups_are_connected_without_joins(spark):
    """the components of small groups, each in one task."""
    rnd = random.Random(5)
    edges = [(g, a, rnd.randrange(40)) for g in range(30) for a in range(40) if rnd.random() < 0.5] + [(99, i, i + 1) for i in range(70)] + [(98, i, 500) for i in range(50)]
    links = spark.createDataFrame(edges, "g long, a long, b long")
    got = {tuple(r) for r in graph.connected(links, "g", together=True).collect()}
    assert got == {tuple(r) for r in graph.connected(links, "g").collect()}
    up = {}

    def root(n):
        while up.get(n, n) != n:
            n = up[n]
        return n

    for g, a, b in edges:
        x, y = sorted((root((g, a)), root((g, b))))
        up[y] = x
    nodes = {(g, n) for g, a, b in edges if a != b for n in (a, b)}
    assert got == {(g, n, root((g, n))[1]) for g, n in nodes if root((g, n)) != (g, n)}


def test_cells_are_made_of_pieces_of_columns(spark):
    """a voxel was dealt to each of its eight cells."""
    rnd = random.Random(7)
    full = [(x, y, z, rnd.random() - 0.5) for x in range(-2, 3) for y in range(-2, 3) for z in range(-11, 20) if rnd.random() < 0.9]
    grid = spark.createDataFrame([*full, *rnd.sample(full, 20), (50, 0, 0, -1.0), (60, 0, 0, None)], "vx long, vy long, vz long, sdf double")  # some twice
    key = ("vx", "vy", "vz", "mask")
    assert sorted(U.cases(grid).select(*key).collect()) == sorted(U.cubes(grid).select(*key).collect())
    assert U._pieces(grid).count() < 1.2 * grid.count()
    for name in ("cube_case_hist", "observed_cubes"):
        assert len(re.findall(r"Generate explode\(\[(?:\[[^\]]*\],?){8}\]", plan(entry.queries()[name](spark, "/root/testdata/sf0.001")))) == 0


def test_small_meshes_stay_in_their_tasks(spark, monkeypatch):
    """rows of small meshes were dealt out by mesh and vertex at each join."""
    v, f = (df.where("mesh_id < 12") for df in V.relief(spark, "/root/testdata/sf0.001"))
    plans, real = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda df, *a: (plans.append(plan(df)), real(df, *a))[1])
    got = sorted(Q.one_round(v, f, 0.05, together=True).collect())
    assert len(plans) == 4 and not [p for p in plans if re.search(r"hashpartitioning\(mesh_id#\d+L, [a-z_]", p)]
    assert spark.conf.get(Q.SUBSET) == "true"
    plans.clear()
    assert got == sorted(Q.one_round(v, f, 0.05).collect()) and len(got) > 0
    assert [p for p in plans if re.search(r"hashpartitioning\(mesh_id#\d+L, [a-z_]", p)]


@pytest.mark.parametrize("name", ["undistorted", "unproject", "color_correction"])
def test_frames_are_dealt_out(spark, many_frames, name):
    """one task made the pixels of all frames, as the few bytes that name them were read by it."""
    df = entry.queries()[name](spark, many_frames)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("frame_id").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 6000 / 4


def _cloud(spark, n, spread, frames=2, seed=5):
    rnd = random.Random(seed)
    rows = [(i, i % frames, rnd.randrange(4), *[rnd.gauss(0, spread) for _ in range(3)], rnd.randrange(8) / 8) for i in range(n)]
    return rows, spark.createDataFrame(rows, "splat_id long, frame_id long, worker_id long, px double, py double, pz double, opacity double")


def test_pairs_meet_in_blocks(spark, monkeypatch):
    """what is repeated for each cell was broadcast or moved; splats move by block, and crowded blocks are split."""
    for crowd, spread in ((1 << 14, 0.5), (20, 0.1), (20, 0.02)):
        monkeypatch.setattr(S, "CROWD", crowd)
        rows, s = _cloud(spark, 300, spread)
        near = lambda a, b: a[1] == b[1] and a[2] != b[2] and sum((x - y) ** 2 for x, y in zip(a[3:6], b[3:6], strict=True)) < 0.01
        pairs = sorted((a[0], b[0]) for a in rows for b in rows if near(a, b))
        assert sorted((r.a_splat_id, r.b_splat_id) for r in S.cross_worker_pairs(s, 0.1).collect()) == pairs
        by = {r[0]: r for r in rows}
        best = {a[0]: max([a] + [by[j] for i, j in pairs if i == a[0]], key=lambda r: (r[6], -r[0]))[0] for a in rows}
        assert {r.splat_id: r.winner_id for r in S.winners(s, 0.1).collect()} == best
    out = plan(S.winners(s, 0.1))
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", out)) <= {"_part", "frame_id", "rank"} and "ShuffledHashJoin [a_c" in out  # parts of an order, crowded blocks, ids
    assert "SortAggregate" not in out
    assert not re.search(r"Exchange [^\n]*c[xyz]#", out)  # cells do not move


@pytest.mark.parametrize("name", ["fused_by_angle", "tsdf_by_angle", "texel_best_view", "texel_blend_uniform", "texel_blend_weighted", "visible_points", "occluded_points", "planar_unwrap"])
def test_frames_stay_in_their_tasks(spark, many_frames, name):
    """Pixels, voxels and vertices of a frame were dealt anew at each join."""
    moved = [re.sub(r"#\d+L?|, \d+$", "", x) for x in re.findall(r"- Exchange \w+\(([^)]*)\)", plan(entry.queries()[name](spark, many_frames)))]
    assert moved and set(moved) <= {"frame_id", "chart"}  # six charts
    assert V.eyes(spark, many_frames).rdd.getNumPartitions() >= 6000 / V.TOGETHER and spark.conf.get(Q.SUBSET) == "true"
