"""Simplification and unwrapping: closed meshes stay closed, borders and limits hold, no two faces overlap in an atlas."""

import itertools
import math
import random

import numpy as np
import pytest


from voxelweave.operators import atlas as A
from voxelweave.operators import simplify as S
from voxelweave.operators.graph import connected


def tables(spark, meshes):
    """meshes: {mesh_id: (points, triangles)}."""
    v = [(m, i, *map(float, p)) for m, (ps, _) in meshes.items() for i, p in enumerate(ps)]
    f = [(m, i, *map(int, t)) for m, (_, ts) in meshes.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(v, "mesh_id long, vid long, x double, y double, z double"), spark.createDataFrame(f, "mesh_id long, fid long, i0 long, i1 long, i2 long")


def sphere(depth):
    t = (1 + 5**0.5) / 2
    points = [np.array(p) / math.hypot(*p) for p in ((-1, t, 0), (1, t, 0), (-1, -t, 0), (1, -t, 0), (0, -1, t), (0, 1, t), (0, -1, -t), (0, 1, -t), (t, 0, -1), (t, 0, 1), (-t, 0, -1), (-t, 0, 1))]
    faces = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    for _ in range(depth):
        known, out = {}, []

        def middle(a, b):
            key = (min(a, b), max(a, b))
            if key not in known:
                p = points[a] + points[b]
                known[key] = len(points)
                points.append(p / np.linalg.norm(p))
            return known[key]

        for a, b, c in faces:
            ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)
            out += [(a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca)]
        faces = out
    return points, faces


def grid(n, height):
    points = [(i, j, height(i, j)) for i in range(n) for j in range(n)]
    at = lambda i, j: i * n + j
    faces = [t for i in range(n - 1) for j in range(n - 1) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i, j + 1), at(i + 1, j), at(i + 1, j + 1)))]
    return points, faces


def by_mesh(v, f):
    place = {(r.mesh_id, r.vid): np.array((r.x, r.y, r.z)) for r in v.collect()}
    out = {}
    for r in f.collect():
        out.setdefault(r.mesh_id, []).append((r.i0, r.i1, r.i2))
    return place, out


def edge_counts(faces):
    n = {}
    for t in faces:
        for a, b in zip(t, (*t[1:], t[0]), strict=True):
            n[min(a, b), max(a, b)] = n.get((min(a, b), max(a, b)), 0) + 1
    return n


def test_closed_meshes_stay_closed_and_reach_the_target(spark):
    small = sphere(0)
    v, f = tables(spark, {1: sphere(2), 2: small})
    kept, out, metrics = S.simplify(v, f, target=240, least=60, target_error=0.5, share=1.0)
    place, faces = by_mesh(kept, out)
    assert sorted(faces[2]) == sorted(small[1])  # under the target
    assert 238 <= len(faces[1]) <= 240
    counts = edge_counts(faces[1])
    used = {i for t in faces[1] for i in t}
    assert set(counts.values()) == {2} and len(used) - len(counts) + len(faces[1]) == 2
    volume = sum(np.dot(place[1, a], np.cross(place[1, b], place[1, c])) for a, b, c in faces[1]) / 6
    assert volume > 0.9 * 4 / 3 * math.pi and all(np.dot(np.cross(place[1, b] - place[1, a], place[1, c] - place[1, a]), place[1, a]) > 0 for a, b, c in faces[1])
    assert {k for k in place if k[0] == 1} == {(1, i) for i in used}
    m = {r.mesh_id: r for r in metrics.collect()}
    assert (m[1].input_faces, m[1].input_vertices, m[1].output_faces, m[1].output_vertices) == (320, 162, len(faces[1]), len(used)) and 0 < m[1].result_error < 0.5
    assert (m[2].output_faces, m[2].result_error) == (20, 0.0)


def test_borders_flat_parts_and_the_error_limit(spark):
    rng = random.Random(3)
    bumps = {(i, j): rng.random() for i in range(6) for j in range(6)}
    v, f = tables(spark, {1: grid(6, lambda i, j: 0.0), 2: grid(6, lambda i, j: bumps[i, j])})
    kept, out, _ = S.simplify(v, f, target=4, least=2, target_error=0.001, share=1.0, rounds=5)
    place, faces = by_mesh(kept, out)
    area = lambda m: sum(np.linalg.norm(np.cross(place[m, b] - place[m, a], place[m, c] - place[m, a])) / 2 for a, b, c in faces[m])
    assert len(faces[1]) < 44 and abs(area(1) - 25) < 1e-9  # a flat square keeps its outline
    assert len(faces[2]) > 45  # nothing, or nearly so, within so small an error


def test_what_must_not_collapse(spark):
    tetra = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)])
    book = ([(0, 0, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0), (-1, 0, 0)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)])  # three faces at an edge
    v, f = tables(spark, {1: tetra, 2: book, 3: ([(0, 0, 0)] * 3, [(0, 1, 2)]), 4: grid(4, lambda i, j: 0.0)})
    _, out, metrics = S.simplify(v, f, target=1, least=1, target_error=10.0, lock_border=True, rounds=2)
    n = {r.mesh_id: r.output_faces for r in metrics.collect()}
    assert n[1] == 4 and n[3] == 1 and n[4] < 18
    held = [r for r in out.collect() if r.mesh_id == 4]
    assert {i for r in held for i in (r.i0, r.i1, r.i2)} >= {i for i in range(16) if i // 4 in (0, 3) or i % 4 in (0, 3)}
    assert all(r.i0 != r.i1 and r.i1 != r.i2 and r.i0 != r.i2 for r in out.collect())
    empty = S.simplify(v.limit(0), f.limit(0))
    assert empty[0].count() == empty[1].count() == empty[2].count() == 0


def test_a_round_takes_no_two_picks_that_touch(spark):
    v, f = tables(spark, {1: sphere(1), 2: grid(8, lambda i, j: math.sin(i) * math.cos(j))})
    good = S.picks(S.quadrics(v, f), f, 1.0)
    chosen = [tuple(r) for r in S.independent(good, f).select("mesh_id", "a", "b").collect()]
    ring = {}
    for r in f.collect():
        for i in (r.i0, r.i1, r.i2):
            ring.setdefault((r.mesh_id, i), set()).update((r.i0, r.i1, r.i2))
    assert len(chosen) > 4
    for (m, a, b), (o, c, d) in itertools.permutations(chosen, 2):
        assert m != o or not {c, d} & ring[m, a]


def test_need_is_filled_with_the_cheapest(spark):
    rng = random.Random(1)
    rows = [(m, i, i + 1, rng.random() if m else 0.0) for m in range(3) for i in range(500)]
    picks = spark.createDataFrame(rows, "mesh_id long, a long, b long, cost double")
    need = spark.createDataFrame([(0, 123), (1, 40), (2, 900)], "mesh_id long, collapses long")
    got = S.within_need(picks, need).collect()
    assert {m: sum(r.mesh_id == m for r in got) for m in range(3)} == {0: 123, 1: 40, 2: 500}
    assert max(r.cost for r in got if r.mesh_id == 1) <= sorted(c for m, _, _, c in rows if m == 1)[39] * 2 ** (1 / 16)


def test_components(spark):
    rng = random.Random(6)
    links = [(g, rng.randrange(300), rng.randrange(300)) for g in (1, 2) for _ in range(170)] + [(3, i, i + 1) for i in range(200)] + [(4, 0, i) for i in range(1, 100)]
    want = {}

    def root(k):
        while want.setdefault(k, k) != k:
            k = want[k]
        return k

    for g, a, b in links:
        x, y = sorted((root((g, a)), root((g, b))))
        want[y] = x
    got = {(r.g, r.node): r.root for r in connected(spark.createDataFrame(links, "g long, a long, b long"), "g").collect()}
    assert got == {k: root(k)[1] for k in want if root(k) != k}


def overlapping(triangles, slack):
    """Pairs of triangles of the plane that overlap by more than slack."""
    out = []
    t = np.array(triangles)
    lo, hi = t.min(1), t.max(1)
    for i in range(len(t)):
        for j in np.nonzero((lo[i] < hi[i + 1 :] - slack).all(1) & (lo[i + 1 :] < hi[i] - slack).all(1))[0] + i + 1:
            apart = False
            for one in (t[i], t[j]):
                for k in range(3):
                    d = one[(k + 1) % 3] - one[k]
                    n = np.array([d[1], -d[0]]) / max(np.hypot(*d), 1e-300)
                    p, q = t[i] @ n, t[j] @ n
                    apart |= p.max() <= q.min() + slack or q.max() <= p.min() + slack
            if not apart:
                out.append((i, j))
    return out


def helix(turns, steps=16):
    """A band that winds around the z axis and lies over itself."""
    points = [(r * math.cos(2 * math.pi * i / steps), r * math.sin(2 * math.pi * i / steps), 0.1 * i) for i in range(turns * steps + 1) for r in (1.0, 2.0)]
    faces = [t for i in range(turns * steps) for t in ((2 * i, 2 * i + 1, 2 * i + 2), (2 * i + 1, 2 * i + 3, 2 * i + 2))]
    return points, faces


@pytest.fixture(scope="module")
def unwrapped(spark):
    rng = random.Random(2)
    rough = {(i, j): 3 * rng.random() for i in range(8) for j in range(8)}
    meshes = {1: sphere(1), 2: helix(3), 3: grid(8, lambda i, j: rough[i, j]), 4: ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)]), 5: grid(3, lambda i, j: 0.0)}
    v, f = tables(spark, meshes)
    corners, metrics = A.unwrap(f, v, resolution=1024, gutter=4)
    return meshes, v, corners.cache(), metrics


def test_no_two_faces_overlap_in_an_atlas(unwrapped):
    meshes, _, corners, metrics = unwrapped
    rows = corners.collect()
    m = {r.mesh_id: r for r in metrics.collect()}
    for mesh, (points, faces) in meshes.items():
        own = sorted((r for r in rows if r.mesh_id == mesh), key=lambda r: (r.fid, r.corner))
        assert [(r.fid, r.vid) for r in own] == [(i, v) for i, t in enumerate(faces) for v in t]
        assert all(0 <= r.u <= 1 and 0 <= r.v <= 1 for r in own)
        uv = [[(own[3 * i + k].u, own[3 * i + k].v) for k in range(3)] for i in range(len(faces))]
        assert not overlapping(uv, 1e-7)
        chart = {r.fid: r.chart for r in own}
        assert len(set(chart.values())) == m[mesh].charts and all(c == min(i for i, d in chart.items() if d == c) for c in set(chart.values()))
        assert 0 < m[mesh].utilization <= 1 and m[mesh].gutter > 1
        boxes = {c: (np.array([uv[i] for i in chart if chart[i] == c]).reshape(-1, 2)) for c in set(chart.values())}
        for a, b in itertools.combinations(boxes.values(), 2):  # boxes stay a gutter apart
            assert np.max(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0))) >= 0.99 * m[mesh].gutter / 1024
        scale = {round(np.linalg.norm(np.subtract(*uv[i][:2])), 9) for i in range(len(faces))} if mesh == 5 else None
        assert scale is None or len(scale) <= 2  # flat squares keep their shape
    assert m[1].charts == 6 and m[4].charts == 1 and m[5].charts == 1
    assert 3 <= m[2].charts < 12  # a turn each, not a face each


def test_seams_split_vertices(unwrapped):
    meshes, v, corners, _ = unwrapped
    vertices, faces = A.split_seams(corners, v)
    at = {(r.mesh_id, r.vid): r for r in vertices.collect()}
    want = {(r.mesh_id, r.fid, r.corner): r for r in corners.collect()}
    got = faces.collect()
    assert len(got) * 3 == len(want)
    for r in got:
        for k, i in enumerate((r.i0, r.i1, r.i2)):
            w, own = want[r.mesh_id, r.fid, k], at[r.mesh_id, i]
            assert (own.u, own.v) == pytest.approx((w.u, w.v)) and (own.x, own.y, own.z) == tuple(map(float, meshes[r.mesh_id][0][w.vid]))
    assert len(at) == len({(r.mesh_id, r.vid, r.chart) for r in want.values()})


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)
    size = lambda: 10 ** rng.uniform(-2, 0.7)
    rows = []
    for i in range(150):
        x, y, s = rng.uniform(0, 8), rng.uniform(0, 8), size()
        rows.append((1, i % 2, i, *[c for _ in range(3) for c in (x + s * rng.random(), y + s * rng.random())]))
    schema = "mesh_id long, chart long, fid long, a_u double, a_v double, b_u double, b_v double, c_u double, c_v double"
    got = {r.fid for r in A.overlaps(spark.createDataFrame(rows, schema)).collect()}
    want = set()
    for chart in (0, 1):
        own = [r for r in rows if r[1] == chart]
        want |= {own[j][2] for _, j in overlapping([np.array(r[3:]).reshape(3, 2) for r in own], 1e-12)}
    assert got == want


def test_order_of_drawing_follows_places(spark):
    v, f = tables(spark, {1: grid(17, lambda i, j: 0.0), 2: ([(0, 0, 0)] * 3, [(0, 1, 2)])})
    place = [r.fid for r in S.drawn_in_order(f, v).where("mesh_id = 1").orderBy("place", "fid").collect()]
    middle = {r.fid: np.array((r.i0 // 17, r.i0 % 17)) for r in f.where("mesh_id = 1").collect()}
    jumps = lambda order: sum(abs(middle[a] - middle[b]).sum() for a, b in itertools.pairwise(order))
    assert sorted(place) == list(range(512)) and jumps(place) < jumps(sorted(middle, key=lambda i: (i * 37) % 512)) / 4
    assert S.drawn_in_order(f, v).where("mesh_id = 2").count() == 1
