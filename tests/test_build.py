"""Depth maps of two spheres to mesh files."""

import os

import numpy as np

from test_volume import BAND, VOXEL, views  # noqa: F401  a fixture
from voxelweave.functions import binary as B
from voxelweave.operators import build


def test_depth_maps_become_files(spark, views, tmp_path):  # noqa: F811
    depth, rig = views
    out = str(tmp_path / "meshes")
    report = {r.mesh_id: r for r in build.depth_to_files(depth, rig, out, 2 * VOXEL, 2 * BAND, 0.5, 4.0, color="color", target=300, least=10, target_error=0.1, resolution=512, rounds=2).collect()}
    assert sorted(os.listdir(out)) == ["mesh_000001.glb", "mesh_000002.glb"] and set(report) == {1, 2}
    for mesh, radius in ((1, 0.5), (2, 0.4)):
        document, data = B.parse_glb(open(f"{out}/mesh_00000{mesh}.glb", "rb").read())
        own = document["meshes"][0]["primitives"][0]

        def values(at, kind, width):
            a = document["accessors"][at]
            view = document["bufferViews"][a["bufferView"]]
            return np.frombuffer(data, kind, a["count"] * width, view["byteOffset"]).reshape(-1, width)

        p, n, uv, i = values(own["attributes"]["POSITION"], "<f4", 3), values(own["attributes"]["NORMAL"], "<f4", 3), values(own["attributes"]["TEXCOORD_0"], "<f4", 2), values(own["indices"], "<u4", 1).reshape(-1, 3)
        assert len(i) == report[mesh].output_faces and i.max() == len(p) - 1 and len(p) >= report[mesh].output_vertices
        assert abs(np.median(np.linalg.norm(p, axis=1)) - radius) < 0.06 and (0 <= uv).all() and (uv <= 1).all()
        assert np.allclose(np.linalg.norm(n, axis=1), 1, atol=1e-5)
        assert 0 < report[mesh].utilization < 1 and report[mesh].charts >= 6
        assert (values(own["attributes"]["COLOR_0"], "u1", 4)[:, 0] >= 100).all()
