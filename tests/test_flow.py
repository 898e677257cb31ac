"""Dense flow: known shifts of smooth and rough textures, sequences, images of several sizes, missing pixels."""

import numpy as np
import pytest

from voxelweave.operators import flow as W


def texture(rng, h, w, dx=0.0, dy=0.0, waves=14, top=0.9):
    """A sum of waves, moved by dx and dy."""
    y, x = np.meshgrid(np.arange(h) - dy, np.arange(w) - dx, indexing="ij")
    rng = np.random.default_rng(rng)
    out = np.zeros((h, w))
    for _ in range(waves):
        kx, ky, p = rng.uniform(-top, top), rng.uniform(-top, top), rng.uniform(0, 6.3)
        out += np.cos(kx * x + ky * y + p)
    return 0.5 + out / (2.5 * waves**0.5) / 2


@pytest.mark.parametrize(("dx", "dy", "top"), [(0.0, 0.0, 0.9), (0.64, 0.48, 0.9), (-1.3, 0.4, 0.9), (3.0, -2.0, 0.6), (5.5, 4.0, 0.3)])
def test_known_shifts(dx, dy, top):
    a = np.stack([texture(k, 96, 128, top=top) for k in range(3)]) * 255
    b = np.stack([texture(k, 96, 128, dx, dy, top=top) for k in range(3)]) * 255
    d = W.displacements(a, b)[:, :, 16:-16, 16:-16]
    assert abs(d[0] - dx).mean() < 0.1 and abs(d[1] - dy).mean() < 0.1


def test_flow_by_pair_equals_one_at_a_time():
    a, b = np.stack([texture(k, 40, 56) for k in range(4)]) * 255, np.stack([texture(k, 40, 56, 0.5 * k) for k in range(4)]) * 255
    whole = W.displacements(a, b)
    for k in range(4):
        assert np.allclose(whole[:, k], W.displacements(a[k : k + 1], b[k : k + 1])[:, 0])
    assert W.displacements(np.zeros((1, 1, 1)), np.zeros((1, 1, 1))).tolist() == [[[[0.0]]], [[[0.0]]]]


def test_sequences(spark):
    rows = []
    for k in range(4):  # sequence 1 moves by 0.8 a frame, the frame numbers have gaps
        rows.append((1, 10 * k, 64, 48, texture(5, 48, 64, 0.64 * k, 0.48 * k).reshape(-1).tolist()))
    rows += [(2, k, 40, 36, texture(6, 36, 40).reshape(-1).tolist()) for k in range(3)] + [(3, 0, 8, 8, [0.5] * 64)]
    rows += [(4, 0, 8, 8, [0.5] * 64), (4, 1, 4, 4, [0.5] * 16)]
    images = spark.createDataFrame(rows, "sequence long, frame_id long, width int, height int, grey array<float>").repartition(3)
    got = {(r.sequence, r.frame_id): r.mean_flow for r in W.frame_flow(images).collect()}
    assert set(got) == {(1, 10), (1, 20), (1, 30), (2, 1), (2, 2)}
    assert all(abs(got[1, k] - 0.8) < 0.05 for k in (10, 20, 30)) and got[2, 1] < 1e-6
    s = {r.sequence: r for r in W.steadiness(images).collect()}
    moves = [got[1, k] for k in (10, 20, 30)]
    assert s[1].mean_flow_magnitude == pytest.approx(np.mean(moves)) and s[1].max_flow_magnitude == pytest.approx(max(moves)) and s[1].std_flow_magnitude == pytest.approx(np.std(moves))
    assert s[3].mean_flow_magnitude == s[4].max_flow_magnitude == 0.0
    field = W.frame_flow(images.where("sequence = 1"), field=True).where("frame_id = 10").first()
    assert len(field.dx) == 64 * 48 and abs(np.mean(np.reshape(field.dx, (48, 64))[10:-10, 10:-10]) - 0.64) < 0.05
    assert W.frame_flow(images.limit(0)).count() == 0


def test_images_of_pixels(spark):
    px = [(1, 2, x, y, (x + 4 * y) / 10) for x in range(4) for y in range(2)] + [(1, 3, 1, 1, 0.5), (1, 3, 0, 0, None)]
    got = {r.frame_id: r for r in W.images_of(spark.createDataFrame(px, "sequence long, frame_id long, x long, y int, v double").repartition(2)).collect()}
    assert (got[2].width, got[2].height) == (4, 2) and got[2].grey == pytest.approx([i / 10 for i in range(8)])
    assert (got[3].width, got[3].height) == (2, 2) and got[3].grey == [0.0, 0.0, 0.0, 0.5]


def test_a_batch_takes_little_memory():
    """Four Python processes share an executor; what one works on at once must stay small however many images come."""
    import tracemalloc

    images = np.random.default_rng(0).random((max(1, W.PIXELS // (48 * 48)), 48, 48)) * 255
    tracemalloc.start()
    W.displacements(images, np.roll(images, 1, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
