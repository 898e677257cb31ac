"""Inference hooks: a backend turns the images of a frame into splats. The default is a deterministic stand-in without a model."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLATS = "frame_id long, pair long, splat_id long, px double, py double, pz double, opacity double"


class Backend(ABC):
    """Loaded once on a worker, then called for each stereo pair of a frame."""

    @abstractmethod
    def initialize(self) -> None: ...

    @abstractmethod
    def process(self, frame_id: int, pair: int, images: list[str]) -> pd.DataFrame: ...

    def shutdown(self) -> None:  # noqa: B027
        pass


class Cylinder(Backend):
    """So many splats on a cylinder for each pair."""

    def __init__(self, splats: int = 100):
        self.splats = splats

    def initialize(self) -> None:
        pass

    def process(self, frame_id: int, pair: int, images: list[str]) -> pd.DataFrame:
        import numpy as np

        i = np.arange(self.splats)
        a = 2 * np.pi * i / self.splats
        return pd.DataFrame({"frame_id": frame_id, "pair": pair, "splat_id": pair * self.splats + i, "px": 0.3 * np.cos(a), "py": (i % 10) / 10, "pz": 0.3 * np.sin(a), "opacity": 0.5 + (i % 5) / 10})


_READY: dict = {}


def _ready(backend: Backend) -> Backend:
    """The backend of this worker, initialised when it is first asked for and kept for the frames that follow."""
    key = (type(backend).__module__, type(backend).__qualname__, repr(sorted(vars(backend).items())))
    if key not in _READY:
        backend.initialize()
        _READY[key] = backend
    return _READY[key]


def infer(frames: DataFrame, backend: Backend) -> DataFrame:
    """Splats of frames (camera_index, frame_id, path): cameras in order are paired, frames with fewer than two give none."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("camera_index")
        own = _ready(backend)
        out = [own.process(int(p["frame_id"].iloc[0]), k // 2, p["path"].iloc[k : k + 2].to_list()) for k in range(0, len(p) - 1, 2)]
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split(" ")[0] for c in SPLATS.split(", ")])

    return frames.select("camera_index", F.col("frame_id").cast("long").alias("frame_id"), "path").groupBy("frame_id").applyInPandas(run, SPLATS)
