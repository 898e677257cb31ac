"""Registered queries, by area."""

from voxelweave.plans import codec_queries, image_queries, mesh_queries, misc_queries, scene_queries, source_queries, splat_queries, stream_queries, volume_queries  # noqa: F401
