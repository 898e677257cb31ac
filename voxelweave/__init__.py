"""voxelweave: volumetric-capture analytics on DataFrames, SQL and Structured Streaming."""
