"""voxelweave.streaming"""
