"""voxelweave.plans"""
