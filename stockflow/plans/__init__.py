"""Whole jobs: cubes and gated publication."""
