"""Operators on DataFrames of cells, blocks, tiles and surfaces."""
