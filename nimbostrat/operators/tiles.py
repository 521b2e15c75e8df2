"""Frames cut in tiles with halos, so that stencils need no whole row or column of a frame.

A cell belongs to one tile and is copied to the tiles whose margin it lies in. A
stencil then runs with the tile among its keys: its windows are as long as a tile and
its margins, whatever the size of the frame, and one frame spreads over many
tasks. What it finds in the margins is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 256
TILE = ("tile_row", "tile_col")


def tiles_of(at: Column, halo: int, side: int) -> Column:
    """The tiles along one axis that a place belongs to or whose margin it lies in; tile numbers may be negative at the edge."""
    return F.sequence(F.floor((at - halo) / side), F.floor((at + halo) / side))


def tiled(grid: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """``grid`` (row, col, ...) with tile_row, tile_col and whether a cell is the tile's own; a cell may stand in several.

    Tiles beyond the frame's edge hold margins only.
    """
    rows = grid.withColumn("tile_row", F.explode(tiles_of(F.col("row"), halo, side)))
    rows = rows.withColumn("tile_col", F.explode(tiles_of(F.col("col"), halo, side)))
    return rows.withColumn("own", (F.floor(F.col("row") / side) == F.col("tile_row")) & (F.floor(F.col("col") / side) == F.col("tile_col")))


def over_tiles(grid: DataFrame, halo: int, stencil: Callable[[DataFrame, tuple[str, ...]], DataFrame], keys: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """What ``stencil`` gives over ``grid``, computed tile by tile.

    stencil: a function of cells and keys whose result at a cell depends on cells up to
    ``halo`` rows and columns away, and which keeps other columns. Each pass of a
    stencil of two axes needs its own reach of halo.
    """
    return stencil(tiled(grid, halo, side), (*keys, *TILE)).where("own").drop(*TILE, "own")
