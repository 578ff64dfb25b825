"""Tiled maps: area requests, differences, upserts, refresh decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G


def in_area(tiles: DataFrame, x, y, radius: float) -> DataFrame:
    """Tiles whose centre is within the radius in the plane."""
    return tiles.filter(G.distance(("cx", "cy"), (x, y)) <= radius)


def difference(wanted: DataFrame, held: DataFrame, key: str = "tile_id") -> DataFrame:
    """(tile, action): what a client has to ``add`` and to ``remove``."""
    add = wanted.select(key).join(held.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(held.select(key).join(wanted.select(key), key, "left_anti").withColumn("action", F.lit("remove")))


def upsert(held: DataFrame, incoming: DataFrame, removed: DataFrame, key: str = "tile_id") -> DataFrame:
    """The points held after tiles have come and gone; a tile that comes again replaces its old points."""
    stay = held.join(incoming.select(key).distinct(), key, "left_anti")
    return stay.unionByName(incoming).join(removed.select(key).distinct(), key, "left_anti")


def needs_refresh(x, y, last_x, last_y, tiles, update_distance: float = 20.0) -> Column:
    """Without tiles, at first, or once moved further than the distance."""
    first = G.col(last_x).isNull() | G.col(last_y).isNull()
    return (G.col(tiles) == 0) | first | (G.distance((x, y), (last_x, last_y)) > update_distance)


def out_of_range(x, y, last_x, last_y, lidar_radius: float = 100.0, map_radius: float = 150.0) -> Column:
    return G.distance((x, y), (last_x, last_y)) + lidar_radius > map_radius
