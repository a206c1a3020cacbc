"""Points in boxes, and boxes near points, by an equi-join on grid cells of three sizes.

A box goes to the finest of three grids on which it is at most ``REACH`` cells wide and high, and there to every cell
that it meets; a point goes to its one cell on each grid.  So a point becomes three rows however many boxes
there are, a box at most ``(REACH + 1) ** 2`` rows, and cells are never much larger than the boxes in them.  The join
is an equality on (level, cell) with the exact test as residual: Spark can shuffle or broadcast it and split hot cells,
instead of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (-4, 0, 5)  # cells of 1/16, 1 and 32 degrees
REACH = 16


def _cell(lon: Column, lat: Column, level: Column) -> tuple[Column, Column]:
    side = F.pow(F.lit(2.0), level)
    return F.floor((lon + 180) / side), F.floor((lat + 90) / side)


def box_cells(boxes: DataFrame, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Each box once for every cell that it meets on its level; columns g_level, g_x, g_y are added.  Boxes with a null or inverted side meet none."""
    side = F.greatest(F.col(xmax) - F.col(xmin), F.col(ymax) - F.col(ymin))
    level = F.when(side <= REACH * 2.0 ** LEVELS[0], LEVELS[0]).when(side <= REACH * 2.0 ** LEVELS[1], LEVELS[1]).otherwise(LEVELS[2])
    real = boxes.where((F.col(xmin) <= F.col(xmax)) & (F.col(ymin) <= F.col(ymax))).withColumn("g_level", level)
    x0, y0 = _cell(F.col(xmin), F.col(ymin), F.col("g_level"))
    x1, y1 = _cell(F.col(xmax), F.col(ymax), F.col("g_level"))
    return real.withColumn("g_x", F.explode(F.sequence(x0, x1))).withColumn("g_y", F.explode(F.sequence(y0, y1)))


def point_cells(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point once for every grid; a point with a null coordinate goes nowhere."""
    x, y = _cell(F.col(lon), F.col(lat), F.col("g_level"))
    every = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("g_level", F.explode(F.array(*map(F.lit, LEVELS))))
    return every.withColumn("g_x", x).withColumn("g_y", y)


def points_in_boxes(points: DataFrame, boxes: DataFrame, lat: str = "p_lat", lon: str = "p_lon", xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """The inner join of points with the boxes that hold them, edges included; column names must not clash."""
    cells = ["g_level", "g_x", "g_y"]
    joined = point_cells(points, lat, lon).join(box_cells(boxes, xmin, ymin, xmax, ymax), cells)
    inside = (F.col(xmin) <= F.col(lon)) & (F.col(xmax) >= F.col(lon)) & (F.col(ymin) <= F.col(lat)) & (F.col(ymax) >= F.col(lat))
    return joined.where(inside).drop(*cells)
