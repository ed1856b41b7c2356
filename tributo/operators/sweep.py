"""A frame that sweeps over places in order: what lies within reach, without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a tile of a line, in reaches.
TILE = 512


def swept(cells: DataFrame, wanted: DataFrame, place: str, reach: int, within: list[str], found: dict[str, Column]) -> DataFrame:
    """within, place and the aggregates ``found`` of the cells at most reach away on the same line, for each row of wanted.

    cells: within, place (long) and what the aggregates read; wanted: within, place; neither has a row twice, and places
    and lines aren't null. Lines are cut into tiles; cells near a tile's border stand in both tiles, so a tile is swept by
    itself: sorted by place, a frame of the reach passes over it. A line of any length is many small windows, and a task
    holds the frame, not the line.
    """
    tile = max(1, reach) * TILE
    at = lambda shift: F.expr(f"({place} + {shift}) div {tile}L")
    others = [f for f in cells.schema if f.name not in (*within, place)]
    rows = cells.withColumns({"_tile": F.explode(F.array_distinct(F.array(at(-reach), at(reach)))), "_asked": F.lit(False)})
    asks = wanted.select(*within, place).withColumns({f.name: F.lit(None).cast(f.dataType) for f in others} | {"_tile": at(0), "_asked": F.lit(True)})
    frame = Window.partitionBy(*within, "_tile").orderBy(place).rangeBetween(-reach, reach)
    return rows.unionByName(asks).withColumns({name: c.over(frame) for name, c in found.items()}).where("_asked").select(*within, place, *found)
