"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="x int, y int, w int, h int")
class TileGrid:
    """Tiles over a width and height that don't cross the far border: SELECT * FROM tile_grid(4096, 2048, 512, 512)."""

    def eval(self, width: int, height: int, tile: int, step: int):
        for y in range(0, max(0, height - tile), step):
            for x in range(0, max(0, width - tile), step):
                yield x, y, tile, tile


def register(spark: SparkSession) -> None:
    spark.udtf.register("tile_grid", TileGrid)
