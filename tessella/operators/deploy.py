"""Tiles processed by workers, and what they give gathered into objects of whole slides.

A worker is a function of a tile's image and key; it runs in Arrow batches, and a tile that it fails on
gives a row with the error. Gathering is joins and grouped aggregates on the workers' rows: objects cut
at tile borders are joined where border pixels are neighbours, and their outlines united.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import cut
from .graph import components
from .outlines import LOOPS, union, united
from .raster import label_components, unpack

PIXELS = "array<struct<x:int,y:int>>"


def workers(tiles: DataFrame, work: Callable[..., list[dict]], schema: str, keys: Sequence[str], image: str = "image") -> DataFrame:
    """keys, the columns of schema and failure: a row per result of work(image, **keys), or one with the error that a tile gave."""
    kinds = dict(tiles.dtypes)
    names = [part.split(" ", 1)[0] for part in _fields(schema)]

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                key = [rec[k] for k in keys]
                try:
                    rows += [[*key, *(r[n] for n in names), None] for r in work(unpack(rec[image]), **dict(zip(keys, key, strict=True)))]
                except Exception as e:
                    rows.append([*key, *[None] * len(names), f"{type(e).__name__}: {e}"[:500]])
            yield pd.DataFrame(rows, columns=[*keys, *names, "failure"])

    return tiles.select(*keys, image).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema, "failure string"]))


def _fields(schema: str) -> list[str]:
    """The schema's parts at its outermost commas."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f.strip() for f in out]


def pieces(mask: np.ndarray, tile: int, col: int, row: int) -> list[dict]:
    """piece, n, loops and edge of every component (pixels that share edges) of a tile's mask, in the slide's pixels.

    loops: its region along pixel edges, holes included; edge: its pixels on the tile's border.
    """
    number = label_components(mask > 0, corners=False)
    y, x = np.nonzero(number)
    k = number[y, x]
    order = np.argsort(k, kind="stable")
    y, x, k = y[order], x[order], k[order]
    h, w = mask.shape
    out = []
    for a, b in zip(*(np.searchsorted(k, np.unique(k), side) for side in ("left", "right")), strict=True):
        py, px = y[a:b], x[a:b]
        first = np.ones(b - a, bool)
        first[1:] = (py[1:] != py[:-1]) | (px[1:] != px[:-1] + 1)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], b - a) - 1
        boxes: dict[tuple[int, int], list[list[int]]] = {}  # runs of one span in lines that follow each other are one box
        for x0, x1, line in zip(px[starts].tolist(), (px[ends] + 1).tolist(), py[starts].tolist(), strict=True):
            held = boxes.setdefault((x0, x1), [])
            if held and held[-1][1] == line:
                held[-1][1] += 1
            else:
                held.append([line, line + 1])
        runs = [[np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float) + (col * tile, row * tile)] for (x0, x1), lines in boxes.items() for y0, y1 in lines]
        loops = [[{"x": float(p), "y": float(q)} for p, q in loop] for loop in (union(runs) if len(runs) > 1 else runs[0])]
        rim = (px == 0) | (py == 0) | (px == w - 1) | (py == h - 1)
        edge = [{"x": int(p), "y": int(q)} for p, q in zip(px[rim] + col * tile, py[rim] + row * tile, strict=True)]
        out.append({"piece": int(k[a]), "n": int(b - a), "loops": loops, "edge": edge})
    return out


def objects(tiles: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Objects (slide, whole, pieces, n: pixels, loops) of masks in tiles (slide, col, row, image), and the tiles that failed.

    Components of tiles are one object where their border pixels share an edge; ``whole`` names it.
    """

    def work(image, slide, col, row):
        return pieces(image, tile, col, row)

    found = cut(workers(tiles, work, f"piece int, n long, loops {LOOPS}, edge {PIXELS}", ["slide", "col", "row"]))
    own = found.where("failure is null").withColumn("id", F.concat_ws("/", F.col("slide").cast("string"), "col", "row", "piece"))
    rim = own.select("slide", "id", F.explode("edge").alias("p")).select("slide", "id", "p.x", "p.y")
    meets = None
    for dx, dy, axis in ((1, 0, "x"), (0, 1, "y")):
        left = rim.where((F.col(axis) + 1) % tile == 0).select("slide", F.col("id").alias("a"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
        pairs = left.join(rim.withColumnRenamed("id", "b"), ["slide", "x", "y"]).select("a", "b").distinct()
        meets = pairs if meets is None else meets.unionByName(pairs)
    comps = components(meets).select(F.col("node").alias("id"), F.col("component").alias("whole"))
    named = cut(own.join(comps, "id", "left").select("slide", F.coalesce("whole", "id").alias("whole"), "n", "loops"))
    sizes = named.groupBy("slide", "whole").agg(F.sum("n").alias("n"))
    regions = united(named.select("slide", "whole", "loops"), ["slide", "whole"], float(tile))
    return regions.join(sizes, ["slide", "whole"]), found.where("failure is not null").select("slide", "col", "row", "failure")
