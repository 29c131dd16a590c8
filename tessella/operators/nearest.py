"""Nearest-neighbour operators on feature vectors (arrays of doubles).

Neighbours among n rows are found in blocks: a block of rows meets a block of candidates in a task,
keeps the k best of each row, and the partial lists are ranked per row, so neither all pairs nor a
group is ever a Spark row or in one task. The number of blocks follows the size of the largest group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import cut

INDEXED = 4  #: blocks up to which comparing all is cheaper than an index


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda acc, v: acc + v)


def nearest_code(points: DataFrame, codes: DataFrame, *, limit: int = 20_000) -> DataFrame:
    """points (id, vec) with code and dist: the nearest row of the codebook (code, vec); the smallest code of equals.

    The codebook is a model of at most ``limit`` rows; a larger one is refused.
    """
    book = codes.select("code", "vec").limit(limit + 1).toPandas().sort_values("code")
    if len(book) > limit:
        raise ValueError(f"the codebook has more than {limit} rows")
    c, names = np.array(book["vec"].tolist(), float), book["code"].to_numpy()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vec").to_pylist(), float)
                for lo in range(0, len(x), 2048):
                    part = x[lo : lo + 2048]
                    far = np.sqrt(np.maximum(((part[:, None, :] - c[None]) ** 2).sum(2), 0)) if c.size * len(part) < 5e7 else np.sqrt(np.maximum((part**2).sum(1)[:, None] + (c**2).sum(1) - 2 * part @ c.T, 0))
                    best = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(part)), pa.array(names[best]), pa.array(far[np.arange(len(part)), best])], ["id", "code", "dist"])

    kinds = dict(points.dtypes) | {"code": dict(codes.dtypes)["code"]}
    return points.select("id", "vec").mapInArrow(run, f"id {kinds['id']}, code {kinds['code']}, dist double")


def blocks_for(df: DataFrame, on: Sequence[str], rows: int) -> int:
    """How many hash blocks deal the largest group of df into about ``rows`` rows each."""
    n = (df.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")) if on else df.agg(F.count("*"))).first()[0]
    return max(1, -(-(n or 0) // rows))


def wide_blocks(df: DataFrame, on: Sequence[str], rows: int, most: int, groups: int = 1) -> int:
    """How few blocks do for all pairs of blocks: each of at most about ``most`` rows, and two tasks a core if blocks of ``rows`` rows suffice.

    Every row travels once for each block, so their number, not the pairs, decides what is shuffled.
    """
    small, tasks = blocks_for(df, on, rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-small * rows // most), min(small, max(4, math.ceil(math.sqrt(2 * tasks / groups)))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by one product, exact to about 1e-7 of the vectors' length."""
    return np.sqrt(np.maximum((b * b).sum(1)[:, None] + (a * a).sum(1)[None] - 2 * b @ a.T, 0))


def _k_best(names: np.ndarray, a: np.ndarray, asked: np.ndarray, b: np.ndarray, k: int, with_self: bool) -> pd.DataFrame:
    """Exact: the product picks what may be among the k nearest, differences decide. names are in order."""
    far = _distances(a, b)
    if not with_self:
        far[asked[:, None] == names[None]] = np.inf
    some = min(k, len(names))
    edge = np.partition(far, some - 1, axis=1)[:, some - 1]
    slack = 1e-6 * (1 + np.sqrt((a * a).sum(1).max() + (b * b).sum(1)))
    row, col = np.nonzero((far <= (edge + slack)[:, None]) & np.isfinite(far))
    dist = np.sqrt(((a[col] - b[row]) ** 2).sum(1))
    order = np.lexsort((col, dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"id": asked[row[keep]], "other": names[col[keep]], "dist": dist[keep]})


def k_nearest(points: DataFrame, k: int, on: Sequence[str] = (), *, rows: int = 4096, with_self: bool = True) -> DataFrame:
    """id, rank, other, dist: each row's k nearest of its group (Euclidean; ties by id).

    Both sides are dealt into blocks of about ``rows`` rows, from the size of the largest group; every
    block of queries meets every block of its group in a task of its own, and the k best of all
    blocks are ranked, each block's rows cut to k before the shuffle. Without groups, and beyond INDEXED
    blocks, the pivot index answers instead (``pivots.k_nearest``), with the same rows.
    """
    own = points.select(*on, "id", "vec")
    blocks = blocks_for(own, on, rows)
    if not on and blocks > INDEXED:
        from . import pivots

        return pivots.k_nearest(own, k, rows=rows, with_self=with_self)
    dealt = own.withColumn("_h", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    index = dealt.withColumnRenamed("_h", "_b").withColumn("_a", every).withColumn("_q", F.lit(False))
    asked = dealt.withColumnRenamed("_h", "_a").withColumn("_b", every).withColumn("_q", F.lit(True))
    kind = dict(points.dtypes)["id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, q = g[~g["_q"]].sort_values("id"), g[g["_q"]]
        out = []
        if len(x) and len(q):
            names, a, b = x["id"].to_numpy(), np.array(x["vec"].tolist(), float), np.array(q["vec"].tolist(), float)
            out = [_k_best(names, a, q["id"].to_numpy()[lo : lo + 1024], b[lo : lo + 1024], k, with_self) for lo in range(0, len(q), 1024)]
        # one frame from whole columns: frames put together hold text in several chunks
        return pd.DataFrame({c: np.concatenate([o[c].to_numpy() for o in out]) for c in ("id", "other", "dist")}) if out else pd.DataFrame({"id": [], "other": [], "dist": []})

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    met = index.unionByName(asked).repartition(tasks, *on, "_a", "_b").groupBy(*on, "_a", "_b")
    part = met.applyInPandas(run, f"id {kind}, other {kind}, dist double")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other")) - 1).where(F.col("rank") < k)
    return ranked.select("id", "rank", "other", "dist")


def neighbour_share(neighbours: DataFrame, labels: DataFrame, value) -> DataFrame:
    """Per id: the share of neighbours with the label, and the median distance to them and to the others.

    labels: other (id), label.
    """
    n = neighbours.join(labels, "other")
    same = F.col("label") == value
    return n.groupBy("id").agg(F.avg(same.cast("double")).alias("share"), F.median(F.when(same, F.col("dist"))).alias("median_with"), F.median(F.when(~same, F.col("dist"))).alias("median_without"))


def purity(neighbours: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """label, k, purity: mean share of the k nearest others that have the row's own label."""
    own = labels.select(F.col("id"), F.col("label"))
    n = neighbours.join(own, "id").join(own.select(F.col("id").alias("other"), F.col("label").alias("theirs")), "other")
    n = n.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") < F.col("k"))
    each = n.groupBy("id", "label", "k").agg(F.avg((F.col("label") == F.col("theirs")).cast("double")).alias("same"))
    return each.groupBy("label", "k").agg(F.avg("same").alias("purity"))


def coverage(points: DataFrame, centres: DataFrame, radius: float, *, limit: int = 50_000) -> DataFrame:
    """by, covered, n: per group of points (by, id, vec) how many lie within ``radius`` (Manhattan) of any centre (vec).

    centres: a model of at most ``limit`` rows; a larger one is refused.
    """
    c = np.array(centres.select("vec").limit(limit + 1).toPandas()["vec"].tolist(), float)
    if len(c) > limit:
        raise ValueError(f"more than {limit} centres")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vec").to_pylist(), float)
                hit = np.zeros(len(x), bool)
                for lo in range(0, len(x), 256):
                    for v in range(0, len(c), 256):
                        hit[lo : lo + 256] |= (np.abs(x[lo : lo + 256, None] - c[None, v : v + 256]).sum(2) <= radius).any(1)
                yield pa.RecordBatch.from_arrays([batch.column("by"), pa.array(hit)], ["by", "hit"])

    hits = points.select("by", "vec").mapInArrow(run, f"by {dict(points.dtypes)['by']}, hit boolean")
    return hits.groupBy("by").agg(F.count_if("hit").alias("covered"), F.count("*").alias("n"))


def _good(n: int, by: int = 1) -> int:
    """A number from n on, ``by`` times twos, threes and fives, that transforms fast: twos cost least."""
    each = ((2**a * 3**b * 5**c * by, 1 + 0.5 * a + 1.6 * b + 2 * c) for a in range(40) for b in range(5) for c in range(4))
    return min((p for p in each if n <= p[0] < 4 * n + 4 * by), key=lambda p: p[0] * p[1])[0]


def _bin(dx: np.ndarray, dy: np.ndarray, bins: int, top: float) -> np.ndarray:
    """The bin of each distance, bins beyond the top."""
    d = np.sqrt(dx * dx + dy * dy)
    return np.where(d > top, bins, np.minimum(d / (top / bins), bins - 1)).astype(np.int32)


class _Lattice:
    """Whole coordinates from (x0, y0), ``size`` steps in either direction, and how the transforms of a group are cut.

    A group's counts of differences are its autocorrelation. Of its frequencies along x a part takes those
    that leave one rest when divided by ``cuts``, so what a task holds (``most`` bytes) doesn't grow with the points.
    """

    def __init__(self, first: tuple[int, int], last: tuple[int, int], step: tuple[int, int], most: int):
        self.first, self.step = first, step
        self.size = tuple((b - a) // s + 1 for a, b, s in zip(first, last, step, strict=True))
        x, y = self.size
        self.cuts = 2 * max(1, -(-2 * x * y * 16 // (2 * most)))
        self.wide, self.high = _good(2 * x, self.cuts), _good(2 * y)
        self.rests = self.cuts // 2 + 1  # of a rest and its opposite one does for both

    def cost(self) -> float:
        """What a group's transforms take, in pairs of points compared."""
        return 13.0 * self.wide * self.high

    def edges(self, bins: int, top: float) -> np.ndarray:
        """For each difference in y and each bin: how many differences in x from 0 on lie in it or below."""
        (x, y), (sx, sy) = self.size, self.step
        dy = np.arange(y)[:, None] * float(sy)
        reach = (np.arange(bins) + 1) * (top / bins)
        n = np.sqrt(np.maximum(reach * reach - dy * dy, 0)) / sx
        n = np.minimum(np.ceil(n), x).astype(np.int64)
        known, bin_ = np.arange(bins), lambda k: _bin(k * float(sx), dy, bins, top)
        while (off := (n > 0) & (bin_(n - 1) > known)).any():
            n -= off
        while (off := (n < x) & (bin_(n) <= known)).any():
            n += off
        return n

    def counts(self, place: np.ndarray, rests: Sequence[int], edges: np.ndarray) -> np.ndarray:
        """These rests' share of the number of ordered pairs by bin; ``place``: points as y * width + x."""
        (x, y), m, length = self.size, self.cuts, self.wide // self.cuts
        py, px = np.divmod(place, x)
        at, out = py * length + px % length, np.zeros(edges.shape[1])
        columns, f, half, power = np.zeros((16, self.high), complex), np.zeros(self.high, complex), np.zeros(self.high // 2 + 1, complex), np.zeros(self.high)
        for r in rests:
            g = np.empty(y * length, complex)
            turn = 2 * np.pi * ((r * px) % self.wide) / self.wide
            g.real, g.imag = np.bincount(at, np.cos(turn), y * length), np.bincount(at, -np.sin(turn), y * length)
            g = g.reshape(y, length)
            for lo in range(0, y, 256):
                np.fft.fft(g[lo : lo + 256], axis=1, out=g[lo : lo + 256])
            for lo in range(0, length, 16):
                own = columns[: min(16, length - lo)]
                own[:, :y] = g[:, lo : lo + 16].T
                for column in own:
                    column[y:] = 0
                    np.fft.fft(column, out=f)
                    np.multiply(f.real, f.real, out=power)
                    np.multiply(f.imag, f.imag, out=f.imag)
                    power += f.imag
                    column[:y] = np.fft.rfft(power, out=half)[:y]
                np.conjugate(own[:, :y], out=own[:, :y])
                g[:, lo : lo + 16] = own[:, :y].T
            phase = np.exp(2j * np.pi * r * np.arange(length) / self.wide)
            turn = 2 * np.pi * ((r * np.arange(m)) % m) / m
            c, s = np.cos(turn), np.sin(turn)
            cs, ss = (np.concatenate([[0.0], np.cumsum(v)]) for v in (c, s))
            c, s = np.append(c, 0.0), np.append(s, 0.0)
            weight = (1 if r in (0, m // 2) else 2) / m / self.high
            for lo in range(0, y, 256):
                z = np.zeros((min(256, y - lo), length + 1), complex)  # sums over the differences in x before each
                own = g[lo : lo + 256]
                np.fft.ifft(own, axis=1, out=own)
                own *= phase
                np.cumsum(own, axis=1, out=z[:, 1:])
                whole = z[:, -1:]

                def before(n: np.ndarray, z=z, whole=whole) -> np.ndarray:
                    k, u = np.divmod(n, length)
                    p = np.take_along_axis(z, u, 1)
                    return cs[k] * whole.real - ss[k] * whole.imag + c[k] * p.real - s[k] * p.imag

                n = edges[lo : lo + 256]
                right = before(n)
                left = before(np.full((len(n), 1), self.wide)) - before(self.wide - np.maximum(n, 1) + 1)
                both = np.diff(right + left, axis=1, prepend=0.0) * weight
                out += 2 * both.sum(0) - (both[0] if lo == 0 else 0)
        return out


def _packed(on: Sequence[str]):
    """Batches' whole points (x, y) by group: how many, their bounds, the bits that all have, or any, and x and y as bytes."""

    def run(batches):
        for batch in batches:
            df = pa.Table.from_batches([batch]).to_pandas() if batch.num_rows else None
            if df is None:
                continue
            rows = []
            for key, g in df.groupby(list(on), sort=False, dropna=False) if on else [((), df)]:
                x, y = g["x"].to_numpy(np.int64), g["y"].to_numpy(np.int64)
                sides = [f(v) for v in (x, y) for f in (np.min, np.max, np.bitwise_and.reduce, np.bitwise_or.reduce)]
                rows.append([*key, len(g), *map(int, sides), x.tobytes() + y.tobytes()])
            keys = [pa.array([r[k] for r in rows], batch.schema.field(c).type, from_pandas=True) for k, c in enumerate(on)]
            rest = [pa.array([r[len(on) + k] for r in rows]) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*keys, *rest, pa.array([r[-1] for r in rows], pa.binary())], [*on, *_BOUNDS, "data"])

    return run


_BOUNDS = ["n", "x0", "x1", "xa", "xo", "y0", "y1", "ya", "yo"]


def _points(data: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = [np.frombuffer(d, np.int64).reshape(2, -1) for d in data]
    return tuple(np.concatenate([h[k] for h in halves]) for k in (0, 1))


def distance_histogram(points: DataFrame, on: Sequence[str], bins: int, top: float, *, block: int = 4096, most: int = 131_072, distinct: bool = True, lattice: int = 320 << 20) -> DataFrame:
    """on, bin, n: Euclidean distances between all ordered pairs (with themselves) of points (x, y) of a group.

    Bins over [0, top], the last one closed. With ``distinct``, equal points of a group count once.
    Pairs meet block by block (from about ``block`` points to ``most``, as few as keep all cores busy:
    a point travels once for each block of its group) and leave as counts. Where whole coordinates lie
    so densely that it costs less, the numbers of all differences come from transforms of the lattice
    instead, in parts of about ``lattice`` bytes: the same counts, at a cost of its size, not of the pairs.
    """
    kinds = dict(points.dtypes)
    rows = points.select(*on, "x", "y")
    rows = rows.distinct() if distinct else rows
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced by size
    if lattice and all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in "xy"):
        keys = "".join(f"{c} {kinds[c]}, " for c in on)
        rows = rows.where("x is not null and y is not null")
        packed = cut(rows.mapInArrow(_packed(on), f"{keys}{', '.join(f'{c} long' for c in _BOUNDS)}, data binary"))
        folds = {"n": F.sum, "0": F.min, "1": F.max, "a": F.bit_and, "o": F.bit_or}
        size = packed.groupBy(*on).agg(*(folds[c[-1]](c).alias(c) for c in _BOUNDS))
        known = size.agg(F.count("*").alias("groups"), F.sum(F.col("n").cast("double") ** 2).alias("pairs"), *(folds[c[-1]](c).alias(c) for c in _BOUNDS[1:])).first()
        if known["pairs"]:
            step = [((v := known[f"{c}a"] ^ known[f"{c}o"]) & -v) or 1 for c in "xy"]
            grid = _Lattice(*((known[f"x{k}"], known[f"y{k}"]) for k in "01"), step, lattice)
            if grid.cost() * known["groups"] < known["pairs"]:
                return _by_differences(packed, on, kinds, bins, top, grid, known["groups"], tasks)

        def unpack(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    x, y = _points([batch.column("data")[k].as_py()])
                    keys = [pa.array([batch.column(c)[k].as_py()] * len(x), batch.schema.field(c).type) for c in on]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(x), pa.array(y)], [*on, "x", "y"])

        rows = packed.mapInArrow(unpack, f"{keys}x long, y long")
    groups = (rows.select(*on).distinct().count() or 1) if on else 1
    blocks = wide_blocks(rows, on, block, most, groups)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("x", "y"), F.lit(blocks)).cast("int"))
    # each pair of blocks meets once, the lower one on the left; unlike blocks stand for both orders
    left = rows.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1)))).withColumn("_l", F.lit(True))
    right = rows.withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_b")))).withColumn("_l", F.lit(False))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (g[g["_l"] == s][["x", "y"]].to_numpy(float) for s in (True, False))
        total = np.zeros(bins + 1, np.int64)
        for lo in range(0, len(a), 256):
            for at in range(0, len(b), 4096):
                d = (a[lo : lo + 256, None, 0] - b[None, at : at + 4096, 0]) ** 2
                d += (a[lo : lo + 256, None, 1] - b[None, at : at + 4096, 1]) ** 2
                np.sqrt(d, out=d)
                k = np.where(d > top, bins, np.minimum(d / (top / bins), bins - 1)).astype(np.int32)
                total += np.bincount(k.ravel(), minlength=bins + 1)
        total = total[:bins] * (1 if g["_i"].iloc[0] == g["_j"].iloc[0] else 2)
        at = np.flatnonzero(total)
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(at) for c in on}, "bin": at, "n": total[at]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in on), "bin int, n long"])
    both = left.unionByName(right).repartition(tasks, *on, "_i", "_j")
    return both.groupBy(*on, "_i", "_j").applyInPandas(run, schema).groupBy(*on, "bin").agg(F.sum("n").alias("n"))


def _by_differences(packed: DataFrame, on: Sequence[str], kinds: dict[str, str], bins: int, top: float, grid: _Lattice, groups: int, tasks: int) -> DataFrame:
    """``distance_histogram`` of packed whole points by ``_Lattice``: a task takes some rests of a group; their shares of the counts add up."""
    parts = min(grid.rests, max(4, -(-2 * tasks // groups)))
    dealt = packed.select(*on, "data", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y = _points(g["data"].tolist())
        place = (y - grid.first[1]) // grid.step[1] * grid.size[0] + (x - grid.first[0]) // grid.step[0]
        n = grid.counts(place, range(int(g["_part"].iloc[0]), grid.rests, parts), grid.edges(bins, top))
        return pd.DataFrame({**{c: [g[c].iloc[0]] * bins for c in on}, "bin": np.arange(bins), "n": n})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in on), "bin int, n double"])
    shares = dealt.repartition(groups * parts, *on, "_part").groupBy(*on, "_part").applyInPandas(run, schema)
    n = F.round("n")
    sure = F.when(F.abs(F.col("n") - n) > 0.1, F.raise_error(F.lit("counts by differences aren't whole"))).otherwise(n.cast("long"))
    return shares.groupBy(*on, "bin").agg(F.sum("n").alias("n")).select(*on, "bin", sure.alias("n")).where("n > 0")
