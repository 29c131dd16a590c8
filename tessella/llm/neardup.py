"""MinHash near-dedup by an LSH forest over word-shingle sets.

1. Every text becomes its set of distinct k-word shingles (64-bit hashes), a digest of the set and a
   128-value MinHash signature. Equal sets form a class; only its smallest doc_id goes on.
2. The forest: TREES sorted orders of the signatures, each starting with other hash functions. In a
   sorted order the neighbours with the longest common prefix are adjacent. Depth adapts by region:
   a run that shares MIN_DEPTH values is a region if it has at most REGION rows, else its longer
   common prefixes are, up to the whole key; a run of equal whole keys is cut into blocks in a
   random order that differs from tree to tree. These give first links. Runs above REGION, and runs
   that lie in more than one partition, are compared as wholes afterwards: dealt into blocks, every
   block meets every other in a task of its own, but for rows that are connected already.
3. Pairs of a region whose sketches (one bit of each signature value) and set sizes allow the
   similarity are candidates. A region with many of them first gives a sparse part that can
   connect it, verified as all are; afterwards it gives every candidate whose ends are not connected yet.
   So a dense group costs links in its number of rows, and no candidate is lost.
4. Candidates are verified on the full sets of their whole texts; connected components of what
   remains (distributed, see ``_spark.components``) are the groups.

With 24 trees of depth 4, all of whose runs are compared, a pair at a similarity of exactly 0.8 is missed with probability 3e-6; the
sketch test misses it with probability 3e-7.

Edge cases: a null text or one without words has an empty set, is linked with nothing and kept; a
text with fewer than k words has its word sequence as its one shingle; repeated rows and rows that
share a doc_id are one document (linked if any of its texts are); a row with a null doc_id takes part
in no link, has a null component and is kept; an empty table gives an empty result. Only the named
columns are read; ``drop_near_copies`` passes all columns through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, shuffle_partitions, small
from ._text import blocks, lower_ascii, mix, shingle_sets, span_hashes, text_bytes, words

HASHES, TREES, MIN_DEPTH, DEPTH = 128, 24, 4, 8
REGION, DENSE, SPARSE_TREES = 512, 4, 3
BLOCK = 1024  #: rows of a block of a run above REGION
TOGETHER = 4_000_000  #: shingles of a region that are verified in one task
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_ORDER = np.array([[*range(4 * t, 4 * t + 4), *_rng.permutation([k for k in range(HASHES) if k // 4 != t])[: DEPTH - 4]] for t in range(TREES)])


def _sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = lower_ascii(raw)
    w = words(raw, off)
    return shingle_sets(span_hashes(raw, w.start, w.end), w.first, k)


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minima for every row (rows with an empty set: zeros)."""
    n = len(first) - 1
    out = np.zeros((n, HASHES), np.uint16)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    ends, i = first[full + 1], 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(ends, first[full[i]] + 16384, "right")))
        rows = full[i:j]
        lo, hi = first[rows[0]], first[rows[-1] + 1]
        part, at = x[lo:hi], first[rows] - lo
        for k in range(HASHES):
            h = (part ^ _C[k]) * _A[k]
            h ^= h >> np.uint32(15)
            out[rows, k] = (np.minimum.reduceat(h, at) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        i = j
    return out


def _features(k: int):
    def run(batches):
        for batch in batches:
            raw, off, _ = text_bytes(batch.column("text"))
            for i, j in blocks(off):
                sets, first = _sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(first)
                full, m = n > 0, mix(sets ^ np.uint64(0x5BF03635))
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(m):
                    d1[full] = np.add.reduceat(m, first[:-1][full])
                    d2[full] = np.bitwise_xor.reduceat(m, first[:-1][full])
                sig = [v.tobytes() for v in signatures(sets, first)]
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(i, j - i), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())], ["i", "n", "d1", "d2", "sig"])

    return run


def _fixed_binary(a: np.ndarray) -> pa.Array:
    n, width = a.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _tree_rows(batches):
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(m, HASHES)
        sketch = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)
        for t in range(TREES):
            key = np.ascontiguousarray(sig[:, _ORDER[t]].astype(">u2")).view(np.uint8).reshape(m, 2 * DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), _fixed_binary(key), batch.column("r"), batch.column("n"), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["t", "key", "r", "n", "s1", "s2"])


def _max_distance(num: int, den: int) -> int:
    """Differing sketch bits that a pair at the similarity exceeds with probability 3e-7."""
    p = (1 - num / den) / 2
    return int(np.ceil(HASHES * p + 5 * np.sqrt(HASHES * p * (1 - p))))


class _Rows:
    """The rows of a region test: ids, set sizes and sketches."""

    def __init__(self, r, n, s1, s2, num, den):
        self.r, self.n, self.s1, self.s2, self.num, self.den, self.most = r, n.astype(np.int64), s1.view(np.uint64), s2.view(np.uint64), num, den, _max_distance(num, den)

    def may(self, a, b):
        """Which of the index pairs may reach the similarity."""
        lo, hi = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        apart = np.bitwise_count(self.s1[a] ^ self.s1[b]) + np.bitwise_count(self.s2[a] ^ self.s2[b])
        return (lo * self.den >= hi * self.num) & (apart <= self.most) & (self.r[a] != self.r[b])

    def square(self, at):
        ok = self.may(at[:, None], at[None, :])
        return np.triu(ok, 1)


def _regions(lcp: np.ndarray, a: int, b: int, depth: int, out: list):
    """Regions of the sorted rows a..b (their neighbours share at least ``depth`` values)."""
    while b - a > REGION and depth < DEPTH:
        depth += 1
        ends = a + 1 + np.flatnonzero(lcp[a : b - 1] < depth)
        if len(ends):
            for p in ends:  # neighbours on both sides of a border still share a long prefix
                out.append((max(a, p - 8), min(b, p + 8), True))
            for x, y in zip(np.concatenate([[a], ends]), np.concatenate([ends, [b]]), strict=True):
                _regions(lcp, int(x), int(y), depth, out)
            return
    for x in range(a, b, REGION):
        out.append((x, min(b, x + REGION), False))


def _scan(num: int, den: int):
    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        m = table.num_rows
        key = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(m, DEPTH, 2)
        t, r, n, s1, s2 = (np.asarray(table[c].combine_chunks()) for c in ("t", "r", "n", "s1", "s2"))
        same = (key[:-1] == key[1:]).all(axis=2)
        lcp = np.where(same.all(axis=1), DEPTH, np.argmin(same, axis=1))
        lcp[t[:-1] != t[1:]] = 0
        rows = _Rows(r, n, s1, s2, num, den)
        starts = np.concatenate([[0], 1 + np.flatnonzero(lcp < MIN_DEPTH)])
        ends = np.concatenate([starts[1:], [m]])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        group = np.repeat(np.arange(len(starts)), ends - starts)
        little = np.repeat(ends - starts <= 16, ends - starts)
        for step in range(1, 16):
            a = np.flatnonzero((group[:-step] == group[step:]) & little[:-step]) if m > step else np.zeros(0, int)
            if not len(a):
                break
            ok = rows.may(a, a + step)
            pairs.append((a[ok], a[ok] + step))
        dense, base = [], TaskContext.get().partitionId() << 32
        for a, b in zip(starts[ends - starts > 16], ends[ends - starts > 16], strict=True):
            regions: list[tuple[int, int, bool]] = []
            _regions(lcp, int(a), int(b), MIN_DEPTH, regions)
            for x, y, _ in regions:
                at = np.arange(x, y)
                ok = rows.square(at)
                i, j = np.nonzero(ok)
                if len(i) <= DENSE * len(at):
                    pairs.append((at[i], at[j]))
                    continue
                if b - a <= REGION:  # larger runs are compared as wholes afterwards
                    dense.append((base + len(dense), at[np.unique(np.concatenate([i, j]))]))
                if t[x] < SPARSE_TREES:
                    both = ok | ok.T
                    hub = int(both.sum(1).argmax())
                    near = np.flatnonzero(both[hub])
                    pairs.append((at[np.full(len(near), hub)], at[near]))
                    rank = np.argsort(np.argsort(mix(r[at].astype(np.uint64))))
                    first = np.where(both, rank[None, :], len(at)).argmin(1)
                    some = np.flatnonzero(both.any(1) & (first != hub) & ~both[hub])
                    pairs.append((at[some], at[first[some]]))
        a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, int)])
        b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, int)])
        edge = np.unique(np.stack([np.minimum(r[a], r[b]), np.maximum(r[a], r[b])], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        names = ["region", "a", "b", "n", "s1", "s2", "t", "key"]

        def emit(size: int, **columns):
            kinds = {"t": pa.int32(), "key": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in names], names)

        yield emit(len(edge), a=edge[:, 0], b=edge[:, 1])
        for k, at in dense:
            yield emit(len(at), region=np.full(len(at), k), a=r[at], n=n[at].astype(np.int64), s1=s1[at], s2=s2[at])
        # runs that may be above REGION: those that are, and those that may go on in other partitions
        wide = np.union1d(np.flatnonzero(ends - starts > REGION), [0, len(starts) - 1])
        yield emit(len(wide), t=t[starts[wide]], key=_fixed_binary(key[starts[wide], :MIN_DEPTH].reshape(len(wide), 2 * MIN_DEPTH)), n=(ends - starts)[wide].astype(np.int64))

    return run


def _open_rows(num: int, den: int):
    """Of a dense region: the rows with a candidate in another component (b is null), to be verified
    together; if their sets are too large for one task, the candidate pairs themselves (region is null)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = _Rows(*(g[c].to_numpy() for c in ("a", "n", "s1", "s2")), num, den)
        c = g["c"].to_numpy()
        i, j = np.nonzero(rows.square(np.arange(len(g))) & (c[:, None] != c[None, :]))
        at = np.union1d(i, j)
        if rows.n[at].sum() <= TOGETHER:
            return g.iloc[at].assign(b=None)[["region", "a", "b", "n", "s1", "s2", "c"]]
        lo, hi = np.minimum(rows.r[i], rows.r[j]), np.maximum(rows.r[i], rows.r[j])
        return pd.DataFrame({"region": None, "a": lo, "b": hi, "n": None, "s1": None, "s2": None, "c": None})

    return run


def _verify_region(k: int, num: int, den: int):
    """Links between components of a dense region, on the full sets of its rows' texts.

    Jaccard distance is a metric: a pair whose distances to a third row differ by more than the
    allowed distance can't be linked, and isn't compared.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = _Rows(*(g[c].to_numpy() for c in ("a", "n", "s1", "s2")), num, den)
        raw, off, _ = text_bytes(pa.array(g["text"], pa.string()))
        sets, first = _sets(raw, off, k)
        own = [sets[first[x] : first[x + 1]] for x in range(len(g))]
        c = g["c"].to_numpy().copy()
        ok = rows.square(np.arange(len(g))) & (c[:, None] != c[None, :])

        def shared(x: int, y: int) -> int:
            at = np.searchsorted(own[x], own[y])
            at[at == len(own[x])] = 0
            return int((own[x][at] == own[y]).sum())

        hub = int((ok | ok.T).sum(1).argmax())
        both = np.array([shared(hub, y) for y in range(len(g))])
        size = np.diff(first)
        far = 1 - both / (size[hub] + size - both)
        ok &= np.abs(far[:, None] - far[None, :]) <= 1 - num / den + 1e-9
        out = []
        for x, y in zip(*np.nonzero(ok), strict=True):
            if c[x] != c[y]:
                n = shared(x, y)
                if den * n >= num * (size[x] + size[y] - n):
                    out.append((min(rows.r[x], rows.r[y]), max(rows.r[x], rows.r[y])))
                    c[c == c[x]] = c[y]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _open_blocks(num: int, den: int):
    """Of two blocks of a run (side 0 and 1; 2 is both): the rows with a candidate in another component.

    ``sub`` deals them out again where their sets are too large for one task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = _Rows(*(g[c].to_numpy() for c in ("r", "n", "s1", "s2")), num, den)
        c, side = g["c"].to_numpy(), g["side"].to_numpy()
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        ok = rows.may(a[:, None], b[None, :]) & (c[a][:, None] != c[b][None, :])
        a, b = a[ok.any(1)], b[ok.any(0)]
        near, far = (np.cumsum(rows.n[at]) // (TOGETHER // 2) for at in (a, b))
        out = []
        for x in np.unique(near):
            for y in np.unique(far):
                p, q = a[near == x], b[far == y]
                at = np.union1d(p, q)
                where = np.where(~np.isin(at, q), 0, np.where(~np.isin(at, p), 1, 2))
                out.append(pd.DataFrame({"region": g["region"].iloc[0], "sub": int(x) << 32 | int(y), "r": rows.r[at], "c": c[at], "side": where}))
        return pd.concat(out) if out else pd.DataFrame({"region": [], "sub": [], "r": [], "c": [], "side": []})

    return run


def _shared(sets: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of shingles that each of the rows a shares with each of the rows b."""
    n = len(first) - 1
    names, column = np.unique(sets, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))

    def cells(at: np.ndarray):
        place = np.full(n, -1)
        place[at] = np.arange(len(at))
        own = place[row]
        order = np.argsort(column[own >= 0], kind="stable")
        return own[own >= 0][order], column[own >= 0][order]

    (ra, ca), (rb, cb) = cells(a), cells(b)
    na, nb = np.bincount(ca, minlength=len(names)), np.bincount(cb, minlength=len(names))
    out = np.zeros(len(a) * len(b), np.int64)
    often = na * nb > max(64, len(a) * len(b) // 256)
    # rare shingles: their pairs of rows; frequent ones: products of 0-1 matrices
    start = np.cumsum(nb) - nb
    some = np.flatnonzero(~often[ca] & (nb[ca] > 0))
    total = np.cumsum(nb[ca[some]])
    for lo in range(0, int(total[-1]) if len(total) else 0, 4_000_000):
        cell = np.arange(lo, min(lo + 4_000_000, int(total[-1])))
        at = np.searchsorted(total, cell, "right")
        x = some[at]
        out += np.bincount(ra[x] * len(b) + rb[start[ca[x]] + cell - (total[at] - nb[ca[x]])], minlength=len(out))
    out = out.reshape(len(a), len(b))
    number = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 2048):
        part = []
        for r, c, size in ((ra, ca, len(a)), (rb, cb, len(b))):
            at = np.flatnonzero(often[c] & (number[c] >= lo) & (number[c] < lo + 2048))
            m = np.zeros((size, 2048), np.float32)
            m[r[at], number[c[at]] - lo] = 1
            part.append(m)
        out += (part[0] @ part[1].T).astype(np.int64)
    return out


def _verify_blocks(k: int, num: int, den: int):
    """A forest of the links between components of two blocks' open rows, on the full sets of their texts."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        raw, off, _ = text_bytes(pa.array(g["text"], pa.string()))
        sets, first = _sets(raw, off, k)
        r, c, side = g["r"].to_numpy(), g["c"].to_numpy().copy(), g["side"].to_numpy()
        a, b, size = np.flatnonzero(side != 1), np.flatnonzero(side != 0), np.diff(first)
        out = []
        if len(a) and len(b):
            both = _shared(sets, first, a, b)
            ok = (both > 0) & (den * both >= num * (size[a][:, None] + size[b][None, :] - both)) & (c[a][:, None] != c[b][None, :]) & (r[a][:, None] != r[b][None, :])
            for x, y in zip(*np.nonzero(ok), strict=True):
                x, y = a[x], b[y]
                if c[x] != c[y]:
                    out.append((min(r[x], r[y]), max(r[x], r[y])))
                    c[c == c[x]] = c[y]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _wide_links(found: DataFrame, trees: DataFrame, texts: DataFrame, comps: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links between components within the runs that a region or a partition doesn't hold; None without such runs.

    Rows of a component of BLOCK rows or more fill blocks of their own, which don't meet each other.
    """
    run = ["t", "key"]
    runs = found.where("t is not null").groupBy(*run).agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    runs = cut(runs.where((F.col("n") > REGION) | (F.col("parts") > 1)).select(*run))
    if not runs.limit(1).count():
        return None
    rows = trees.withColumn("key", F.substring("key", 1, 2 * MIN_DEPTH)).join(small(runs), run)
    rows = rows.join(comps.select(F.col("node").alias("r"), F.col("component").alias("c")), "r", "left").withColumn("c", F.coalesce("c", "r"))
    rows = cut(rows.select(*run, "r", "n", "s1", "s2", "c"))
    sizes = cut(rows.groupBy(*run, "c").agg(F.count("*").alias("size")))
    mixed = sizes.groupBy(*run).agg(F.count("*").alias("cs"), F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).alias("mixed"))
    mixed = small(cut(mixed.where("cs > 1").drop("cs")))
    large = small(cut(sizes.where(F.col("size") >= BLOCK).withColumn("whole", F.col("c"))))
    dealt = rows.join(mixed, run).join(large, [*run, "c"], "left")
    own = F.xxhash64("c", F.pmod(F.xxhash64("r"), F.ceil(F.col("size") / BLOCK)))
    block = F.when(F.col("whole").isNotNull(), own).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("mixed") / BLOCK)))
    dealt = cut(dealt.select(*run, "r", "n", "s1", "s2", "c", "whole", block.alias("block")))
    blocks = cut(dealt.select(*run, "block", "whole").distinct())
    x, y = blocks.select(*run, F.col("block").alias("x"), F.col("whole").alias("wx")), blocks.select(*run, F.col("block").alias("y"), F.col("whole").alias("wy"))
    meet = x.join(y, run).where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("wx") == F.col("wy"), F.lit(False)))
    meet = cut(meet.select(*run, "x", "y", F.xxhash64(*run, "x", "y").alias("region")))
    left = meet.select(*run, F.col("x").alias("block"), "region", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    right = meet.where("x != y").select(*run, F.col("y").alias("block"), "region", F.lit(1).alias("side"))
    sides = small(cut(left.unionByName(right).distinct()))
    tasks = shuffle_partitions(texts.sparkSession)  # a given number isn't coalesced by size
    met = dealt.join(sides, [*run, "block"]).select("region", "side", "r", "n", "s1", "s2", "c").repartition(tasks, "region")
    open_rows = cut(met.groupBy("region").applyInPandas(_open_blocks(num, den), "region long, sub long, r long, c long, side int"))
    near = texts.withColumnRenamed("i", "r").join(small(open_rows), "r").repartition(tasks, "region", "sub")
    return cut(near.groupBy("region", "sub").applyInPandas(_verify_blocks(k, num, den), "a long, b long").distinct())


def _verify(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            ra, oa, _ = text_bytes(batch.column("ta"))
            rb, ob, _ = text_bytes(batch.column("tb"))
            ok = np.zeros(batch.num_rows, bool)
            at, last, own = 0, None, None
            a = np.asarray(batch.column("a"))
            for at in range(batch.num_rows):
                if last is None or a[at] != last or not np.array_equal(text, ra[oa[at] : oa[at + 1]]):
                    last, text = a[at], ra[oa[at] : oa[at + 1]]
                    own = _sets(text, np.array([0, len(text)]), k)[0]
                other = _sets(rb[ob[at] : ob[at + 1]], np.array([0, ob[at + 1] - ob[at]]), k)[0]
                both = len(np.intersect1d(own, other, assume_unique=True))
                ok[at] = both > 0 and den * both >= num * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity on the full sets of their texts."""
    pairs = cut(pairs.select("a", "b").distinct())
    ids = small(cut(pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))).distinct()))
    own = texts.join(ids, "i", "left_semi")
    both = own.select(F.col("i").alias("a"), F.col("text").alias("ta")).join(small(pairs), "a").join(own.select(F.col("i").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, num, den), "a long, b long").distinct())


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    num, den = similarity
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("i"), F.col(text).alias("text"))
    feats = cut(texts.mapInArrow(_features(k), "i long, n long, d1 long, d2 long, sig binary"))
    full = feats.where("n > 0")
    classes = cut(full.groupBy("n", "d1", "d2").agg(F.min("i").alias("r")))
    reps = full.join(classes, ["n", "d1", "d2"]).where("i = r").dropDuplicates(["r", "n", "d1", "d2"]).select("r", "n", "sig")
    trees = cut(reps).mapInArrow(_tree_rows, "t int, key binary, r long, n long, s1 long, s2 long")
    parts = max(shuffle_partitions(spark), -(-classes.count() * TREES // 200_000))
    order = ["t", "key", F.xxhash64("r", "t")]  # equal keys in an order that differs from tree to tree
    found = trees.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = cut(found.mapInArrow(_scan(num, den), "region long, a long, b long, n long, s1 long, s2 long, t int, key binary"))
    links = _links(found.where("region is null and t is null"), texts, k, num, den)
    dense = found.where("region is not null").drop("t", "key")
    comps = components(links)
    if dense.limit(1).count():
        label = dense.join(comps.select(F.col("node").alias("a"), F.col("component").alias("c")), "a", "left")
        label = label.withColumn("c", F.coalesce("c", "a")).drop("b")
        rows = cut(label.groupBy("region").applyInPandas(_open_rows(num, den), "region long, a long, b long, n long, s1 long, s2 long, c long"))
        near = texts.withColumnRenamed("i", "a").join(small(rows.where("b is null").drop("b")), "a")
        near = near.groupBy("region").applyInPandas(_verify_region(k, num, den), "a long, b long")
        more = cut(near.unionByName(_links(rows.where("b is not null"), texts, k, num, den)).distinct())
        if more.limit(1).count():
            links = links.unionByName(more)
            comps = components(links)
    wide = _wide_links(found, trees, texts, comps, k, num, den)
    if wide is not None and wide.limit(1).count():
        comps = components(links.unionByName(wide))
    out = feats.drop("sig").join(classes, ["n", "d1", "d2"], "left").join(comps.select(F.col("node").alias("r"), "component"), "r", "left")
    component = F.when(F.col("i").isNotNull(), F.coalesce("component", "r", "i"))
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document (smallest doc_id) of each group; one row per repeated doc_id."""
    g = cut(groups(docs, **options))
    gone = small(cut(g.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()))
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if g.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = left.where("doc_id is not null").dropDuplicates(["doc_id"])
        left = named.unionByName(left.where("doc_id is null"))
    return left


#: The rows of ``groups`` for documents with two-word shingles. A pair at 0.8 shares one of the
#: rarest n - ceil(0.8 n) + 1 shingles of both sets, so only such pairs are compared.
GROUPS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
ranked AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k FROM cells JOIN (SELECT g, count(*) AS c FROM cells GROUP BY g) USING (g)),
prefix AS (SELECT doc_id, n, g FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT a, b, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.s, y.s)) AS m FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
links AS (SELECT a, b FROM shared WHERE 100 * m >= 80 * (na + nb - m)),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM twoway UNION SELECT r.node, t.b FROM reach r JOIN twoway t ON r.other = t.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM s LEFT JOIN c ON c.node = doc_id
"""
