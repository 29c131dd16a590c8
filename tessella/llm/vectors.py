"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors form a class (its smallest vec_id goes on). K-means on bounded, hash-chosen samples
   gives shards in two levels (at most TOPS, each dealt further by a sample of its own, in tasks).
2. In each shard, classes within half the range of a common centre form a ball: all of them link with
   each other. A node of the graph is a ball (centre, radius, its vectors' number) or a class that is
   in none, so a tight group counts as a few nodes, whatever its size.
3. Every node is indexed in the shards of its OVERLAP nearest centres. Per shard: nearest neighbours
   within it, pruned robustly (a neighbour is skipped if a chosen one is nearer to it by the factor
   ALPHA) to at most DEGREE, with reverse edges. A node's lists from all its shards are united into
   one adjacency list.
4. Search: every node queries the shards of its nearest centres. A greedy beam search starts from
   the shard's medoids (and from the node itself where it is indexed), then expands over every node
   found within the range, widened by the radii.
5. Verification in double precision: radii and the angle of two centres tell pairs of which all
   vectors link, and pairs of which none do; of the others every vector of one meets every vector of
   the other. A pair of nodes counts for both, whichever found it.
6. Audit: hash-chosen classes, of balls and of none apart, are compared with all rows. Links within a
   class's own ball are certain and left out; of a class's other links the part that was found counts,
   each class alike, so a large group can't hide what others lost. While either kind's mean is below
   ``min_recall``, the search is repeated with twice the shards and twice the beam, at last with all
   shards and without the graph.

Links leave the search as pairs of nodes; their numbers are sums over these.

Edge cases: a vector that is null, zero or holds a null or non-finite component links with nothing;
vectors of different lengths aren't compared; repeated rows are copies (each counts as a vector); a
row with a null vec_id counts as a vector but has a null component; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, cut, shuffle_partitions
from ._text import mix

SHARD, MOST, OVERLAP = 2000, 24_000, 3
TOPS, NEXT, TREE_BYTES = 512, 64, 64 << 20
NEAR, DEGREE, ALPHA, BEAM, MEDOIDS = 48, 24, 1.2, 32, 8
SAMPLE, AUDIT = 20_000, (400, 2000)  #: AUDIT: classes of balls, and of none
SLACK = 1e-6  #: radians that an angle from a cosine may be off


def _blobs(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x, float))])


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), float).reshape(len(col), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction."""
    with np.errstate(all="ignore"):
        ok = np.isfinite(x).all(1)
        norm = np.linalg.norm(x, axis=1)
        odd = np.flatnonzero(ok & ~((norm > 0) & np.isfinite(norm)))
        if len(odd):  # squares that vanish or overflow
            x = x.copy()
            x[odd] /= np.maximum(np.abs(x[odd]).max(1, keepdims=True), 5e-324)
            norm[odd] = np.linalg.norm(x[odd], axis=1)
        ok &= norm > 0
        return x / norm[:, None] + 0.0, ok


def _valid(batches):
    """id, len, v (unit vector, doubles), h1 and h2 (hashes of the vector); vectors that aren't usable are null."""
    names = ["id", "len", "v", "h1", "h2"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            ids, col = batch.column("id").slice(lo, 8192), batch.column("v").slice(lo, 8192)
            size = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
            left = np.ones(len(col), bool)
            for d in np.unique(size[size > 0]):
                at = np.flatnonzero(size == d)
                x, ok = _unit(np.asarray(pc.fill_null(pc.list_flatten(col.take(pa.array(at))).cast(pa.float64()), np.nan)).reshape(-1, d))
                at, x = at[ok], x[ok]
                left[at] = False
                for k in range(0, len(at), max(1, (256 << 20) // (8 * d))):
                    part, own = x[k : k + max(1, (256 << 20) // (8 * d))], at[k : k + max(1, (256 << 20) // (8 * d))]
                    bits = mix(np.ascontiguousarray(part).view(np.uint64) + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    h = [bits.sum(1).view(np.int64), np.bitwise_xor.reduce(mix(bits), axis=1).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(np.full(len(own), d, np.int64)), _blobs(part), *map(pa.array, h)], names)
            rest = np.flatnonzero(left)
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rest)), none, pa.nulls(len(rest), pa.binary()), none, none], names)


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


class Tree:
    """The shards of the vectors of one length: top centres, and of each top the centres of its shards."""

    def __init__(self, tops: np.ndarray):
        self.tops, self.below = tops, {}
        self.number()

    def number(self) -> None:
        sizes = [len(self.below.get(t, [0])) for t in range(len(self.tops))]
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def nearest(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of each row's ``count`` nearest shards, among those of its nearest tops."""
        sim = x @ self.tops.T
        wide = min(len(self.tops), max(8, 2 * count))
        near = np.argpartition(-sim, wide - 1, axis=1)[:, :wide] if wide < len(self.tops) else np.tile(np.arange(len(self.tops)), (len(x), 1))
        row, top = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
        rows, shards, sims = [], [], []
        plain = ~np.isin(top, list(self.below))
        rows.append(row[plain]), shards.append(self.first[top[plain]]), sims.append(sim[row[plain], top[plain]])
        for t, c in self.below.items():
            at = row[top == t]
            if len(at):
                rows.append(np.repeat(at, len(c))), shards.append(np.tile(self.first[t] + np.arange(len(c)), len(at))), sims.append((x[at] @ c.T).ravel())
        row, shard, sim = np.concatenate(rows), np.concatenate(shards), np.concatenate(sims)
        order = np.lexsort((shard, -sim, row))
        row, shard = row[order], shard[order]
        start = np.searchsorted(row, np.arange(len(x)))
        first = np.arange(len(row)) - start[row] < count
        return row[first], shard[first]


def _hash(ids: np.ndarray, salt: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) ^ np.uint64(salt)) >> np.uint64(1)).astype(np.int64)


def _route(trees, blocks: dict[tuple[int, int], int], count: int, query: bool):
    """A row per shard of each row of (len, id, n, v, radius): with shard, block, turn and is_index.

    A row is indexed in one block of a shard; a shard's queries are dealt into as many turns as it
    has blocks, and each turn meets every block, so no task holds a whole shard.
    """

    def run(batches):
        for batch in batches:
            length, ids = np.asarray(batch.column("len")), np.asarray(batch.column("id"))
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                for lo in range(0, len(at), 2048):
                    own = at[lo : lo + 2048]
                    row, shard = trees.value[int(d)].nearest(_matrix(batch.column("v").take(pa.array(own)).to_pylist()), count)
                    row = own[row]
                    parts = np.array([blocks.get((int(d), int(s)), 1) for s in shard], np.int64)
                    block, turn = _hash(ids[row], 0) % parts, np.zeros(len(row), np.int64)
                    if query:
                        turn = _hash(ids[row], 0x5BF03635) % parts
                        block = np.concatenate([np.arange(p) for p in parts]) if len(parts) else block
                        row, shard, turn = (np.repeat(a, parts) for a in (row, shard, turn))
                    out = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(block), pa.array(turn), pa.array(np.full(len(row), not query)), *out.columns], ["shard", "block", "turn", "is_index", *out.schema.names])

    return run


NODES = "len long, id long, n long, v binary, radius double"
ROUTED = "shard long, block long, turn long, is_index boolean, " + NODES


def _point(salt: str):
    """A number in [0, 1) that an id always has."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _trees(classes: DataFrame, total: int) -> dict[int, Tree]:
    """Shards from a sample of about SAMPLE rows and, below a top of too many rows, about 32 a shard.

    The centres of all shards are a model of at most TREE_BYTES, whatever the number of rows; rows
    beyond that make shards larger, which are then dealt into blocks.
    """
    spark = classes.sparkSession
    share = min(1.0, SAMPLE / max(1, total))
    sample = classes.where(_point("centroids") < share).select("id", "len", "v").toPandas().sort_values("id")
    trees = {int(d): Tree(centroids(_matrix(g["v"]), max(1, min(len(g), TOPS, round(len(g) / share / SHARD))))) for d, g in sample.groupby("len")}
    # lengths that only rows outside of the sample have: one shard each
    for r in classes.select("len").distinct().where(~F.col("len").isin(list(trees))).collect():
        trees[r["len"]] = Tree(np.eye(1, r["len"]))
    shared = spark.sparkContext.broadcast(trees)
    home = classes.mapInArrow(_route(shared, {}, 1, False), ROUTED)
    large = {(r["len"], r["shard"]): r["n"] for r in home.groupBy("len", "shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD).collect()}
    if not large:
        return trees
    most = {d: max(1, TREE_BYTES // (8 * d * max(1, sum(k == d for k, _ in large)))) for d, _ in large}
    number = {key: min(NEXT, most[key[0]], -(-n // SHARD)) for key, n in large.items()}
    rates = spark.createDataFrame([(d, s, min(1.0, 32 * number[d, s] / n)) for (d, s), n in large.items()], "len long, shard long, rate double")
    picked = home.join(F.broadcast(rates), ["len", "shard"]).where(_point("shards") < F.col("rate"))

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        d, s = int(g["len"].iloc[0]), int(g["shard"].iloc[0])
        c = centroids(_matrix(g["v"]), min(len(g), number[d, s]))
        return pd.DataFrame({"len": [d], "shard": [s], "v": [c.tobytes()]})

    for r in picked.select("len", "shard", "id", "v").groupBy("len", "shard").applyInPandas(split, "len long, shard long, v binary").toLocalIterator():
        trees[r["len"]].below[r["shard"]] = np.frombuffer(bytes(r["v"]), float).reshape(-1, r["len"])
    for tree in trees.values():
        tree.number()
    return trees


def balls(x: np.ndarray, most: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Disjoint groups of two rows or more within the angle ``most`` of a centre: rows, centre, radius.

    Centres are sought where rows are dense: the mean of a row's neighbours within twice the angle.
    """
    y = x.astype(np.float32)
    wide = np.cos(min(np.pi, 2 * most))
    near = np.concatenate([(y[lo : lo + 1024] @ y.T >= wide).sum(1) for lo in range(0, len(y), 1024)]) if len(y) else np.zeros(0, int)
    free, out = near > 1, []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < 2:
            break
        if not free[i]:
            continue
        rows = np.flatnonzero(free)
        own = rows[y[rows] @ y[i] >= wide]
        centre = x[own].mean(0)
        size = np.linalg.norm(centre)
        if len(own) < 2 or size < 1e-9:
            continue
        centre /= size
        angle = np.arccos(np.clip(x[own] @ centre, -1, 1))
        inside = angle <= most - SLACK
        if inside.sum() > 1:
            out.append((own[inside], centre, float(angle[inside].max())))
            free[own[inside]] = False
    return out


def _nodes(least: float):
    """Of a shard's block of classes: its nodes (node, n, v, radius) and the members of balls (node, id, n, v)."""
    most = np.arccos(least) / 2 - 2 * SLACK

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        ids, n, x, d = g["id"].to_numpy(), g["n"].to_numpy(), _matrix(g["v"]), g["len"].to_numpy()
        alone, out = np.ones(len(g), bool), []
        for rows, centre, radius in balls(x, most):
            alone[rows] = False
            node = ids[rows].min()
            out.append(pd.DataFrame({"len": d[:1], "node": [node], "id": pd.array([None], "Int64"), "n": [n[rows].sum()], "v": [centre.tobytes()], "radius": [radius]}))
            out.append(pd.DataFrame({"len": d[rows], "node": node, "id": pd.array(ids[rows], "Int64"), "n": n[rows], "v": g["v"].to_numpy()[rows], "radius": np.nan}))
        out.append(pd.DataFrame({"len": d[alone], "node": ids[alone], "id": pd.array([None] * int(alone.sum()), "Int64"), "n": n[alone], "v": g["v"].to_numpy()[alone], "radius": 0.0}))
        return pd.concat(out)

    return run


def prune(x: np.ndarray) -> list[np.ndarray]:
    """The block's graph: every row's robustly pruned neighbours, with reverse edges."""
    n = len(x)
    k = min(NEAR, n - 1)
    if k < 1:
        return [np.zeros(0, int)] * n
    y = x.astype(np.float32)
    edges = []
    for lo in range(0, n, 512):
        at = np.arange(lo, min(n, lo + 512))
        sim = y[at] @ y.T
        sim[np.arange(len(at)), at] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        far = 2 - 2 * np.take_along_axis(sim, near, 1)  # squared distances
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        between = 2 - 2 * np.matmul(y[near], y[near].transpose(0, 2, 1))
        alive = np.ones(near.shape, bool)
        for _ in range(min(DEGREE, k)):
            pick = alive.argmax(1)
            live = np.flatnonzero(alive[np.arange(len(at)), pick])
            if not len(live):
                break
            edges.append(np.stack([at[live], near[live, pick[live]]], 1))
            alive[np.arange(len(at)), pick] = False
            alive[live] &= ALPHA**2 * between[live, pick[live]] > far[live]
    out = np.concatenate(edges)
    back = out[np.lexsort((out[:, 0], out[:, 1]))][:, ::-1]
    rank = np.arange(len(back)) - np.searchsorted(back[:, 0], np.arange(n))[back[:, 0]]
    both = np.unique(np.concatenate([out, back[rank < DEGREE]]), axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))


def _build(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("id")
    ids = g["id"].to_numpy()
    return pd.DataFrame({"id": ids, "near": [ids[a] for a in prune(_matrix(g["v"]))]})


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, width: int = BEAM):
    """(query, row) pairs of cosine >= the query's least (but for rounding): a beam search from medoids (and own, if not -1), then range expansion.

    graph: neighbours of every row, filled up with -1. A beam as wide as the block compares all.
    """
    n, m = len(x), len(q)
    x32, q32, low = x.astype(np.float32), q.astype(np.float32), least - 1e-4
    if width >= n:
        return np.argwhere(q32 @ x32.T >= low[:, None])
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    mean = x32.mean(0)
    starts = np.argsort(-(x32 @ mean), kind="stable")[: MEDOIDS // 2]
    starts = np.unique(np.concatenate([starts, np.linspace(0, n - 1, MEDOIDS).astype(int)]))
    beam = np.hstack([np.tile(starts, (m, 1)), np.where(own < 0, n, own)[:, None]])
    found = []

    def similar(who, rows):
        return np.matmul(x32[np.minimum(rows, n - 1)], q32[who][:, :, None])[:, :, 0]

    def note(who, rows, sim):
        a, b = np.nonzero((sim >= low[who, None]) & (rows < n))
        found.append(np.stack([who[a], rows[a, b]], 1))

    who = np.arange(m)
    beam[np.isin(beam[:, -1], starts), -1] = n
    sim = np.where(beam < n, similar(who, beam), -2)
    note(who, beam, sim)
    np.put_along_axis(seen, beam, True, 1)
    done = beam >= n
    while len(who):
        pick = np.argsort(np.where(done, 3.0, -sim), axis=1, kind="stable")[:, :4]
        open_ = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        nodes = np.where(open_, np.take_along_axis(beam, pick, 1), n)
        new = graph[nodes].reshape(len(who), -1)
        new = np.where(new < 0, n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new = np.where(seen[who[:, None], new], n, new)
        seen[who[:, None], new] = True
        more = np.where(new < n, similar(who, new), -2)
        note(who, new, more)
        beam, sim, done = np.hstack([beam, new]), np.hstack([sim, more]), np.hstack([done, new >= n])
        top = np.argsort(-sim, axis=1, kind="stable")[:, :width]
        beam, sim, done = (np.take_along_axis(v, top, 1) for v in (beam, sim, done))
        left = (~done).any(1)
        who, beam, sim, done = who[left], beam[left], sim[left], done[left]
    hits = np.concatenate(found)
    out = [hits]
    while len(hits):  # every row in range leads to its neighbours
        a = np.repeat(hits[:, 0], graph.shape[1])
        b = graph[hits[:, 1]].ravel()
        ok = b >= 0
        pair = np.unique(a[ok] * np.int64(n + 1) + b[ok])
        a, b = pair // (n + 1), pair % (n + 1)
        fresh = ~seen[a, b]
        a, b = a[fresh], b[fresh]
        seen[a, b] = True
        near = np.einsum("kd,kd->k", q32[a], x32[b]) >= low[a]
        hits = np.stack([a[near], b[near]], 1)
        out.append(hits)
    return np.concatenate(out)


def _search(least: float, width: int):
    """Pairs a < b of nodes: full (all their vectors link) or else to be compared vector by vector."""
    reach = np.arccos(least)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        index, ask = g[g["is_index"]].sort_values("id"), g[~g["is_index"]].sort_values("id")
        ids, asked = index["id"].to_numpy(), ask["id"].to_numpy()
        parts = []
        if len(ids) and len(asked):
            x, q, rx, rq = _matrix(index["v"]), _matrix(ask["v"]), index["radius"].to_numpy(), ask["radius"].to_numpy()
            sizes = index["near"].map(len).to_numpy()
            graph = np.full((len(ids) + 1, max(1, sizes.max())), -1)
            row, place = np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            near = np.concatenate([*index["near"], np.zeros(0, np.int64)]).astype(np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            graph[row, place] = np.where(ids[at] == near, at, -1)  # a neighbour may be in another shard
            own = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            own = np.where(ids[own] == asked, own, -1)
            range_ = np.cos(np.minimum(np.pi, reach + rq + rx.max()))
            step = max(64, 40_000_000 // (len(ids) + 1))
            for lo in range(0, len(asked), step):
                pairs = search(x, graph, q[lo : lo + step], own[lo : lo + step], range_[lo : lo + step], width)
                for k in range(0, len(pairs), 1 << 20):
                    a, b = pairs[k : k + (1 << 20), 0] + lo, pairs[k : k + (1 << 20), 1]
                    cosine, both = np.einsum("kd,kd->k", q[a], x[b]), rq[a] + rx[b]
                    angle = np.arccos(np.clip(cosine, -1, 1))
                    full = np.where(both == 0, cosine >= least, angle + both < reach - SLACK)
                    keep = (full | ((both > 0) & (angle - both <= reach + SLACK))) & (asked[a] != ids[b])
                    a, b, full = asked[a[keep]], ids[b[keep]], full[keep]
                    parts.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "full": full}))
        return pd.concat(parts).drop_duplicates() if parts else pd.DataFrame({"a": [], "b": [], "full": []})

    return run


def _meet(least: float):
    """A ball's vectors against those of other nodes: per vector its links (id, links), per other node whether there is one (a, b)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        home, other = g[g["is_index"]], g[~g["is_index"]].sort_values("node", kind="stable")
        if not len(home) or not len(other):
            return pd.DataFrame({"id": [], "links": [], "a": [], "b": []})
        x, n = _matrix(home["v"]), home["n"].to_numpy()
        q, m, node = _matrix(other["v"]), other["n"].to_numpy(), other["node"].to_numpy()
        mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(q), np.int64)
        for lo in range(0, len(q), 512):
            hit = (q[lo : lo + 512] @ x.T >= least).astype(float)
            mine += (m[lo : lo + 512] @ hit).astype(np.int64)
            theirs[lo : lo + 512] = hit @ n
        linked, ball = np.unique(node[theirs > 0]), home["node"].iloc[0]
        ids, links = np.concatenate([home["id"], other["id"]]), np.concatenate([mine, theirs])
        some = links > 0
        blank = lambda k: pd.array([None] * k, "Int64")
        return pd.DataFrame({
            "id": pd.array([*ids[some], *blank(len(linked))], "Int64"), "links": pd.array([*links[some], *blank(len(linked))], "Int64"),
            "a": pd.array([*blank(int(some.sum())), *np.minimum(linked, ball)], "Int64"), "b": pd.array([*blank(int(some.sum())), *np.maximum(linked, ball)], "Int64"),
        })

    return run


def _brute(ids: np.ndarray, q: np.ndarray, least: float):
    def run(batches):
        for batch in batches:
            length = np.asarray(batch.column("len"))
            at = np.flatnonzero(length == q.shape[1])
            for lo in range(0, len(at), 2048):
                part = pa.array(at[lo : lo + 2048])
                n, own = np.asarray(batch.column("n").take(part)), np.asarray(batch.column("id").take(part))
                hit = (q @ _matrix(batch.column("v").take(part).to_pylist()).T >= least) & (own[None, :] != ids[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((hit * n).sum(1).astype(np.int64))], ["id", "links"])

    return run


def recall(classes: DataFrame, counted: DataFrame, least: float, sample: tuple[int, int] = AUDIT) -> float:
    """The smaller of two means over hash-chosen classes, those in balls and those in none: the part of
    a class's links outside of its ball (by brute force) that was counted.

    counted: id, links (to vectors of other classes) and certain (those of them within its ball).
    """
    out = 1.0
    for alone, most in ((False, sample[0]), (True, sample[1])):
        rows = classes.join(counted.where((F.col("certain") == 0) == alone), "id").orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(most).select("id", "len", "v", "links", "certain").toPandas()
        shares = []
        for _, g in rows.groupby("len"):
            ids = g["id"].to_numpy()
            want = classes.mapInArrow(_brute(ids, _matrix(g["v"]), least), "id long, links long").groupBy("id").agg(F.sum("links").alias("want"))
            by_id = {r["id"]: r["want"] for r in want.collect()}  # a row per sampled class
            outside = np.array([by_id[i] for i in ids]) - g["certain"].to_numpy()
            some = outside > 0
            shares += np.minimum((g["links"] - g["certain"]).to_numpy()[some] / outside[some], 1).tolist()
        out = min([out, float(np.mean(shares))] if shares else [out])
    return out


def links(vectors: DataFrame, *, least: float = 0.95, min_recall: float = 0.97, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links are cosines of at least ``least``.

    No search ends with less than ``min_recall`` of the audited links found, in balls or between them.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(_valid, "id long, len long, v binary, h1 long, h2 long"))
    usable = rows.where("v is not null")
    classes = cut(usable.groupBy("len", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")).where("id is not null"))
    units = classes.select("len", "id", "n", "v", F.lit(0.0).alias("radius"))
    trees = _trees(units, classes.count())
    shared = spark.sparkContext.broadcast(trees)
    tasks = shuffle_partitions(spark)

    def routed(df: DataFrame, count: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
        """df in its shards, those of more than MOST rows in blocks, and how many."""
        out = cut(df.mapInArrow(_route(shared, {}, count, False), ROUTED))
        sizes = out.groupBy("len", "shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST).collect()
        blocks = {(r["len"], r["shard"]): -(-r["n"] // MOST) for r in sizes}
        return (cut(df.mapInArrow(_route(shared, blocks, count, False), ROUTED)) if blocks else out), blocks

    part = ["len", "shard", "block"]
    home, _ = routed(units, 1)
    both = cut(home.repartition(tasks, *part).groupBy(*part).applyInPandas(_nodes(least), "len long, node long, id long, n long, v binary, radius double"))
    nodes = both.where("id is null").select("len", F.col("node").alias("id"), "n", "v", "radius")
    members = both.where("id is not null").select("node", "id", "n", "v").unionByName(nodes.where("radius = 0").select(F.col("id").alias("node"), "id", "n", "v"))
    index, blocks = routed(nodes, OVERLAP)
    lists = index.repartition(tasks, *part).groupBy(*part).applyInPandas(_build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    index = cut(index.join(united, "id"))
    if blocks:
        turns = spark.createDataFrame([(d, s, p) for (d, s), p in blocks.items()], "len long, shard long, parts int")
        index = index.join(F.broadcast(turns), ["len", "shard"], "left")
        index = index.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = [*part, "turn"]
    most = max([int(t.first[-1]) for t in trees.values()], default=1)
    probes, width = OVERLAP + 1, BEAM
    weight = nodes.select("id", F.col("n").alias("w"))
    while True:
        asked = nodes.mapInArrow(_route(shared, blocks, min(probes, most), True), ROUTED).withColumn("near", F.lit(None).cast("array<long>"))
        pairs = index.unionByName(asked).repartition(tasks, *met).groupBy(*met).applyInPandas(_search(least, width), "a long, b long, full boolean")
        pairs = cut(pairs.distinct())
        full = pairs.where("full").select("a", "b")
        mutual = full.unionByName(full.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by_node = mutual.join(weight.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("w").alias("full_links"))
        # the larger node of an open pair is met by the other one's vectors, in turns of about MOST
        w = lambda c: weight.select(F.col("id").alias(c), F.col("w").alias(f"w{c}"))
        open_ = pairs.where("not full").join(w("a"), "a").join(w("b"), "b")
        swap = F.struct("wa", "a") < F.struct("wb", "b")
        open_ = open_.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("ball"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("node"), F.least("wa", "wb").alias("w"))
        open_ = cut(open_)
        turns = open_.groupBy("ball").agg(F.ceil(F.sum("w") / MOST).alias("turns"))
        sides = open_.join(turns, "ball").select("ball", F.pmod(F.xxhash64("node"), "turns").alias("turn"), "node", F.lit(False).alias("is_index"))
        held = turns.select("ball", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.col("ball").alias("node"), F.lit(True).alias("is_index"))
        sides = cut(sides.unionByName(held))
        near = sides.join(members, "node").repartition(tasks, "ball", "turn").groupBy("ball", "turn").applyInPandas(_meet(least), "id long, links long, a long, b long")
        near = cut(near)
        by_id = near.where("id is not null").groupBy("id").agg(F.sum("links").alias("open_links"))
        counted = members.join(weight.withColumnRenamed("id", "node"), "node").join(by_node.withColumnRenamed("a", "node"), "node", "left").join(by_id, "id", "left")
        found = F.col("w") - F.col("n") + F.coalesce("full_links", F.lit(0)) + F.coalesce("open_links", F.lit(0))
        counted = cut(counted.select("id", "node", found.alias("links"), (F.col("w") - F.col("n")).alias("certain")))
        got = recall(classes, counted, least)
        if got >= min_recall:
            break
        if width > MOST:
            raise RuntimeError(f"the audit found {got:.3f} of the links")
        probes, width = 2 * probes, 2 * width if probes < most else 2 * MOST
    comps = components(full.unionByName(near.where("a is not null").select("a", "b")))
    per_class = classes.select("len", "h1", "h2", F.col("id").alias("rep"), "n").join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(comps, "node", "left")
    out = rows.select("id", "len", "h1", "h2").join(per_class, ["len", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "rep", "id"))
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(1)) - 1
    return out.select(F.col("id").alias("vec_id"), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: The rows of ``links`` for embeddings, by all pairs.
LINKS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS m FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.m * b.m) >= 0.95::DOUBLE),
reach AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""
