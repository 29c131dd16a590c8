"""LM scoring by prediction by partial matching (PPM), beside a smoothed word unigram base.

The byte trie holds contexts of up to ORDER bytes, counted over all training texts (A-Z lower-cased;
a text starts after as many zero bytes and ends with one). A symbol is coded at the longest context
that has seen it; on the way down each context pays its escape (method X: one more than the symbols that it has seen once) and the symbols of the
longer contexts are excluded. Because the trie is pretrained, a symbol's code length depends on its
window of ORDER + 1 bytes alone, so a text's score is a sum of looked-up logarithms.

The trie is complete, whatever the corpus: every window of every order is a row of a distributed
table, which grows with the input. Texts meet it in two ways with the same result. Windows (and
words, for the base) whose count is at least 2^-23 (2^-21) of all counts are broadcast with their
finished logarithm: at most 2^23 (2^21) entries of 16 bytes by this definition. All others are joined with the
tables by a shuffle; those that training never saw walk down the contexts there, one row per
distinct window.

Edge cases: a null text is empty, and an empty text is its end alone; without training rows every
symbol costs log10(256) and the base is 0; repeated rows are scored alike; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, written
from ._text import blocks, lower_ascii, span_hashes, text_bytes, words

ORDER, WINDOW_BITS, WORD_BITS = 5, 23, 21
END_WORD = np.int64(-1)
FLUSH, EMIT = 2_000_000, 500_000


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's window (its context, then the symbol) as an integer, and the texts' offsets in them."""
    n = len(off) - 1
    sizes = np.diff(off)
    start = off[:-1] + (ORDER + 1) * np.arange(n)
    padded = np.zeros(len(raw) + (ORDER + 1) * n, np.int64)
    padded[np.arange(len(raw)) + ORDER + (ORDER + 1) * np.repeat(np.arange(n), sizes)] = raw
    own = np.ones(len(padded), bool)
    for k in range(1, ORDER + 1):
        own[start + sizes + k] = False
    m = len(padded) - ORDER
    g = np.zeros(max(0, m), np.int64)
    for k in range(ORDER + 1):
        g <<= 8
        g |= padded[k : k + m]
    return g[own[:m]], np.concatenate([[0], np.cumsum(sizes + 1)])


class _Tally:
    """Counts of keys, merged whenever many have gathered."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > FLUSH:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        merged = (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)
        self.parts, self.size = [merged], len(merged[0])
        return merged


def _count(batches):
    """word (else window), key, n: counts of a task's words and windows, emitted in bounded pieces."""
    tallies = {True: _Tally(), False: _Tally()}

    def out(word: bool):
        keys, n = tallies[word].merge()
        tallies[word] = _Tally()
        for i in range(0, len(keys), EMIT):
            k = keys[i : i + EMIT]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), word)), pa.array(k.view(np.int64)), pa.array(n[i : i + EMIT].astype(np.int64))], ["word", "key", "n"])

    for batch in batches:
        raw, off, _ = text_bytes(batch.column("text"))
        for i, j in blocks(off):
            part, own = lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i]
            w = words(part, own)
            tallies[True].add(span_hashes(part, w.start, w.end))
            tallies[True].add(np.full(j - i, END_WORD).view(np.uint64))
            tallies[False].add(windows(part, own)[0])
            for word in (True, False):
                if tallies[word].size > FLUSH:
                    yield from out(word)
    for word in (True, False):
        yield from out(word)


@dataclass
class Model:
    windows: tuple[np.ndarray, np.ndarray]  #: the frequent windows, sorted, and their log10 probabilities
    words: tuple[np.ndarray, np.ndarray]  #: hashes of the frequent words, sorted, and log10(count + 1)
    n: int
    v: int
    rest: DataFrame  #: word, key, value of all words and of the windows that aren't frequent
    seen: DataFrame  #: key of every window
    levels: DataFrame  #: order, key, n of the windows of every order
    contexts: DataFrame  #: order, context and its totals


def _orders(key: Column) -> Column:
    """A window's suffixes: order, key, context."""
    keys = [(o, key.bitwiseAND(F.lit((1 << 8 * (o + 1)) - 1))) for o in range(ORDER + 1)]
    return F.array(*[F.struct(F.lit(o).alias("order"), k.alias("key"), F.shiftright(k, 8).alias("context")) for o, k in keys])


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """key and value of rows whose number is bounded, by key as an unsigned integer."""
    got = rows.select("key", F.col("value").cast("double")).toArrow()
    key = np.asarray(got["key"].combine_chunks()).astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.asarray(got["value"].combine_chunks()).astype(float)[order]


def fit(docs: DataFrame, *, text: str = "text") -> Model:
    """Counts all words and windows of all rows of docs."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count, "word boolean, key long, n long")
    table = cut(counted.groupBy("word", "key").agg(F.sum("n").alias("n")))
    sums = {r["word"]: (r["n"], r["v"]) for r in table.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sums.get(True, (0, 0))
    every = table.where("not word").select("n", F.explode(_orders(F.col("key"))).alias("w"))
    levels = cut(every.groupBy("w.order", "w.key").agg(F.sum("n").alias("n")))
    # what the next shorter context has of a context's symbols; no key of these joins has over 256 rows
    short = levels.withColumn("short", F.expr("key & (shiftleft(1L, 8 * order) - 1)"))
    up = levels.select((F.col("order") + 1).alias("order"), F.col("key").alias("short"), F.col("n").alias("have"))
    of = short.join(up, ["order", "short"], "left").groupBy("order", F.shiftright("key", 8).alias("context"))
    contexts = cut(of.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("kinds"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.coalesce(F.sum("have"), F.lit(0)).alias("lower"),
        F.count_if(F.col("have") == 1).alias("lower_once"),
    ))
    longest = levels.where(F.col("order") == ORDER).withColumn("context", F.shiftright("key", 8))
    value = F.log10(F.col("n") / (F.col("total") + F.col("once") + 1))
    seen = cut(longest.join(contexts.where(F.col("order") == ORDER).drop("order"), "context").select("key", "n", value.alias("value")))
    often = F.col("n") >= F.lit(sums.get(False, (0, 0))[0]) / (1 << WINDOW_BITS)
    own = table.where("word").select("key", "n", F.log10(F.col("n") + 1).alias("value"))
    rest = own.select(F.lit(True).alias("word"), "key", "value").unionByName(seen.where(~often).select(F.lit(False).alias("word"), "key", "value"))
    return Model(_sorted(seen.where(often)), _sorted(own.where(F.col("n") >= F.lit(n) / (1 << WORD_BITS))), n, v, rest, seen.select("key"), levels, contexts)


def _backed_off(unseen: DataFrame, model: Model) -> DataFrame:
    """key, value: log10 probability of distinct windows that training has not seen."""
    steps = unseen.select(F.col("key").alias("w"), F.explode(_orders(F.col("key"))).alias("s")).select("w", "s.*")

    def met(rows: DataFrame, levels: DataFrame, contexts: DataFrame) -> DataFrame:
        return rows.join(levels, ["order", "key"], "left").join(contexts, ["order", "context"], "left")

    low = F.col("order") <= 1  # contexts that all windows share; at most 65,792 rows
    found = met(steps.where(low), F.broadcast(model.levels.where(low)), F.broadcast(model.contexts.where(low)))
    found = found.unionByName(met(steps.where(~low), model.levels.where(~low), model.contexts.where(~low)))
    step = F.struct("order", "n", "total", "kinds", "once", "lower", "lower_once")
    paths = found.groupBy("w").agg(F.sort_array(F.collect_list(step), asc=False).alias("path"))

    def state(value, left, kinds, counts, once) -> Column:
        """So far: the logarithm, whether the symbol is still to be coded; of the excluded symbols, how
        many there are, their counts in the next context and how many of them it has once."""
        return F.struct(value.alias("value"), left.alias("left"), kinds.cast("long").alias("kinds"), counts.cast("long").alias("counts"), once.cast("long").alias("once"))

    def descend(a: Column, x: Column) -> Column:
        known = a["left"] & x["total"].isNotNull()
        here = known & x["n"].isNotNull()
        escape = x["once"] - a["once"] + 1
        whole = x["total"] - a["counts"] + escape
        cost = F.when(here, F.log10(x["n"] / whole)).when(known & (x["kinds"] > a["kinds"]), F.log10(escape / whole)).otherwise(0.0)
        zero = F.lit(0)
        return state(a["value"] + cost, a["left"] & ~here, F.when(known, x["kinds"]).otherwise(a["kinds"]), F.when(known, x["lower"]).otherwise(zero), F.when(known, x["lower_once"]).otherwise(zero))

    new = F.log10(F.greatest(F.lit(1), 256 - F.coalesce(F.element_at("path", -1)["kinds"], F.lit(0))))
    start = state(F.lit(0.0), F.lit(True), F.lit(0), F.lit(0), F.lit(0))
    value = F.aggregate("path", start, descend, lambda a: a["value"] - F.when(a["left"], new).otherwise(0.0))
    return paths.select(F.col("w").alias("key"), value.alias("value"))


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and the values of all (0 where it has none)."""
    own, values = table
    if not len(own):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    have = own[at] == keys
    return have, np.where(have, values[at], 0.0)


def score(docs: DataFrame, model: Model, *, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.windows, model.words))
    names = ["r", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "word", "key"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]

    def run(batches):
        often, common = shared.value
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, off, _ = text_bytes(batch.column("text"))
            for i, j in blocks(off):
                part, own = lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i]
                g, at = windows(part, own)
                distinct, where = np.unique(g, return_inverse=True)
                have, value = _look(often, distinct.view(np.uint64))
                bits = np.add.reduceat(value[where], at[:-1])
                open_ = np.flatnonzero(~have[where])
                w = words(part, own)
                h = np.insert(span_hashes(part, w.start, w.end), w.first[1:], END_WORD.view(np.uint64))
                row = np.repeat(np.arange(j - i), w.count + 1)
                found, logs = _look(common, h)
                ids = base + np.arange(j - i)
                base += j - i
                sums = [np.bincount(row, weights=x, minlength=j - i) for x in (found, logs)]
                doc = [pa.array(ids), *(batch.column(c).slice(i, j - i) for c in ("doc_id", "held_out")), pa.array((w.count + 1).astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(bits)]
                yield pa.RecordBatch.from_arrays([*doc, *(pa.nulls(j - i, t) for t in kinds[7:])], names)
                lines = np.searchsorted(at, open_, "right") - 1
                for word, r, k in ((True, row[~found], h[~found].view(np.int64)), (False, lines, g[open_])):
                    for x in range(0, len(k), EMIT):
                        m = len(k[x : x + EMIT])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r[x : x + EMIT]]), *(pa.nulls(m, t) for t in kinds[1:7]), pa.array(np.full(m, word)), pa.array(k[x : x + EMIT])], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    parts = written(rows.mapInArrow(run, "r long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, word boolean, key long"))
    asked = parts.where("word is not null").select("r", "word", "key")
    unseen = asked.where("not word").select("key").distinct().join(model.seen, "key", "left_anti")
    values = model.rest.unionByName(_backed_off(cut(unseen), model).select(F.lit(False).alias("word"), "key", "value"))
    more = asked.join(values, ["word", "key"]).groupBy("r").agg(
        F.count_if("word").alias("more_known"),
        F.sum(F.when(F.col("word"), F.col("value"))).alias("more_logs"),
        F.sum(F.when(~F.col("word"), F.col("value"))).alias("more_score"),
    )
    each = parts.where("word is null").join(more, "r", "left")
    unit = float(np.log10(model.n + model.v + 1))

    def plus(name: str) -> Column:
        return F.col(name) + F.coalesce(f"more_{name.removeprefix('n_')}", F.lit(0))

    base_score = plus("logs") - F.col("n_tokens") * unit
    return each.select("doc_id", "held_out", "n_tokens", plus("n_known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base_score.alias("base_score"), plus("score").alias("score"))
