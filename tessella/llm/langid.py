"""Language ID by hierarchical discrimination: family first, then close relatives by pairwise SVMs.

A text becomes one vector of hashed byte trigrams over its letters (square-rooted, unit length). One
linear SVM per pair of families votes for the family; one per pair of languages inside the winning
family votes for the language. Fitting takes a bounded, hash-chosen sample of labelled rows
(``max_rows`` in all); prediction is one pass over whole texts without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; an empty table gives an
empty result; a language seen in fitting whose code has no listed family is a family of its own, or,
beyond ALONE of them, in a family that is learned from the languages' mean vectors (halved until each
has at most MEMBERS), so the number of pairs grows little faster than that of languages; with a single learned language every text with a letter gets it, with score 1; with none learned
every text is ``und``. Repeated rows are predicted alike; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import blocks, text_bytes

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"],
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

ALONE, MEMBERS = 12, 24
DIM = 2048
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def vectors(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row per text: the square roots of its hashed letter trigrams' counts, scaled to unit length."""
    n = len(off) - 1
    out = np.zeros((n, DIM), np.float32)
    if len(raw) >= 3:
        b = _FOLD[raw].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA77) + b[2:]
        h = ((h * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(off))
        use = (row[:-2] == row[2:]) & ((b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32))
        counts = np.bincount(row[:-2][use] * DIM + h[use], minlength=n * DIM)
        out = np.sqrt(counts.reshape(n, DIM).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge loss; y is -1 or 1.

    Classes weigh alike whatever their sizes. Accelerated gradient descent with a fixed step.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    step = 1 / (1e-3 + 2 * float((weight * (x * x).sum(1)).sum()))
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (1e-3 * v - 2 * ((weight * slack * y) @ x))
        v, w = new + t / (t + 3) * (new - w), new
    return w.astype(np.float32)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    family_pairs: list[tuple[str, str, np.ndarray]] = field(default_factory=list)
    lang_pairs: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)
    family_of: dict[str, str] = field(default_factory=dict)

    def families(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for lang in self.langs:
            out.setdefault(self.family_of.get(lang, FAMILY.get(lang, lang)), []).append(lang)
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each vector."""
        families = self.families()
        family, sure = _duel(x, list(families), self.family_pairs)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for k, (name, langs) in enumerate(families.items()):
            at = np.flatnonzero(family == k)
            if len(at):
                best, own = _duel(x[at], langs, self.lang_pairs.get(name, []))
                lang[at] = np.array(langs, object)[best]
                score[at] = np.minimum(sure[at], own)
        return lang, score


def _duel(x: np.ndarray, names: list[str], pairs: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """By pairwise votes (ties by summed margins, then by name order): the winner's index, and a score from its least margin."""
    if len(names) < 2:
        return np.zeros(len(x), int), np.ones(len(x))
    votes, margins, least = (np.zeros((len(x), len(names))) for _ in range(3))
    least += np.inf
    for a, b, w in pairs:
        i, j = names.index(a), names.index(b)
        m = x @ w[:-1] + w[-1]
        votes[:, i] += m > 0
        votes[:, j] += m <= 0
        for k, s in ((i, m), (j, -m)):
            margins[:, k] += s
            least[:, k] = np.minimum(least[:, k], s)
    best = np.argmax(votes + 1e-3 * np.tanh(margins / len(names)), axis=1)
    return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -20, 20)))


def _one_vs_one(x: np.ndarray, y: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    out = []
    for a, b in combinations(sorted(set(y)), 2):
        at = (y == a) | (y == b)
        out.append((a, b, svm(x[at], np.where(y[at] == a, 1.0, -1.0))))
    return out


def _halves(x: np.ndarray) -> np.ndarray:
    """Which of two groups each row is in, by 2-means from the first row and the one farthest from it; halves by order if one is empty."""
    c = x[[0, int(np.argmin(x @ x[0]))]]
    for _ in range(10):
        own = np.argmax(x @ c.T, axis=1)
        if not 0 < own.sum() < len(x):
            return (np.arange(len(x)) >= len(x) / 2).astype(int)
        c = np.array([x[own == k].mean(0) for k in (0, 1)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    own = np.argmax(x @ c.T, axis=1)
    return own if 0 < own.sum() < len(x) else (np.arange(len(x)) >= len(x) / 2).astype(int)


def _family_of(x: np.ndarray, y: np.ndarray) -> dict[str, str]:
    """Every language's family: listed, its own, or learned."""
    langs = sorted(set(y))
    out = {v: FAMILY.get(v, v) for v in langs}
    others = [v for v in langs if v not in FAMILY]
    if len(others) > ALONE:
        mean = np.array([x[y == v].mean(0) for v in others])
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        waiting, done = [np.arange(len(others))], []
        while waiting:
            at = waiting.pop()
            if len(at) <= MEMBERS:
                done.append(at)
            else:
                own = _halves(mean[at])
                waiting += [at[own == 0], at[own == 1]]
        out |= {others[k]: f"learned {others[int(at.min())]}" for at in done for k in at}
    return out


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 2000, max_langs: int = 1000) -> Model:
    """Fits on labelled rows: those with a text and a language, at most about ``max_rows`` of them.

    Rows are chosen by a hash of their key, as many of each language as the bound allows, so the
    sample doesn't depend on partitions or reruns. A table with more than ``max_langs`` languages is
    refused: a thousand have some 12,000 SVMs of 8 KB. The sample's vectors (8 KB each) go to the driver.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Model()
    share = max_rows / len(sizes)
    keep = F.create_map(*[F.lit(v) for name, n in sorted(sizes.items()) for v in (name, min(1.0, share / n))])
    point = F.pmod(F.xxhash64(F.col("k"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    table = rows.where(point < keep[F.col("l")]).mapInArrow(_sample, "k string, l string, v binary").toArrow().sort_by([("l", "ascending"), ("k", "ascending")])
    y = np.array(table["l"].to_pylist(), object)
    if not len(y):
        return Model()
    x = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(-1, DIM)
    family_of = _family_of(x, y)
    family = np.array([family_of[v] for v in y], object)
    model = Model(sorted(set(y)), _one_vs_one(x, family), family_of=family_of)
    for name in sorted(set(family)):
        at = family == name
        model.lang_pairs[name] = _one_vs_one(x[at], y[at])
    return model


def _sample(batches):
    for batch in batches:
        raw, off, _ = text_bytes(batch.column("t"))
        x = vectors(raw, off)
        yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("l"), pa.array([v.tobytes() for v in x], pa.binary())], ["k", "l", "v"])


def predict(docs: DataFrame, model: Model, *, key: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: its key (as the given columns), lang_pred and score. Only the text is used."""

    def run(batches):
        for batch in batches:
            col = batch.column("__text")
            raw, off, null = text_bytes(col)
            lang, score = np.full(len(col), "und", object), np.zeros(len(col))
            for i, j in blocks(off):
                part, own = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                if model.langs:
                    lang[i:j], score[i:j] = model.predict(vectors(part, own))
                # most texts have an ASCII letter; only the others are searched one by one
                letters = np.concatenate([[0], np.cumsum((part < 128) & (_FOLD[part] != 32))])
                for k in i + np.flatnonzero(letters[own[1:]] == letters[own[:-1]]):
                    if null[k] or not _LETTER.search(col[int(k)].as_py()):
                        lang[k] = "und"
            score[lang == "und"] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(key, F.col(text).alias("__text"))
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"]))


def keep_identified(docs: DataFrame, model: Model, *, min_score: float = 0.2) -> DataFrame:
    """The rows, unchanged, whose language is told: not ``und`` and with at least ``min_score``."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("__t"))
    return predict(rows, model, key="row", text="__t").where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")
