"""Quality rules: counts of a text, and a linear-chain CRF that tells content lines from boilerplate.

Every line with a word is an observation (FEATURES); Viterbi decoding marks each as content or
boilerplate, and a document stays if at least ``min_share`` of its words are in content lines. The
CRF is fitted by maximum likelihood on a bounded, hash-chosen sample of labelled documents
(``max_docs``, and at most ``max_lines`` lines of each, in windows spread over it): the lines of good ones are content, those of bad ones and lines that repeat an
earlier one are boilerplate. Counting and decoding are one pass over whole texts without a shuffle.

Edge cases: a null, empty or blank text has counts of 0 and fails the base rules; without labelled
documents of both kinds the CRF marks every line as content; ties go to content; repeated rows are
judged alike; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, blocks, mix, span_hashes, text_bytes, words

MANY = 16  #: documents that are decoded together
FEATURES = ["one", "log_words", "letters", "digits", "symbols", "capitals", "points", "repeats", "word_length", "ends", "short"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_POINT = np.zeros(256, bool)
_POINT[33:127] = True
_POINT &= ~(_LETTER | _DIGIT | _SYMBOL)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Block:
    """Counts per row, and the lines with a word: their row (as offsets), words and features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first_line: np.ndarray
    line_words: np.ndarray
    x: np.ndarray


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[end] - total[start]


def _repeated(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with a hash in rows: which equal an earlier one of their row, and which occur twice or more."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    _, first, inverse, count = np.unique(mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(hashes), bool)
    later[first] = False
    return later, count[inverse] >= 2


def measure(raw: np.ndarray, off: np.ndarray) -> Block:
    n = len(off) - 1
    rows = np.arange(n)
    w: Words = words(raw, off)
    word_row = np.repeat(rows, w.count)
    h = span_hashes(raw, w.start, w.end)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = word_row[:-2] == word_row[2:]
        g = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        at = np.flatnonzero(whole)
        twice = at[_repeated(g[at], word_row[at])[1]]
        covered[twice] = covered[twice + 1] = covered[twice + 2] = True
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([off[1:], breaks]))
    line_row = np.repeat(rows, 1 + np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=n)[:n])
    k = np.searchsorted(w.start, ends) - np.searchsorted(w.start, start)
    has = k > 0
    start, ends, line_row, k = start[has], ends[has], line_row[has], k[has]
    again, _ = _repeated(span_hashes(raw, start, ends), line_row)
    mark = ~_SPACE[raw] & ((raw & 0xC0) != 0x80)
    size = np.maximum(_sums(mark, start, ends), 1)
    share = lambda table: _sums(table[raw] & mark, start, ends) / size
    last = w.end[np.searchsorted(w.start, ends) - 1] - 1 if len(k) else np.zeros(0, int)
    x = np.stack(
        [np.ones(len(k)), np.log1p(k), share(_LETTER), share(_DIGIT), share(_SYMBOL), share(_UPPER), share(_POINT), again.astype(float), size / np.maximum(k, 1) / 10, np.isin(raw[last], [33, 46, 63]).astype(float), (k < 4).astype(float)],
        axis=1,
    )
    return Block(w.count, _sums(mark, off[:-1], off[1:]), _sums(_SYMBOL[raw], off[:-1], off[1:]), np.bincount(line_row[again], minlength=n), _sums(covered, w.first[:-1], w.first[1:]), np.searchsorted(line_row, np.arange(n + 1)), k, x)


@dataclass
class Crf:
    """Scores of marking a line as boilerplate: weights of its features; of marks in a row: steps[from][to]."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, x: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """The likeliest marks (True: boilerplate) of documents' lines; first: the documents' offsets in x."""
        first = np.array([0, len(x)]) if first is None else first
        own = x @ self.weights
        marks = np.zeros(len(x), bool)
        order = np.argsort(first[:-1] - first[1:], kind="stable")  # longest first: those still going are a prefix
        start, size = first[:-1][order], np.diff(first)[order]
        going = np.searchsorted(-size, -np.arange(1, 1 + (size[0] if len(size) else 0)), "right")
        many = int((going >= MANY).sum())  # so many lines of all documents at once, then what is left one by one
        (s00, s01), (s10, s11) = self.steps.tolist()
        n = going[0] if len(going) else 0
        a, b = np.zeros(n), own[start[:n]]
        back0, back1 = np.zeros(len(x), bool), np.zeros(len(x), bool)  # whether the mark before was boilerplate
        for k in range(1, many):
            n = going[k]
            at, a0, b0 = start[:n] + k, a[:n], b[:n]
            back0[at], back1[at] = a0 + s00 < b0 + s10, a0 + s01 <= b0 + s11
            a[:n], b[:n] = np.maximum(a0 + s00, b0 + s10), np.maximum(a0 + s01, b0 + s11) + own[at]
        for r in np.flatnonzero(size > max(many, 1)):
            p, q = start[r], start[r] + size[r]
            e, f, g = own[p + max(many, 1) : q].tolist(), float(a[r]), float(b[r])
            to0, to1 = [], []
            for v in e:
                to0.append(f + s00 < g + s10)
                to1.append(f + s01 <= g + s11)
                f, g = max(f + s00, g + s10), max(f + s01, g + s11) + v
            back0[p + max(many, 1) : q], back1[p + max(many, 1) : q] = to0, to1
            a[r], b[r] = f, g
        last = b > a
        for r in np.flatnonzero(size > max(many, 1)):
            mark, own0, own1, out = bool(last[r]), back0[start[r] : start[r] + size[r]].tolist(), back1[start[r] : start[r] + size[r]].tolist(), []
            for k in range(size[r] - 1, max(many, 1) - 1, -1):
                out.append(mark)
                mark = own1[k] if mark else own0[k]
            marks[start[r] + max(many, 1) : start[r] + size[r]] = out[::-1]
            last[r] = mark
        for k in range(min(many, len(going)) - 1 if many else 0, -1, -1):
            n = going[k] if len(going) else 0
            at = start[:n] + k
            marks[at] = last[:n]
            last[:n] = np.where(last[:n], back1[at], back0[at])
        return marks


def fit_crf(sequences: list[tuple[np.ndarray, np.ndarray]], *, rounds: int = 150, ridge: float = 1e-3, window: int = 64) -> Crf:
    """Maximum likelihood by gradient ascent (Adam) with forward-backward over padded sequences.

    sequences: features and marks of each document's lines; longer ones are used in windows.
    """
    parts = [(x[k : k + window], y[k : k + window]) for x, y in sequences for k in range(0, len(x), window)]
    width = len(FEATURES)
    if not parts or len({bool(v) for _, y in parts for v in y}) < 2:
        return Crf(np.eye(width)[0] * -8.0, np.zeros((2, 2)))
    m, most = len(parts), max(len(x) for x, _ in parts)
    x, y, on = np.zeros((m, most, width)), np.zeros((m, most), int), np.zeros((m, most), bool)
    for k, (a, b) in enumerate(parts):
        x[k, : len(a)], y[k, : len(a)], on[k, : len(a)] = a, b, True
    both = on[:, 1:]
    total = on.sum()
    seen_x = (x * (y * on)[:, :, None]).sum((0, 1))
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (y[:, :-1][both], y[:, 1:][both]), 1)
    theta, m1, m2 = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, rounds + 1):
        w, s = theta[:width], theta[width:].reshape(2, 2)
        e = np.stack([np.zeros((m, most)), x @ w], axis=2)
        f, b = np.zeros((m, most, 2)), np.zeros((m, most, 2))
        f[:, 0] = e[:, 0]
        for k in range(1, most):
            f[:, k] = np.where(on[:, k, None], np.logaddexp(f[:, k - 1, :1] + s[0], f[:, k - 1, 1:] + s[1]) + e[:, k], f[:, k - 1])
        for k in range(most - 2, -1, -1):
            nxt = b[:, k + 1] + e[:, k + 1]
            b[:, k] = np.where(on[:, k + 1, None], np.logaddexp(nxt[:, :1] + s[:, 0], nxt[:, 1:] + s[:, 1]), 0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None]) * on[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + s + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate([seen_x - (x * p[:, :, 1:]).sum((0, 1)), (seen_steps - pair.sum((0, 1))).ravel()]) / total - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += 0.2 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Crf(theta[:width], theta[width:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 2000, max_lines: int = 2048) -> Crf:
    """Fits on about ``max_docs`` labelled documents, half of each quality (chosen by a hash of doc_id).

    Their lines' features go to the driver (of longer documents, windows of 64 lines at equal
    distances, ``max_lines`` in all): the bounded sample, nothing of the other documents.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    sizes = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return fit_crf([])
    point = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("bad"), F.lit(max_docs / 2 / sizes[True])).otherwise(F.lit(max_docs / 2 / sizes[False]))
    chosen = F.broadcast(known.where(point < share).dropDuplicates(["doc_id"]).limit(4 * max_docs))
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")

    def lines(batches):
        for batch in batches:
            raw, off, _ = text_bytes(batch.column("text"))
            b = measure(raw, off)
            parts = []
            for i, j in zip(b.first_line[:-1], b.first_line[1:], strict=True):
                if j - i > max_lines:
                    starts = np.linspace(i, j - 64, max(1, max_lines // 64)).astype(int)
                    parts.append(b.x[(starts[:, None] + np.arange(64)).ravel()].astype(np.float32).tobytes())
                else:
                    parts.append(b.x[i:j].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bad"), pa.array(parts, pa.binary())], ["doc_id", "bad", "x"])

    table = rows.select("doc_id", "bad", "text").mapInArrow(lines, "doc_id long, bad boolean, x binary").toArrow().sort_by("doc_id")
    repeats = FEATURES.index("repeats")
    sequences = []
    for bad, x in zip(table["bad"].to_pylist(), table["x"].to_pylist(), strict=True):
        x = np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float)
        if len(x):
            sequences.append((x, np.ones(len(x), int) if bad else (x[:, repeats] > 0).astype(int)))
    return fit_crf(sequences)


def judge(docs: DataFrame, crf: Crf, *, min_share: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, content_share and kept of every row."""

    def run(batches):
        for batch in batches:
            raw, off, _ = text_bytes(batch.column("text"))
            for i, j in blocks(off):
                b = measure(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                content = np.where(crf.decode(b.x, b.first_line), 0, b.line_words)
                share = _sums(content, b.first_line[:-1], b.first_line[1:]) / np.maximum(_sums(b.line_words, b.first_line[:-1], b.first_line[1:]), 1)
                failed = (b.n_words < min_words) | (100 * b.n_repeat_words > most_repeated * b.n_words)
                counts = [pa.array(v.astype(np.int64)) for v in (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *counts, pa.array(failed), pa.array(share), pa.array(~failed & (share >= min_share))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
