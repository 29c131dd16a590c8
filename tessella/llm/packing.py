"""Packing token streams into windows by order-preserving dynamic programming.

Each partition's documents, in the order in which they are read, form a stream of token ids; it is
packed block by block (about BLOCK tokens: whole documents, and parts of BLOCK tokens of longer ones). Within a block the cuts are chosen
among document ends (free), sentence ends (SENTENCE) and, in stretches without either, every STRIDE
tokens (INSIDE), so that padding plus these penalties is least. With f(j) the least cost of cutting
at position p(j), f(j) = penalty(j) + min over windows of f(i) + size - (p(j) - p(i)); the minimum
of f(i) + p(i) over the last ``size`` tokens is kept in a monotone queue. Windows of 128, 256 or
512 tokens need no padding and are looked up on their own. There is no shuffle; a partition adds
less than one window of padding of its own.

Ids are those of the ``tokenizers`` file byte_bpe_50k.json with add_special_tokens=False. The same
vocabulary's tiktoken form gives them three times faster (the tests compare both). Texts go to it in
parts of about PART characters that begin where a pre-token does in any case: at the special token's
own string, at white space after another character, and at both ends of a long run of white space,
which the pattern can't match at once.

Edge cases: a null or empty text is its end token alone; a longer text than a window or a block is
cut into several pieces; a run of white space of any length is tokenized like any other; repeated rows are packed as often as they occur; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK, STRIDE = 1024, 1 << 20, 256
SENTENCE, INSIDE, SHORT = 6, 64, 16
PART, RUN = 1 << 20, 10_000
SPECIAL, END = "<|endoftext|>", 0
_LONG_RUN = regex.compile(r"\p{White_Space}{%d,}" % RUN)
_BREAK = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")


@lru_cache(1)
def tokenizer(ranks_path: str):
    """A function text → ids, and per id whether its string ends a sentence."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # the pattern gives such a run whole; a pattern without look-ahead matches runs of any length
    runs = tiktoken.Encoding("byte_bpe_runs", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    special = np.array([max(ranks.values()) + 1], np.uint32)
    ends = np.zeros(max(ranks.values()) + 2, bool)
    for piece, k in ranks.items():
        ends[k] = piece.rstrip(b" ")[-1:] in (b".", b"!", b"?") or b"\n" in piece

    def parts(text: str):
        """Encoding and pieces of a text without the special token."""
        at = 0
        for m in _LONG_RUN.finditer(text) if len(text) >= RUN else ():
            # before a further character the pattern leaves a run's last space to the next pre-token
            end = m.end() if m.end() == len(text) else m.end() - 1
            yield own, text[at : m.start()]
            yield runs, text[m.start() : end]
            at = end
        while len(text) - at > PART and (m := _BREAK.search(text, at + PART)):
            yield own, text[at : m.start()]
            at = m.start()
        yield own, text[at:]

    def encode(text: str) -> np.ndarray:
        out = []
        for k, plain in enumerate(text.split(SPECIAL)):
            out += [special] if k else []
            out += [np.array(how.encode_ordinary(part), np.uint32) for how, part in parts(plain) if part]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    return encode, ends


def cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = WINDOW) -> list[int]:
    """Window ends for a stream of doc_ends[-1] tokens. Both arrays: positions after a token, rising."""
    total = int(doc_ends[-1])
    cost = np.full(total + 1, -1, np.int32)
    cost[sentence_ends] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    for p, g in zip(at[:-1][gap > STRIDE], gap[gap > STRIDE], strict=True):
        more = np.arange(p + STRIDE, p + g, STRIDE)
        cost[more] = INSIDE
    at = np.flatnonzero(cost >= 0)
    pos, penalty = at.tolist(), cost[at].tolist()
    index = np.full(total + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    short = [np.where(at >= s, index[np.maximum(at - s, 0)], -1).tolist() for s in (128, 256, 512) if s < size]
    best, back = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p(i), i), rising
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        least, i = queue[0]
        least += size - p
        for options in short:
            k = options[j]
            if k >= 0 and best[k] + SHORT < least:
                least, i = best[k] + SHORT, k
        best[j], back[j] = least + penalty[j], i
        value = best[j] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def _pack(held: list[tuple[int, int, int, np.ndarray]], base: int, is_end: np.ndarray):
    """held: of each (part of a) document in order: its id, the tokens of it before the part, all its tokens, the part's ids."""
    ids, before, whole = (np.array([h[k] for h in held], object if k == 0 else np.int64) for k in range(3))
    stream = np.concatenate([h[3] for h in held])
    doc_ends = np.cumsum([len(h[3]) for h in held])
    window_ends = np.array(cuts(doc_ends, np.flatnonzero(is_end[stream]) + 1))
    ends = np.union1d(doc_ends, window_ends)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, "right")
    window = np.searchsorted(window_ends, starts, "right")
    doc_start = np.concatenate([[0], doc_ends[:-1]])
    window_start = np.concatenate([[0], window_ends[:-1]])
    raw = stream.astype("<u4")
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    columns = [pa.array(ids[doc].tolist(), pa.int64()), pa.array(starts - doc_start[doc] + before[doc]), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(whole[doc]), pa.array(base + window), pa.array(starts - window_start[window])]
    return len(window_ends), pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ranks_path: the vocabulary; by default the one that public_tokenizers names.
    """

    def run(batches):
        import public_tokenizers

        encode, is_end = tokenizer(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        base, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for i, text in zip(batch.column("i").to_pylist(), batch.column("text"), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END))
                for k in range(0, len(tokens), BLOCK):
                    held.append((i, k, len(tokens), tokens[k : k + BLOCK]))
                    size += len(held[-1][3])
                    if size >= BLOCK:
                        used, out = _pack(held, base, is_end)
                        yield out
                        base, held, size = base + used, [], 0
        if held:
            yield _pack(held, base, is_end)[1]

    rows = docs.select(F.col("doc_id").cast("long").alias("i"), "text")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
