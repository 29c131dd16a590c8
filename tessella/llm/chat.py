"""Chat formatting on token level: turns become ids with reserved ids between them, and a loss mask.

A turn is ``<|turn|>`` role, ``<|say|>`` or ``<|read|>``, text, ``<|end|>``. Role and text are encoded
on their own, so no token crosses a boundary; the marks are ids above the vocabulary, which no text
encodes to. Text after ``<|say|>`` (the learned role's) is under the loss mask: per batch, prefix sums
over the marks tell how many bodies are open at a token, and of which kind the last one is.

Control strings inside roles and texts (the marks' own and those of common templates, CONTROLS) are
escaped, so the formatted string is safe for other tokenizers too: after a control string's first
character, and the backslashes that follow it, comes one more backslash; reading back takes one away.
A control string with any number of backslashes thus has an image of its own.

Texts are encoded where they are read, before any shuffle, so a long conversation is encoded by many
tasks. Reading a conversation back needs its turns in order; they are streamed through hashes, one
turn at a time, so no conversation is held as a whole.

Edge cases: turns are ordered by turn (null first), then by a hash of role and text; a null role or
text is empty; repeated rows are turns each; an empty text has no tokens; a null conversation id is a
conversation of its own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing

MARKS = ["<|turn|>", "<|say|>", "<|read|>", "<|end|>"]
LEARNED = "assistant"
#: Control strings of common chat templates.
CONTROLS = [
    "<s>", "</s>", "<pad>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>",
]
BATCH = 1 << 18  #: ids in a batch of results
FORMATTED = "conv_id {kind}, turn long, tie binary, ids array<int>, loss array<boolean>"


def _patterns() -> dict[str, str]:
    """A control string's first character → the rest of those that begin with it, as a pattern."""
    rests: dict[str, list[str]] = {}
    for c in dict.fromkeys([*MARKS, *CONTROLS]):
        rests.setdefault(c[0], []).append(re.escape(c[1:]))
    return {first: "|".join(r) for first, r in rests.items()}


_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c)})\\*+(?={rest})" for c, rest in _patterns().items()))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c)})\\(?=\\*+(?:{rest}))" for c, rest in _patterns().items()))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


@lru_cache(1)
def vocabulary(ranks_path: str | None):
    """A function text → ids, one ids → text (marks included), and the first mark's id."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode, _ = packing.tokenizer(path)
    with open(path, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    first = max(pieces) + 2  # one id is left for the vocabulary's own special token
    pieces |= {first + k: mark.encode() for k, mark in enumerate(MARKS)}

    def decode(ids: np.ndarray) -> str:
        return b"".join(map(pieces.__getitem__, ids.tolist())).decode()

    return encode, decode, first


def loss_mask(ids: np.ndarray, first: int) -> np.ndarray:
    """Which ids of whole turns in a row are text after ``<|say|>``, by prefix sums over the marks."""
    say, read, end = (ids == first + k for k in (1, 2, 3))
    opened = np.cumsum(say | read)
    inside = (opened - np.cumsum(end) == 1) & (ids < first)
    kinds = say[say | read]
    return inside & np.append(False, kinds)[opened]


def format_turns(rows: DataFrame, *, ranks_path: str | None = None, learned: str = LEARNED) -> DataFrame:
    """A row per turn of conv_id, turn, role, text: conv_id, turn, tie (orders turns alike), ids and loss.

    A conversation's tokens are its rows' ids by turn (null first) and tie.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        encode, _, first = vocabulary(ranks_path)
        turn, say, read, end = (np.array([first + k], np.int32) for k in range(4))

        def out(held, batch, lo, hi):
            flat, sizes = np.concatenate(held), [sum(map(len, held[k : k + 5])) for k in range(0, len(held), 5)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat, loss_mask(flat, first))]
            columns = [batch.column(c).slice(lo, hi - lo) for c in ("conv_id", "turn", "tie")]
            return pa.RecordBatch.from_arrays([*columns, *lists], ["conv_id", "turn", "tie", "ids", "loss"])

        for batch in batches:
            held, size, lo = [], 0, 0
            for k, (role, text) in enumerate(zip(batch.column("role"), batch.column("text"), strict=True)):
                role, text = role.as_py() or "", text.as_py() or ""
                parts = [turn, encode(escape(role)).astype(np.int32), say if role == learned else read, encode(escape(text)).astype(np.int32), end]
                held += parts
                size += sum(map(len, parts))
                if size >= BATCH:
                    yield out(held, batch, lo, k + 1)
                    held, size, lo = [], 0, k + 1
            if held:
                yield out(held, batch, lo, batch.num_rows)

    whole = F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    tie = F.unhex(F.sha2(whole.cast("binary"), 256))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), tie.alias("tie"), "role", "text").mapInArrow(run, FORMATTED.format(kind=kind))


def read_back(formatted: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """Per conversation of format_turns' result: n_turns, turns_sha256 (role, newline, text, newline per
    turn), loss_chars and loss_sha256 (the unescaped text under the mask), formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        _, decode, first = vocabulary(ranks_path)
        now, held = None, []

        def done():
            held.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def out():
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, columns), strict=True)))

        for batch in batches:
            conv = batch.column("conv_id").to_pylist()
            values = [(np.asarray(batch.column(c).flatten().cast(pa.int32())), np.asarray(batch.column(c).offsets) - batch.column(c).offsets[0].as_py()) for c in ("ids", "loss")]
            for k, name in enumerate(conv):
                if now is None or now[0] != name:
                    if now is not None:
                        done()
                    now = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, loss = (flat[off[k] : off[k + 1]] for flat, off in values)
                begin, body, end = np.flatnonzero(ids >= first).tolist()
                role, text = unescape(decode(ids[begin + 1 : body])), unescape(decode(ids[body + 1 : end]))
                learned = unescape(decode(ids[loss.astype(bool)]))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(decode(ids))
            if len(held) >= 10_000:
                yield out()
        if now is not None:
            done()
        if held:
            yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie").select("conv_id", "ids", "loss")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_test_conversation(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, and of conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, LEARNED, said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def _escapes_sql(column: str) -> str:
    pattern = "|".join(rf"{re.escape(c)}\\*(?:{rest})" for c, rest in _patterns().items()).replace(r"\<", "<").replace(r"\>", ">")
    return f"length({column}) + len(regexp_extract_all({column}, '{pattern}'))"


#: The digests from the rows themselves; formatted_chars by counting what marks and escapes add.
FORMAT_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, sha256(role || chr(10) || text) AS tie FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(CASE role WHEN 'assistant' THEN 22 ELSE 23 END + {_escapes_sql("role")} + {_escapes_sql("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
