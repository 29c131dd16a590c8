"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Fault flags come from windows (adjacent initials, a role and text seen before). A conversation's
turns are collected in order and folded by ``aggregate``: the accumulator holds four (cost, audit)
structs, one for each thing that the roles so far can end in (nothing, system, user, assistant), and
``least`` on structs takes the cheaper one, of equal costs the least audit. That is exact: audits of
equal cost over the same turns are never prefixes of each other, since the letters alone fix the cost.
Edits are I (insert a turn), K (keep), R (set the role) and D (delete), with the prices below; the
roles must read ``(s?(ua)+)?`` by their initials.

Conversations above LONG turns or CHARS characters don't go to one row. Their turns are sorted over
key ranges, cut into parts of at most LONG turns and folded part by part from each of the four
states; the parts' tables of four by four structs are then joined in order, which costs a row per
part. Their repaired text is hashed as a stream over sorted rows, so it is in no row as a whole (its
audit is: one letter a turn, like in the result).

Edge cases: turns are ordered by turn (null first), then role and text; a null role or text is one
space; a turn is blank if it has no character but white space; a conversation without turns, or with
none that stay, costs what its deletions cost and has an empty text; a null conversation id is a
conversation of its own; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, shuffle_partitions, small

LONG, CHARS = 1024, 1 << 22
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES = ["none", "system", "user", "assistant"]
PAIR = "struct<cost:bigint,audit:string>"
SPACE = " \t\n\x0b\x0c\r"
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _then(state: Column, cost: Column | int, letter: str) -> Column:
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit")))


def _states(*states: Column) -> Column:
    return F.struct(*[s.alias(name) for s, name in zip(states, STATES, strict=True)])


def _start(at: str) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _states(*[zero if s == at else F.lit(None).cast(PAIR) for s in STATES])


def _with_inserts(a: Column) -> Column:
    """The states after at most two insertions (more only make pairs that change nothing)."""
    user = F.least(a["user"], *[_then(a[s], INSERT, "I") for s in ("none", "system", "assistant")])
    return _let(user, lambda u: _states(a["none"], a["system"], u, F.least(a["assistant"], _then(u, INSERT, "I"))))


def _edited(a: Column, turn: Column) -> Column:
    """The states after keeping, reroling or deleting one turn."""
    extra = F.when(turn["fault"] == TRUNCATED_FAULT, TRUNCATED).otherwise(0)
    stays = turn["fault"].isin(0, TRUNCATED_FAULT)

    def kept(state: Column, initial: str) -> Column:
        return F.when(stays & (turn["initial"] == initial), _then(state, extra, "K"))

    def reroled(state: Column) -> Column:
        return F.when(stays, _then(state, extra + REROLE, "R"))

    def deleted(state: Column) -> Column:
        return _then(state, DELETE, "D")

    before_user = F.least(a["none"], a["system"], a["assistant"])
    return _states(
        deleted(a["none"]), F.least(deleted(a["system"]), kept(a["none"], "s")),
        F.least(deleted(a["user"]), kept(before_user, "u"), reroled(before_user)), F.least(deleted(a["assistant"]), kept(a["user"], "a"), reroled(a["user"])),
    )


def fold(turns: Column, start: str = "none") -> Column:
    """The four (cost, audit) structs after all turns (structs with fault and initial), from one state."""
    return F.aggregate(turns, _start(start), lambda acc, x: _let(_with_inserts(acc), lambda a: _edited(a, x)))


def cheapest(states: Column) -> Column:
    """The cheaper of the two states in which a conversation may end, insertions at its end included."""
    return _let(_with_inserts(states), lambda a: F.least(a["none"], a["assistant"]))


def _joined(states: Column, part: Column) -> Column:
    """states, then a part's states from each start."""

    def pair(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")))

    return _states(*[F.least(*[pair(states[s], part[s][to]) for s in STATES]) for to in STATES])


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by a hash of conversation and turn; a dropped row stays with live = false."""
    text, name = F.coalesce("text", F.lit(" ")), F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(name.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", fate.alias("fate"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _illegal(before: Column, initial: Column) -> Column:
    return before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")


def _fault(seen: Column) -> Column:
    """seen: the role and text came earlier."""
    left = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.when(left == "", BLANK_FAULT).when(seen, DUPLICATE_FAULT).when(~F.substring(left, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0)


def _gaps(turns: Column) -> Column:
    return F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(F.array_compact(turns))), F.lit(0))


def _number(fault: int) -> Column:
    return F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")


def _text() -> Column:
    """The repaired ``role:text`` lines of turns and audit."""
    edits = F.regexp_extract_all(F.col("audit"), F.lit("I*[KRD]"), F.lit(0))
    none = F.lit(None).cast("string")
    made = F.struct(none.alias("role"), F.lit("").alias("text"))

    def result(turn: Column, edit: Column) -> Column:
        own = F.struct(F.when(edit.endswith("K"), turn["role"]).alias("role"), turn["text"].alias("text"))
        return F.concat(F.array_repeat(made, F.length(edit) - 1), F.when(edit.endswith("D"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(own)))

    tail = F.array_repeat(made, F.length(F.regexp_extract("audit", "(I*)\\z", 1)))
    lines = F.concat(F.flatten(F.zip_with("turns", edits, result)), tail)

    def line(x: Column, i: Column, first: Column) -> Column:
        role = F.when((i + F.when(F.coalesce(first["role"].startswith("s"), F.lit(False)), 1).otherwise(0)) % 2 == 0, "user").otherwise("assistant")
        return F.concat(F.coalesce(x["role"], role), F.lit(":"), x["text"])

    return _let(lines, lambda all_: F.array_join(F.transform(all_, lambda x, i: line(x, i, F.get(all_, F.lit(0)))), "\n"))


def _short(rows: DataFrame) -> DataFrame:
    """Every conversation in one row."""
    rows = rows.repartition("k").withColumn("initial", F.substring("role", 1, 1))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("k", "live").orderBy(*_order())))
    rows = rows.withColumn("before", F.lag("initial").over(Window.partitionBy("k", "live").orderBy("at")))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("k", "live", "role", "text").orderBy("at")) > 1)
    turn = F.struct("at", "turn", "role", "text", "initial", _fault(F.col("seen")).alias("fault"), _illegal(F.col("before"), F.col("initial")).alias("illegal"))
    whole = rows.groupBy("k", "conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("live"), turn))).alias("turns"))
    whole = whole.withColumn("best", cheapest(fold(F.col("turns")))).withColumns({"cost": F.col("best.cost"), "audit": F.col("best.audit")})
    return whole.select(
        "conv_id", _gaps(F.transform("turns", lambda t: t["turn"])).cast("long").alias("gaps"), _number(BLANK_FAULT).alias("blank"), _number(DUPLICATE_FAULT).alias("duplicate"), _number(TRUNCATED_FAULT).alias("truncated"),
        F.size(F.filter("turns", lambda t: t["illegal"])).cast("long").alias("illegal"), "cost", "audit", F.sha2(_text().cast("binary"), 256).alias("repaired_sha256"),
    )


def _streamed(batches):
    """k and the hash of the repaired lines, from (k, edit, role, text) in order; holds one line at a time."""
    state = {"k": None, "hash": None, "first": True, "shift": 0, "n": 0}

    def add(role: str | None, text: str) -> None:
        if state["n"] == 0 and role is not None and role[:1] == "s":
            state["shift"] = 1
        line = f"{role if role is not None else ('user', 'assistant')[(state['n'] + state['shift']) % 2]}:{text}"
        state["hash"].update((("\n" if state["n"] else "") + line).encode())
        state["n"] += 1

    def done():
        return pa.RecordBatch.from_pydict({"k": [state["k"]], "repaired_sha256": [state["hash"].hexdigest()]})

    for batch in batches:
        for k, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "edit", "role", "text")), strict=True):
            if k != state["k"]:
                if state["hash"]:
                    yield done()
                state.update(k=k, hash=hashlib.sha256(), shift=0, n=0)
            for letter in edit:
                if letter == "I":
                    add(None, "")
                elif letter != "D":
                    add(role if letter == "K" else None, text)
    if state["hash"]:
        yield done()


def _in_parts(rows: DataFrame, part_rows: int) -> DataFrame:
    """The same for conversations of any length."""
    n = shuffle_partitions(rows.sparkSession)
    live = rows.where("live").withColumn("initial", F.substring("role", 1, 1))
    # equal beginnings of texts lie in one range, so sorting by whole texts within it is sorting by whole texts
    ranged = live.repartitionByRange(n, "k", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)).sortWithinPartitions("k", *_order())
    placed = cut(ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)))
    first = placed.groupBy("k", "role", "sha").agg(F.min("pos").alias("first_pos"))
    flagged = placed.join(first, ["k", "role", "sha"]).withColumn("fault", _fault(F.col("pos") > F.col("first_pos")))
    # a position is a range's number and a row's number in it
    flagged = flagged.withColumns({"range": F.shiftright("pos", 33), "part": F.expr(f"(pos & {(1 << 33) - 1}) div {part_rows}")})
    parts = flagged.groupBy("k", "range", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("turns"))
    pairs = F.zip_with(F.slice("turns", F.lit(1), F.size("turns") - 1), F.slice("turns", F.lit(2), F.size("turns")), lambda a, b: _illegal(a["initial"], b["initial"]))
    parts = cut(parts.select(
        "k", "range", "part", F.col("turns")[0]["pos"].alias("begins"), F.size("turns").cast("long").alias("n"), F.col("turns")[0]["initial"].alias("head"), F.element_at("turns", -1)["initial"].alias("tail"),
        _number(BLANK_FAULT).alias("blank"), _number(DUPLICATE_FAULT).alias("duplicate"), _number(TRUNCATED_FAULT).alias("truncated"), F.size(F.filter(pairs, lambda p: p)).cast("long").alias("illegal"),
        F.struct(*[fold(F.col("turns"), s).alias(s) for s in STATES]).alias("table"),
    ))
    in_order = Window.partitionBy("k").orderBy("begins")
    parts = parts.withColumns({"illegal": F.col("illegal") + F.coalesce(_illegal(F.lag("tail").over(in_order), F.col("head")).cast("long"), F.lit(0)), "offset": F.sum("n").over(in_order) - F.col("n")})
    whole = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.sort_array(F.collect_list(F.struct("begins", "table"))).alias("tables"))
    best = cheapest(F.aggregate("tables", _start("none"), lambda acc, x: _joined(acc, x["table"])))
    whole = cut(whole.withColumn("best", best).drop("tables"))
    edits = whole.select("k", F.posexplode(F.regexp_extract_all(F.col("best.audit"), F.lit("I*[KRD]|I+\\z"), F.lit(0))).alias("g", "edit"))
    numbered = flagged.join(parts.select("k", "range", "part", "begins", "offset"), ["k", "range", "part"]).select("k", (F.col("offset") + F.col("pos") - F.col("begins")).alias("g"), "role", "text")
    lines = edits.withColumn("g", F.col("g").cast("long")).join(numbered, ["k", "g"], "left").select("k", "g", "edit", "role", "text")
    hashes = lines.repartition("k").sortWithinPartitions("k", "g").drop("g").mapInArrow(_streamed, "k string, repaired_sha256 string")
    spread = live.where("turn is not null").groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ids = rows.groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(whole, "k", "left").join(spread, "k", "left").join(hashes, "k", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    return out.select("conv_id", *numbers, F.coalesce("best.cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, *, long: int = LONG, chars: int = CHARS) -> DataFrame:
    """rows: conv_id, turn, role, text and live (false: only the conversation's id counts).

    Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (the repaired ``role:text``, joined by newlines).
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "live")
    rows = rows.withColumn("k", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    hot = cut(sizes.where((F.col("n") > long) | (F.col("chars") > chars)).select("k"))
    if hot.isEmpty():
        return _short(rows)
    hot = small(hot)
    return _short(rows.join(hot, "k", "left_anti")).unionByName(_in_parts(rows.join(hot, "k", "left_semi"), long))


def _then_sql(state: str, cost: str, letter: str) -> str:
    """States as text: 12 digits of cost, then the audit; so least() orders them."""
    return f"lpad(CAST(CAST(substr({state}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}, 13) || '{letter}'"


_USER = f"least({_then_sql('o', '5', 'I')}, {_then_sql('s', '5', 'I')}, {_then_sql('a', '5', 'I')}, u)"

#: The same with a recursive fold, a turn of all conversations at a time, and one more for the repaired text.
REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b:
    xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, range(8)), lambda t, i: xor(t >> 1, (t & 1) * 3988292384)))), 4294967295) % 20 AS fate FROM raw),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, substr(role, 1, 1) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM d),
f AS (SELECT *, CASE WHEN kept = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN kept[-1:] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal FROM n),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal, count(f.pos) AS n FROM ids LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
steps(conv_id, pos, n, o, s, u, a) AS (
    SELECT conv_id, CAST(0 AS BIGINT), n, lpad('', 12, '0'), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM counts
    UNION ALL
    SELECT conv_id, pos, n, {_then_sql("o", "2", "D")},
        least({_then_sql("s", "2", "D")}, CASE WHEN stays AND i = 's' THEN {_then_sql("o", "extra", "K")} END),
        least({_then_sql("u", "2", "D")}, CASE WHEN stays AND i = 'u' THEN {_then_sql("before_user", "extra", "K")} END, CASE WHEN stays THEN {_then_sql("before_user", "extra + 1", "R")} END),
        least({_then_sql("a", "2", "D")}, CASE WHEN stays AND i = 'a' THEN {_then_sql("u", "extra", "K")} END, CASE WHEN stays THEN {_then_sql("u", "extra + 1", "R")} END)
    FROM (SELECT *, least(o, s, a) AS before_user FROM (SELECT *, least(a0, {_then_sql("u", "5", "I")}) AS a FROM (
        SELECT t.conv_id, t.pos + 1 AS pos, t.n, t.o, t.s, t.a AS a0, {_USER.replace("substr(o,", "substr(t.o,").replace("substr(s,", "substr(t.s,").replace("substr(a,", "substr(t.a,").replace(", u)", ", t.u)")} AS u,
            f.i, f.fault IN (0, 3) AS stays, CASE f.fault WHEN 3 THEN 5 ELSE 0 END AS extra
        FROM steps t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.pos = t.pos + 1)))),
best AS (SELECT conv_id, n, least(o, least(a, {_then_sql("u1", "5", "I")})) AS best FROM (SELECT *, {_USER} AS u1 FROM steps WHERE pos = n)),
edits AS (SELECT conv_id, n, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM best),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS p FROM edits WHERE audit <> ''),
placed AS (SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS pos FROM letters),
lines AS (SELECT l.conv_id, l.p, CASE l.letter WHEN 'K' THEN f.role END AS role, CASE l.letter WHEN 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.p) - 1 AS line
    FROM placed l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos WHERE l.letter <> 'D'),
shifts AS (SELECT conv_id, CASE WHEN role LIKE 's%' THEN 1 ELSE 0 END AS shift FROM lines WHERE line = 0),
texts AS (SELECT l.conv_id, sha256(string_agg(coalesce(l.role, CASE (l.line + h.shift) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END) || ':' || l.text, chr(10) ORDER BY l.line)) AS sha
    FROM lines l JOIN shifts h ON h.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY l.conv_id)
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, e.cost, e.audit, coalesce(t.sha, sha256('')) AS repaired_sha256
FROM counts c JOIN edits e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
