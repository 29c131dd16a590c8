"""Secret scans, in DataFrame functions only.

Fixed patterns give the base spans (assign, access, hex). The method adds spans of kind ``markov``:
runs of 16 or more token characters that no base span touches and that a first-order character
Markov model of random strings explains better than one of ordinary identifiers, by a log-likelihood
ratio of at least ``least`` nats. Both models are trained from labelled samples: random strings are
the secrets that the base patterns find plus strings made from hashes; ordinary ones are the words
of letters, ``_`` and ``-``, and the numbers, in a bounded, hash-chosen sample of documents. The trained model is one
number per pair of characters (about 4,300), whatever the corpus.

Positions count code points, ends exclusive: a text split at a pattern's matches gives the gaps, and
running sums of gaps and matches give the positions.

Edge cases: a null text is empty (no spans); repeated rows are scanned alike; an empty table trains
on the made strings alone and gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _blocks(values: Column) -> Column:
    """An array in parts of about the root of its size, at least 64: folds that copy what they gathered stay in a part."""

    def cut(v: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

    return F.transform(F.array(values), cut)[0]  # values are computed once


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end, value (the group's text) of a pattern's matches, leftmost and non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.zip_with(found, value, lambda x, v: F.struct(F.length(x).alias("n"), v.alias("v"))), lambda g, x: F.struct(F.length(g).alias("gap"), x["n"].alias("n"), x["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # positions within each part, then the parts' own
    parts = F.transform(_blocks(steps), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), add))
    first = F.array().cast("array<struct<at:int,out:array<struct<start:int,end:int,value:string>>>>")

    def place(acc, part):
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), part["out"].alias("out")))).alias("out"))

    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), first.alias("out")), place, lambda acc: acc["out"])
    moved = F.transform(placed, lambda p: F.transform(p["out"], lambda x: F.struct((x["start"] + p["at"]).alias("start"), (x["end"] + p["at"]).alias("end"), x["value"].alias("value"))))
    return F.when(text.rlike(pattern), F.flatten(moved)).otherwise(none)


def _base(text: Column) -> dict[str, Column]:
    assign = F.filter(_matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)
    return {"assign": assign, "access": _matches(text, ACCESS), "hex": _matches(text, HEX)}


def _as_spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _steps(values: DataFrame) -> dict[str, int]:
    """Counts of each pair of neighbouring characters (a value's first one follows a space) in column v."""
    chars = F.concat(F.lit(" "), F.col("v"))
    pairs = values.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("v")), lambda k: F.substring(chars, k, F.lit(2)))).alias("p"))
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, *, max_docs: int = 2000, made: int = 2000) -> list[float]:
    """The log-likelihood ratio of every pair of characters: row by the former (0: none), then the latter.

    max_docs: about how many documents (chosen by a hash of their id) give samples of either kind;
    made: how many hashes give made random strings, each in hexadecimal, base 64 and upper case.
    """
    spark = docs.sparkSession
    rows = docs.where("text is not null").select("doc_id", "text")
    share = min(1.0, max_docs / max(1, rows.count()))
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":secrets")).cast("binary"))
    sample = rows.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) < share)
    base = _base(F.col("text"))
    known = sample.select(F.explode(F.concat(*(F.transform(m, lambda x: x["value"]) for m in base.values()))).alias("v"))
    h = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")).cast("binary"), 256)
    tokens = F.array(F.substring(h, 1, 40), F.substring(F.base64(F.unhex(h)), 1, 40), F.translate(F.upper(F.substring(F.base64(F.unhex(h)), 1, 30)), "+/=", "247"))
    random = spark.range(made).select(F.explode(tokens).alias("v"))
    allowed = F.regexp_replace("v", "[^A-Za-z0-9+/_=-]", "")
    positive = _steps(known.unionByName(random).select(allowed.alias("v")).where("v != ''"))
    ordinary = sample.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])(?:[A-Za-z_-]{5,}|[0-9]{2,})(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("v"))
    negative = _steps(ordinary)

    def logs(counts: dict[str, int]) -> list[list[float]]:
        out = []
        for a in " " + ALPHABET:
            row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET]
            out.append([math.log(x / sum(row)) for x in row])
        return out

    return [round(p - q, 6) for ps, qs in zip(logs(positive), logs(negative), strict=True) for p, q in zip(ps, qs, strict=True)]


def _ratio(token: Column, model: Column) -> Column:
    """The token's log-likelihood ratio."""
    at = F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.instr(F.lit(ALPHABET), F.substring(token, k, F.lit(1))))
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    return F.aggregate(at, start, lambda acc, k: F.struct(k.alias("prev"), (acc["sum"] + F.element_at(model, acc["prev"] * len(ALPHABET) + k)).alias("sum")), lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], *, least: float = 10.0) -> DataFrame:
    """doc_id and its spans (start, kind as an index of KINDS, end), by start, then kind."""
    weights = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.array_sort(F.concat(*(_as_spans(m, k) for k, m in _base(F.col("text")).items())).cast(SPAN))
    rows = rows.select("doc_id", base.alias("base"), _matches(F.col("text"), CANDIDATE).alias("runs"))
    # base spans by parts, with how far each part reaches
    parts = F.transform(_blocks(F.col("base")), lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("spans")))
    parts = F.when(F.size("base") > 0, parts).otherwise(F.array().cast(f"array<struct<start:int,end:int,spans:{SPAN}>>"))

    def meets(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def added(parts: Column) -> Column:
        """Runs that no base span touches and that the models tell apart; parts are computed once for all runs."""
        touched = lambda x: F.exists(parts, lambda p: meets(p, x) & F.exists(p["spans"], lambda b: meets(b, x)))
        return F.filter("runs", lambda x: ~touched(x) & (_ratio(x["value"], weights) >= least))

    more = F.transform(F.array(parts), added)[0]
    return rows.select("doc_id", "base", _as_spans(more, "markov").cast(SPAN).alias("more")).select("doc_id", F.array_sort(F.concat("base", "more")).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


#: The rows of the registered query, with its parameters.
SCAN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, text IS NOT NULL AS has FROM documents),
pats(kind, pat, grp) AS (VALUES (0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), (1, 'AKIA[A-Z0-9]{12,}', 0), (2, '[0-9a-f]{32,}', 0), (3, '[A-Za-z0-9+/_=-]{16,}', 0)),
m AS (SELECT r, doc_id, has, kind, regexp_extract_all(t, pat) AS m, CASE grp WHEN 0 THEN regexp_extract_all(t, pat) ELSE regexp_extract_all(t, pat, 2) END AS v, string_split_regex(t, pat) AS g FROM d, pats WHERE regexp_matches(t, pat)),
places AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM m),
found AS (SELECT r, doc_id, has, kind, v[k] AS v, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[k]) AS n FROM places),
spans AS (SELECT *, a + n AS b FROM found WHERE kind > 0 OR length(v) >= 8),
sample AS (SELECT r, t FROM d WHERE has AND CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':secrets'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(1.0, 2000 / greatest(1, (SELECT count(*) FROM d WHERE has)))),
h AS (SELECT sha256('random' || CAST(id AS VARCHAR)) AS h FROM range(0, 2000) x(id)),
b64 AS (SELECT h, to_base64(unhex(h)) AS e FROM h),
good AS (SELECT v FROM spans JOIN sample USING (r) WHERE kind < 3 UNION ALL SELECT substr(h, 1, 40) FROM b64 UNION ALL SELECT substr(e, 1, 40) FROM b64 UNION ALL SELECT translate(upper(substr(e, 1, 30)), '+/=', '247') FROM b64),
bad AS (SELECT v FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]+')) AS v FROM sample) WHERE regexp_full_match(v, '[A-Za-z_-]{5,}|[0-9]{2,}')),
labelled AS (SELECT 1 AS s, regexp_replace(v, '[^A-Za-z0-9+/_=-]', '', 'g') AS v FROM good UNION ALL SELECT 0, v FROM bad),
steps AS (SELECT s, substr(' ' || v, k, 2) AS p FROM (SELECT s, v, unnest(range(1, length(v) + 1)) AS k FROM labelled)),
counts AS (SELECT s, p, count(*) AS c FROM steps GROUP BY ALL),
abc AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')) AS x),
grid AS (SELECT q.s, a.x AS a, b.x AS b FROM (VALUES (0), (1)) q(s), (SELECT x FROM abc UNION ALL SELECT ' ') a(x), abc b),
full_ AS (SELECT g.s, g.a, g.b, coalesce(c, 0) + 0.5::DOUBLE AS c FROM grid g LEFT JOIN counts k ON k.s = g.s AND k.p = g.a || g.b),
logs AS (SELECT s, a, b, ln(c / sum(c) OVER (PARTITION BY s, a)) AS l FROM full_),
model AS (SELECT x.a || x.b AS p, round(x.l - y.l, 6) AS w FROM logs x JOIN logs y ON x.s = 1 AND y.s = 0 AND x.a = y.a AND x.b = y.b),
runs AS (SELECT s.* FROM spans s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = s.r AND b.kind < 3 AND b.a < s.b AND s.a < b.b)),
scored AS (SELECT r, a, b, sum(w) AS w FROM (SELECT r, a, b, v, unnest(range(1, length(v) + 1)) AS k FROM runs) JOIN model ON p = substr(' ' || v, k, 2) GROUP BY ALL),
kept AS (SELECT r, kind, a, b FROM spans WHERE kind < 3 UNION ALL SELECT r, 3, a, b FROM scored WHERE w >= 10),
named AS (SELECT r, kind, a, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || a || ':' || b AS s FROM kept),
per AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_markov,
    string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""
