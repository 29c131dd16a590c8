"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a key that is random but fixed (a hash of its id and text). A source's rows in key
order are its sequence; a source's target is met by whole epochs of it and a cut of the next one at
the exact word. The cut is found without sorting a source in one place: word sums of about
sqrt(rows) key ranges per source, prefix sums over the ranges, then over the keys of the one range
that holds the cut. What remains per source is one row (epochs and the cut's key), which rows are
compared with, so texts are never shuffled.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source, the last
in order; rows alike in id and text share a key, and a cut that falls on them is shared in proportion
(at most one word less per such row); an empty table gives an empty result. Extra columns pass
through ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, small

WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """60 random-looking bits."""
    h = F.md5(F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes: a row per source with source and source_size; adds target.

    Sources in code point order, null last, have the weights in turn; together they share 100 % of
    all words. No target exceeds ``most`` times its source's size; the excess goes to the others by
    weight. With sources by rising size per weight, those that stop come first, so the level that
    all others reach is the largest of (what earlier ones leave) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everywhere = Window.partitionBy()
    t = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    t = t.withColumn("w", F.array(*[F.lit(int(w)) for w in weights])[F.col("turn").cast("int")].cast("long")).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    earlier = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(everywhere) - earlier) / later)
    t = t.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everywhere) * F.col("w")))
    return t.select("source", "source_size", "target")


def plan(rows: DataFrame, **options) -> DataFrame:
    """rows: source, size, key, of every document. A row per source: source_size, target, epochs,
    and the key, words (of all rows with it) and wanted words of its cut."""
    named = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sizes = cut(named.groupBy("s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")))
    t = sizes.join(targets(sizes.select("source", "source_size"), **options).drop("source_size").withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "s")
    # whole words first: a target that rounds up to a multiple of its source's size is that many epochs
    t = t.withColumn("goal", F.round("target").cast("long"))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0).cast("long")).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    t = cut(t.withColumn("ranges", F.ceil(F.sqrt("n")).cast("long")))
    few = small(t)
    ranged = named.join(few.select("s", "ranges", "rest"), "s").withColumn("range", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30))
    sums = ranged.groupBy("s", "range", "rest").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    at = small(cut(at.select("s", "range", "before")))
    units = ranged.join(at, ["s", "range"]).groupBy("s", "rest", "before", "key").agg(F.sum("size").alias("unit"))
    prior = F.col("before") + F.coalesce(F.sum("unit").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = units.withColumn("prior", prior).where((F.col("prior") <= F.col("rest")) & (F.col("rest") < F.col("prior") + F.col("unit")))
    cuts = cuts.select("s", F.col("key").alias("cut_key"), "unit", (F.col("rest") - F.col("prior")).alias("wanted"))
    lost = F.when((F.col("rest") > 0) & F.col("cut_key").isNull(), F.raise_error(F.lit("a source's cut was not found"))).otherwise(F.col("epochs"))
    return small(cut(t.join(cuts, "s", "left").select("s", "source_size", "target", lost.alias("epochs"), "cut_key", "unit", "wanted")))


def _part(size: Column) -> Column:
    """Words that the last, cut epoch takes of a row."""
    at_cut = F.floor(F.col("wanted") * size / F.col("unit")).cast("long")
    return F.coalesce(F.when(F.col("key") < F.col("cut_key"), size).when(F.col("key") == F.col("cut_key"), at_cut), F.lit(0))


def shares(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    rows = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key")))
    named = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    out = named.join(plan(rows, **options), "s")
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _part(F.col("size"))).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as its source's epochs take it, the row at the
    cut with its first words only (n_chars follows the text where it is a column)."""
    names = docs.columns
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    cuts = plan(cut(sized), **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.withColumns({"s": F.coalesce(F.concat(F.lit("s"), "row.source"), F.lit("n")), "size": size_of(F.col("row.text")), "key": key_of(F.col("row.doc_id"), F.col("row.text"))})
    rows = rows.join(cuts, "s").withColumn("part", _part(F.col("size"))).where("size > 0")
    pieces = F.split("row.text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    first_words = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    whole = F.array_repeat(F.lit(True), (F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)).cast("int"))
    partial = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    rows = rows.select("row", "part", F.explode(F.concat(whole, partial)).alias("all"))
    text = F.when(F.col("all"), F.col("row.text")).otherwise(first_words)
    changed = {"text": text}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("all"), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in names])


SHARES_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / CAST(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * source_size AS rest FROM e),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
    CAST(sum(d.size) OVER (PARTITION BY d.source, d.k) AS BIGINT) AS unit
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - unit <= rest AND unit > 0
    THEN CAST(floor((rest - (upto - unit)) * size / unit) AS BIGINT) ELSE 0 END AS taken FROM p
"""
