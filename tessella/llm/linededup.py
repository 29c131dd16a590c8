"""Line dedup by a log-template tree, in DataFrame functions only.

A line's variable fields (tokens with a digit) are masked, but in a line of which they are more than
half (a row of figures); its path in the tree is its token count and its leading tokens. Lines whose
masked text alone recurs are a template. The others of a leaf are generalised position by position:
a token that most lines of a group share stays, other positions become variable; lines that fit such
a template belong to it. A leaf starts as one group. Its lines that are in no recurring template are
split, each by the commonest of its tokens (with its position) that most of the group don't share,
and every part is generalised in its turn, until no part is left that could hold a template. So a
leaf holds as many templates as there are, whatever other lines it has; a part has less than
``share`` of its group's lines, so rounds are few.

A template found in at least ``min_docs`` documents, or ``long_docs`` for one of ``long_tokens``
tokens or more, is recurring: its first line (smallest doc_id, then line) stays, all others are
dropped. A template that a whole leaf shares needs half its positions fixed; one of a part, half of
those after the leading ones, which is more.

Edge cases: a null text stays null and an empty one empty; lines of fewer than ``min_tokens`` tokens
are never dropped; repeated rows (same doc_id and text) count as one document and are treated alike;
rows with a null doc_id are left as they are; an empty table gives an empty result. Extra columns
of the input pass through ``drop_recurring`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small


def _lines(docs: DataFrame) -> DataFrame:
    """i (doc_id), d (hash of the text), pos, line and n (its tokens) of every line with a token.

    Lines have single spaces and masked variable fields; both are done on whole texts, and only on
    those that need it.
    """
    t = F.col("t")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("d"), F.col("text").alias("t"))
    rows = rows.withColumn("t", F.when(t.rlike("[\\x09\\x0B-\\x0D]"), F.regexp_replace(t, "[\\x09\\x0B-\\x0D]", " ")).otherwise(t))
    rows = rows.withColumn("t", F.when(t.contains("  "), F.regexp_replace(t, " +", " ")).otherwise(t))
    rows = rows.withColumn("m", F.when(t.rlike("[0-9]"), F.regexp_replace(t, "[^ \n0-9]*[0-9][^ \n]*", "<*>")).otherwise(t))
    # a line has most tokens masked only if two of them are adjacent, or its first and last are
    some = F.col("m").rlike("<\\*> <\\*>|(^|\n) ?<\\*> [^\n]*<\\*> ?(\n|$)")
    mask = lambda m: F.length(m) - F.length(F.replace(m, F.lit("<*>"), F.lit("<>")))
    tokens = lambda m: F.length(F.trim(m)) - F.length(F.replace(F.trim(m), F.lit(" "), F.lit(""))) + 1
    lines = F.split("m", "\n")
    lines = F.when(some, F.zip_with(lines, F.split("t", "\n"), lambda m, own: F.when(2 * mask(m) > tokens(m), own).otherwise(m))).otherwise(lines)
    rows = rows.select("i", "d", F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("i", "d", "pos", F.trim("line").alias("line")).where("line != ''")
    return rows.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def recurring_lines(
    docs: DataFrame, *, min_docs: int = 3, long_docs: int = 2, long_tokens: int = 50, min_tokens: int = 3, lead: int = 4, share: float = 0.6, fit: float = 0.8
) -> DataFrame:
    """i, d, pos of every line to drop (see the module's text).

    share: of a group's lines, what must agree on a token for it to stay in the template; fit: of a
    template's fixed tokens, what a line must have.
    """
    enough = F.when(F.col("n") >= long_tokens, long_docs).otherwise(min_docs)
    line = F.struct("i", "d", "pos")

    def spread(df: DataFrame, *by: str) -> DataFrame:
        """The templates of enough documents, with their first line."""
        each = df.groupBy(*by, "i").agg(F.min(line).alias("first"), F.max("n").alias("n"))
        each = each.groupBy(*by).agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.max("n").alias("n"))
        return each.where(F.col("docs") >= enough).select(*by, "first")

    def named(lines: DataFrame) -> DataFrame:
        """With m1, m2: 128 bits of the masked line, and its leaf."""
        leaf = F.xxhash64("n", F.substring_index("line", " ", lead))
        return lines.withColumns({"m1": F.xxhash64("line"), "m2": F.xxhash64(F.lit(1), "line"), "leaf": leaf})

    lines = named(_lines(docs).where(F.col("n") >= min_tokens))
    slim = cut(lines.select("i", "d", "pos", "n", "m1", "m2", "leaf"))
    alone = small(cut(spread(slim, "m1", "m2")))
    dropped = slim.join(alone, ["m1", "m2"]).where(line != F.col("first")).select("i", "d", "pos")

    known = alone.select("m1", "m2")
    rest = slim.where(F.col("n") > lead).join(known, ["m1", "m2"], "left_anti")
    leaves = small(cut(spread(rest, "leaf").select("leaf")))
    own = lines.where(F.col("n") > lead).join(leaves, "leaf", "left_semi").join(known, ["m1", "m2"], "left_anti")
    # p: a hash of each token after the leading ones, with its place; 0 for a variable one
    after = F.slice(F.split("line", " "), lead + 1, F.col("n"))
    hashes = F.transform(after, lambda x, k: F.when(x == "<*>", F.lit(0).cast("long")).otherwise(F.xxhash64(k, x)))
    group = cut(own.select(F.col("leaf").alias("g"), "i", "d", "pos", "n", hashes.alias("p")))
    turn = 0
    while group.limit(1).count():
        # a token that no two lines of a group share is of no use in it or its parts
        tally = group.select("g", F.explode("p").alias("h")).where("h != 0").groupBy("g", "h").agg(F.count("*").alias("c")).where("c > 1")
        marks = cut(tally.join(group.groupBy("g").agg(F.count("*").alias("total")), "g"))
        fixed = marks.where(F.col("c") >= share * F.col("total")).groupBy("g").agg(F.collect_list("h").alias("fixed"))
        whole = F.size("fixed") + lead >= 0.5 * F.col("n") if not turn else F.size("fixed") >= 0.5 * (F.col("n") - lead)
        fits = whole & (F.size(F.array_intersect("p", "fixed")) >= fit * F.size("fixed"))
        fitted = group.join(fixed, "g", "left").select("g", "i", "d", "pos", "n", "p", F.coalesce(fits, F.lit(False)).alias("fits"))
        met = fitted.join(spread(fitted.where("fits"), "g"), "g", "left")
        taken = F.col("fits") & F.col("first").isNotNull()
        met = cut(met.select("g", "i", "d", "pos", "n", F.when(~taken, F.col("p")).alias("p"), (taken & (line != F.col("first"))).alias("drop")))
        dropped = dropped.unionByName(met.where("drop").select("i", "d", "pos"))
        # a line's commonest token that isn't fixed in its group; of equals the last. So parts shrink by the share
        left = met.where("p is not null").drop("drop")
        cells = left.select("g", "i", "d", "pos", F.posexplode("p").alias("k", "h")).where("h != 0").join(marks, ["g", "h"])
        top = F.max(F.when(F.col("c") < share * F.col("total"), F.shiftleft("c", 31).bitwiseOR(F.col("k").cast("long"))))
        each = cells.groupBy("g", "i", "d", "pos").agg(top.alias("top"), F.count("*").alias("marked"))
        left = left.join(each, ["g", "i", "d", "pos"]).where(F.col("top").isNotNull() & (F.col("marked") >= 0.5 * fit * (F.col("n") - lead)))
        at = F.col("top").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        left = left.select(F.xxhash64("g", F.get("p", at)).alias("g"), "i", "d", "pos", "n", "p")
        large = left.groupBy("g").agg(F.count("*").alias("lines"), F.max("n").alias("n")).where(F.col("lines") >= enough)
        group = cut(left.join(large.select("g"), "g", "left_semi"))
        turn += 1
    return dropped


def dedup(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs as struct ``row``, with n_lines, n_dropped and the remaining text as ``kept_text``.

    A text without dropped lines is returned as it is, byte for byte; else its remaining lines are
    joined by newlines.
    """
    drops = recurring_lines(docs, **options).distinct().groupBy("i", "d").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("i"), F.xxhash64("row.text").alias("d"))
    joined = rows.join(drops, ["i", "d"], "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    after = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda p, q: F.slice("lines", p + 2, q - p - 1)))
    breaks = F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit("")))
    return joined.select(
        "row",
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def drop_recurring(docs: DataFrame, **options) -> DataFrame:
    """docs with the recurring lines gone from text (and n_chars set anew where it is a column).

    A document of which no word remains, though it had some, is gone too.
    """
    names = docs.columns
    out = dedup(docs, **options).where((F.col("n_dropped") == 0) | F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))} if "n_chars" in names else {"text": F.col("kept_text")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in names])


def _dedup_sql(rounds: int = 12) -> str:
    """The defaults' rows of ``dedup`` for documents (doc_id, n_lines, n_dropped, text).

    The rounds of splitting are written out; an input that needs more gives an error.
    """
    enough = "CASE WHEN max(n) >= 50 THEN 2 ELSE 3 END"
    parts = [r"""WITH raw AS (SELECT doc_id AS i, md5(text) AS d, regexp_replace(regexp_replace(text, '[\x09\x0B-\x0D]', ' ', 'g'), ' +', ' ', 'g') AS t
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
cells AS (SELECT DISTINCT i, d, unnest(range(0, len(string_split(t, chr(10))))) AS pos, t, regexp_replace(t, '[^ \n0-9]*[0-9][^ \n]*', '<*>', 'g') AS m FROM raw),
both_ AS (SELECT i, d, pos, trim(string_split(t, chr(10))[pos + 1], ' ') AS own, trim(string_split(m, chr(10))[pos + 1], ' ') AS line FROM cells),
counted AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n, length(line) - length(replace(line, '<*>', '<>')) AS masks FROM both_ WHERE line <> ''),
k AS MATERIALIZED (SELECT i, d, pos, n, CASE WHEN 2 * masks > n THEN own ELSE line END AS line FROM counted WHERE n >= 3),
alone AS MATERIALIZED (SELECT line, min(row(i, d, pos)) AS first FROM k GROUP BY line HAVING count(DISTINCT i) >= """ + enough + r"""),
rest AS MATERIALIZED (SELECT k.*, n || ' ' || array_to_string(string_split(line, ' ')[1:4], ' ') AS g FROM k ANTI JOIN alone USING (line) WHERE n > 4),
leaves AS (SELECT g FROM rest GROUP BY g HAVING count(DISTINCT i) >= """ + enough + r"""),
s0 AS MATERIALIZED (SELECT rest.* FROM rest SEMI JOIN leaves USING (g)),
cut_ AS (SELECT i, d, pos, string_split(line, ' ') AS w, unnest(range(4, n)) AS place FROM s0),
places AS MATERIALIZED (SELECT i, d, pos, place, CASE WHEN length(w[place + 1]) > 64 THEN md5(w[place + 1]) ELSE w[place + 1] END AS token FROM cut_ WHERE w[place + 1] <> '<*>')"""]
    for r in range(rounds):
        whole = "need + 4 >= 0.5::DOUBLE * n" if not r else "need >= 0.5::DOUBLE * (n - 4)"
        parts.append(f"""
c{r} AS MATERIALIZED (SELECT g, place, token, count(*) AS c FROM s{r} JOIN places USING (i, d, pos) GROUP BY ALL HAVING count(*) > 1),
t{r} AS MATERIALIZED (SELECT g, count(*) AS total FROM s{r} GROUP BY g),
f{r} AS MATERIALIZED (SELECT g, place, m[2] AS token, TRUE AS fixed FROM (SELECT g, place, max(row(c, token)) AS m, max(c) AS c FROM c{r} GROUP BY g, place) JOIN t{r} USING (g) WHERE c >= 0.6::DOUBLE * total),
n{r} AS MATERIALIZED (SELECT g, count(*) AS need FROM f{r} GROUP BY g),
e{r} AS MATERIALIZED (SELECT g, i, d, pos, n, count(fixed) AS got, max(need) AS need, max(row(c, place, token)) FILTER (c < 0.6::DOUBLE * total) AS top, count(*) AS marked
    FROM s{r} JOIN places USING (i, d, pos) JOIN c{r} USING (g, place, token) JOIN t{r} USING (g) LEFT JOIN f{r} USING (g, place, token) LEFT JOIN n{r} USING (g) GROUP BY g, i, d, pos, n),
x{r} AS MATERIALIZED (SELECT g, i, d, pos, n FROM e{r} WHERE got >= 0.8::DOUBLE * need AND {whole}),
w{r} AS MATERIALIZED (SELECT g, min(row(i, d, pos)) AS first FROM x{r} GROUP BY g HAVING count(DISTINCT i) >= {enough}),
d{r} AS MATERIALIZED (SELECT i, d, pos, row(i, d, pos) = first AS stays FROM x{r} JOIN w{r} USING (g)),
l{r} AS MATERIALIZED (SELECT g || '/' || top[2] || '=' || top[3] AS g, i, d, pos, n FROM e{r} ANTI JOIN d{r} USING (i, d, pos) WHERE top IS NOT NULL AND marked >= 0.5::DOUBLE * 0.8::DOUBLE * (n - 4)),
s{r + 1} AS MATERIALIZED (SELECT l{r}.* FROM l{r} SEMI JOIN (SELECT g FROM l{r} GROUP BY g HAVING count(*) >= {enough}) USING (g))""")
    drops = " UNION ".join(["SELECT k.i, k.d, k.pos FROM k JOIN alone USING (line) WHERE row(k.i, k.d, k.pos) <> first", *(f"SELECT i, d, pos FROM d{r} WHERE NOT stays" for r in range(rounds))])
    parts.append(f"""
gone AS (SELECT i, d, list(pos) AS gone FROM ({drops}) GROUP BY i, d)""")
    last = f"""
SELECT doc_id, CASE WHEN text IS NULL THEN 0 WHEN (SELECT count(*) FROM s{rounds}) > 0 THEN error('more rounds') ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text
FROM documents LEFT JOIN gone ON gone.i = doc_id AND gone.d = md5(text)
"""
    return ",".join(parts) + last


DEDUP_SQL = _dedup_sql()
