"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens lie between white space; a token with a digit is a variable field at once. The tree has two fixed
levels, the number of tokens and the first LEAD tokens, which lead to a leaf. Within a leaf that holds several lines, a
token further on is constant if at least two distinct lines of the leaf, and a share of COMMON of them, have it at that
place; other tokens are variable fields. As that is a share, a place has 1 / COMMON constants at most, however many lines
there are, so fields of many values stay variable when the corpus grows. A line whose constant tokens, leading ones included, are at least SIMILAR of all belongs to the template of its
leaf and constant tokens; any other line is a template of its own. A template met in two documents or more recurs: the
document with the smallest doc_id keeps its lines, all later ones drop them.

Counting is by two-level aggregation of hashes; lines meet their leaf's constants by joins that can be split where one
key is hot. A line that has a share of 1 / RARE of all places is one of RARE at most; where its places meet its keeper,
they are dealt by SALTS salts. Lines are known by 64-bit hashes. Only lines of leaves with several lines are read again for their tokens.

Edge cases: a null text stays null; blank lines are kept and never count; a line that a document repeats is kept as
often as it has it, unless it is dropped; repeated rows (one doc_id) keep the same lines; a null doc_id is the last; a
document all of whose lines go has an empty text and its row stays; an empty table gives no rows; extra columns are kept
by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashable, whole_text, written

LEAD = 3
SIMILAR = 0.75
COMMON = 0.25
RARE, SALTS = 2_000, 64
LAST_ID = 2**63 - 1
LEAST_LONG = -(2**63)
GAP = r"[ \t\r\f\x0B]+"


def _masked(line: Column) -> Column:
    """Single spaces between tokens, tokens with a digit as <*>; lines that need neither are only looked through."""
    odd = line.rlike(r"[\t\r\f\x0B]|  |^ | $")
    plain = F.when(odd, F.trim(F.regexp_replace(line, GAP, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(plain)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn("__key", F.xxhash64("doc_id", "text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """key, doc, pos, leaf, line, n: hashes of the lines that are not blank."""
    masked = F.transform(F.split(whole_text(), "\n", -1), _masked)  # once for each line
    each = keyed.select("__key", "__doc", F.posexplode(masked).alias("pos", "masked")).where(F.col("masked") != "")
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return each.select(
        F.col("__key").alias("key"), F.col("__doc").alias("doc"), "pos",
        F.xxhash64(n, F.substring_index("masked", " ", LEAD)).alias("leaf"), F.xxhash64("masked").alias("line"), n.alias("n"),
    )


def _meet(places: DataFrame, gone: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places and gone by line; those of the RARE lines at most that are very common are dealt by salts."""
    often = places.count() / RARE
    hot = F.broadcast(distinct.where(F.col("times") >= F.lit(often)).select("line", F.lit(True).alias("hot")))
    salted = places.join(hot, "line", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("key", F.lit(SALTS))).otherwise(0))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(gone.join(hot, "line", "left").select("line", "keeper", F.explode(copies).alias("salt")), ["line", "salt"])


def recurring(keyed: DataFrame, similar: float = SIMILAR, common: float = COMMON) -> DataFrame:
    """key, drop: places of the lines that each document drops."""
    lines = written(_lines(keyed), "uncompressed")
    distinct = written(lines.groupBy("line").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("key").alias("key"), F.min_by("pos", "key").alias("pos"), F.min("leaf").alias("leaf"), F.max("n").alias("n"),
        F.count(F.lit(1)).alias("times"),
    ), "uncompressed")
    leaves = distinct.where(F.col("n") > LEAD).groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("z"), F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("lines"))
    varied = leaves.where((F.col("a") < F.col("z")) & (F.col("first") < F.col("last"))).select("leaf", "lines")
    wanted = distinct.where(F.col("n") > LEAD).join(varied, "leaf")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "leaf", "line", "lines")).alias("at"))
    # The second condition is true of every hash, as none is below the least long. It keeps all columns in the exchange of
    # the texts, so that the join at the end of ``marked`` has an equal one and both read the same.
    every = F.xxhash64(*[F.col(c) for c in hashable(keyed.drop("__doc"))], F.size("at")) >= F.lit(LEAST_LONG)
    texts = keyed.join(by_text, (F.col("__key") == F.col("key")) & every).select("key", "at", whole_text().alias("text"))
    texts = texts.groupBy("key").agg(F.first("at").alias("at"), F.first("text").alias("text"))  # rows that are repeated; they lie together already
    read = texts.withColumn("raw", F.split("text", "\n", -1)).select(F.explode("at").alias("at"), "raw").select("at.leaf", "at.line", "at.lines", _masked(F.get("raw", F.col("at.pos"))).alias("masked"))
    tokens = read.select("leaf", "line", "lines", F.posexplode(F.split("masked", " ")).alias("place", "token")).where((F.col("place") >= LEAD) & (F.col("token") != "<*>"))
    tokens = tokens.select("line", F.xxhash64("leaf", "place", "token").alias("token"), F.col("lines").cast("double").alias("lines"))
    constant = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("having"), F.max("lines").alias("lines"))
    constant = constant.where((F.col("having") > 1) & (F.col("having") >= F.lit(common) * F.col("lines"))).select("token")
    shapes = tokens.select("line", "token").join(constant, "token").groupBy("line").agg(F.bit_xor("token").alias("shape"), F.count(F.lit(1)).alias("constants"))
    known = wanted.select("line", "leaf", "n", "first", "last").join(shapes, "line", "left")
    general = F.coalesce("constants", F.lit(0)) + LEAD >= F.lit(similar) * F.col("n")
    template = F.xxhash64("leaf", F.coalesce("shape", F.lit(0)), F.coalesce("constants", F.lit(0)))
    known = known.where(general & F.col("first").isNotNull() & F.col("last").isNotNull()).select("line", "first", "last", template.alias("template"))
    # both uses of known read the same columns, so that what it is made of is made once
    keepers = known.groupBy("template").agg(F.min("first").alias("keeper"), F.max("last").alias("last"), F.min("line").alias("some"))
    keepers = keepers.where((F.col("keeper") < F.col("last")) & F.col("some").isNotNull()).select("template", "keeper")
    alike = known.join(keepers, "template").where((F.col("last") > F.col("keeper")) & (F.col("first") >= F.col("keeper"))).select("line", "keeper")
    equal = distinct.where(F.col("first") < F.col("last")).select("line", F.col("first").alias("keeper"))
    gone = alike.unionAll(equal).groupBy("line").agg(F.min("keeper").alias("keeper"))
    hits = _meet(lines.select("key", "doc", "pos", "line"), gone, distinct).where(F.col("doc") > F.col("keeper"))
    return hits.groupBy("key").agg(F.collect_set("pos").alias("drop"))


def marked(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with drop: the places of lines to drop, NULL for none."""
    keyed = _keyed(docs)
    drops = recurring(keyed, similar)
    return keyed.join(drops.withColumnRenamed("key", "__key"), "__key", "left")


def _kept() -> Column:
    """The text without the lines to drop."""
    raw = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), "drop")
    return F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(raw, i)), "\n"))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs, text without the lines that recur; columns as in docs. Other columns travel in a struct, out of the way of
    the names used here."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    sealed = docs.select("doc_id", "text", *([F.struct(*others).alias("__rest")] if others else []))
    out = marked(sealed, similar)
    return out.select(*[_kept().alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.length(whole_text()) - F.length(F.replace(whole_text(), F.lit("\n"), F.lit(""))) + 1
    made = marked(docs).select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(_kept(), F.lit("")).alias("kept"))
    return made.select("doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, unnest(raw) AS raw, unnest(range(0, len(raw))) AS pos FROM d),
m AS (
  SELECT doc_id, pos, raw,
         list_transform(string_split(trim(regexp_replace(raw, '[ \t\r\f\x0B]+', ' ', 'g')), ' '),
                        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w
  FROM l),
k AS (SELECT *, len(w) AS n, array_to_string(w[1:3], ' ') AS lead, array_to_string(w, ' ') AS line FROM m WHERE w <> ['']),
g AS (SELECT n, lead, line, any_value(w) AS w, min(doc_id) AS f, max(doc_id) AS z FROM k GROUP BY ALL),
v AS (SELECT n, lead, count(*) AS lines FROM g GROUP BY ALL HAVING count(*) > 1 AND min(f) < max(z)),
t AS (SELECT n, lead, line, lines, unnest(w) AS tok, unnest(range(0, len(w))) AS p FROM g JOIN v USING (n, lead) WHERE n > 3),
c AS (SELECT n, lead, p, tok FROM t WHERE p >= 3 AND tok <> '<*>' GROUP BY n, lead, p, tok HAVING count(*) > 1 AND count(*) >= 0.25 * max(lines)),
s AS (SELECT n, lead, line, string_agg(p || '=' || tok, ' ' ORDER BY p) AS shape, count(*) AS constants
      FROM t JOIN c USING (n, lead, p, tok) GROUP BY ALL),
x AS (
  SELECT n, lead, line, f, z,
         CASE WHEN n > 3 AND coalesce(constants, 0) + 3 >= 0.75 * n THEN 't ' || coalesce(shape, '') ELSE 'l ' || line END AS template
  FROM g LEFT JOIN s USING (n, lead, line)),
r AS (SELECT n, lead, template, min(f) AS keeper FROM x GROUP BY ALL HAVING min(f) < max(z)),
o AS (SELECT DISTINCT doc_id, pos FROM k JOIN x USING (n, lead, line) JOIN r USING (n, lead, template) WHERE doc_id > keeper),
e AS (SELECT l.doc_id, count(*) AS n_lines, count(o.pos) AS n_dropped,
             coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE o.pos IS NULL), '') AS kept
      FROM l LEFT JOIN o USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM e
"""
