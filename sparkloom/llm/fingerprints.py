"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A text's shingles are its runs of five words (all of it, if it has fewer). A shingle's hash is the first 32 bits of its
MD5. The sketch keeps every hash below a fixed fraction of the range, so the sketch of a union is the union of sketches
and shares of sketches estimate both resemblance and containment, however unequal two texts are. A text with words of
which no hash is below the fraction keeps its least hash alone; a union drops such a hash once it has another below the
fraction.

``with_next`` gives each row its follower by descending doc_id without ordering all rows in one task: doc ids are cut
into ranges at doc ids that a hash picks, each range gets the first row of what follows as a guest, and a window runs
within each range.

Edge cases: a null text counts as an empty one; an empty text has an empty sketch, which is alike (1) another empty one
and unlike (0) any other; rows of one doc_id follow each other by text hash; a null doc_id comes last; a single row
follows itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SHINGLE_WORDS = 5
FRACTION_BITS = 2  # keep hashes below 2^-2 of the range
RANGE_ROWS = 2_000
MAX_RANGES = 65_536
PICKS = 16  # doc ids looked at for each cut, which evens the ranges out
LEAST_ID = -(2**63)


def limit_hex(bits: int = FRACTION_BITS) -> str:
    return f"{2 ** (32 - bits):08x}"


def shingles(text: Column, k: int = SHINGLE_WORDS) -> Column:
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(words: Column) -> Column:
        n = F.size(words)
        one = F.when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(one)

    return let(found, runs)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = SHINGLE_WORDS, bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct hashes, as an array of 8 hex digits each."""
    hashes = F.transform(shingles(text, k), lambda s: F.substring(F.md5(s.cast("binary")), 1, 8))

    def keep(every: Column) -> Column:
        low = F.filter(every, lambda h: h < limit_hex(bits))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.slice(F.array_sort(every), 1, 1))

    return let(hashes, keep)


def merge(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    """The sketch of two texts' shingles together."""
    every = F.array_union(a, b)
    low = F.filter(every, lambda h: h < limit_hex(bits))
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.slice(F.array_sort(every), 1, 1))


def resemblance(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def _range_bounds(docs: DataFrame, range_rows: int) -> tuple[list[int], int | None]:
    """Doc ids to cut at (at most about MAX_RANGES, among those that a hash picks) and the largest doc id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("i"))
    n, most = ids.agg(F.count(F.lit(1)), F.max("i")).first()
    if not n:
        return [], None
    ranges = max(n // range_rows, min(n, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranges = min(ranges, MAX_RANGES)
    every = max(1, n // (ranges * PICKS))
    picked = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0).distinct().collect())
    return picked[PICKS // 2 :: PICKS], most


def with_next(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs and, as next_<column>, the columns of the row that follows by descending doc_id (after the last: the first)."""
    bounds, most = _range_bounds(docs, range_rows)
    i = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.withColumn("__i", i).withColumn("__h", F.xxhash64(*docs.columns))
    real, guests = F.lit(0), []
    if bounds:
        cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, h: F.when((at + h <= len(bounds)) & (F.get(cuts, at + h - 1) <= F.col("__i")), at + h).otherwise(at))
        rows = rows.withColumn("__below", below)
        at_cut = (F.col("__below") > 0) & (F.get(cuts, F.greatest(F.col("__below") - 1, F.lit(0))) == F.col("__i"))
        real = F.when(at_cut, F.col("__below") - 1).otherwise(F.col("__below"))
        guests.append(F.when(at_cut, F.struct(F.col("__below").alias("range"), F.lit(1).alias("guest"))))
    if most is not None:
        guests.append(F.when(F.col("__i") == most, F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest"))))
    places = F.filter(F.array(F.struct(real.alias("range"), F.lit(0).alias("guest")), *guests), lambda p: p.isNotNull())
    rows = rows.withColumn("__place", F.explode(places))
    order = Window.partitionBy("__place.range").orderBy("__place.guest", F.col("__i").desc(), "__h")
    out = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where(F.col("__place.guest") == 0).drop("__i", "__h", "__below", "__place")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, bits: int = FRACTION_BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, edited, sketch and edited_sketch (arrays), next_sketch: whole texts and edited ones.

    A row's edited text is its own with the last third of code points replaced by as many of its follower's first.
    """
    base = docs.select("doc_id", whole_text().alias("text"))
    base = base.withColumn("joined", F.array_join(sketch(F.col("text"), k, bits), ","))
    paired = with_next(base, ["text", "joined"], range_rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    back = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    out = paired.select("doc_id", "text", edited.alias("edited"), back("joined").alias("sketch"), back("next_joined").alias("next_sketch"))
    return out.withColumn("edited_sketch", sketch(F.col("edited"), k, bits))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt
  FROM d),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3) AS edited FROM o),
t AS (SELECT DISTINCT text FROM (SELECT text FROM e UNION ALL SELECT edited FROM e)),
w AS (SELECT text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (
  SELECT text, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
h AS (SELECT text, list_sort(list_distinct(list_transform(s, lambda x: md5(x)[1:8]))) AS h FROM s),
f AS (
  SELECT text, CASE WHEN len(list_filter(h, lambda x: x < '40000000')) > 0 THEN list_filter(h, lambda x: x < '40000000')
                    ELSE h[1:1] END AS f
  FROM h)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
       array_to_string(a.f, '') AS fingerprint, array_to_string(b.f, '') AS edited_fingerprint,
       CASE WHEN len(a.f) + len(b.f) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(a.f || b.f)) END AS near_edited,
       CASE WHEN len(a.f) + len(c.f) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.f, c.f))::DOUBLE / len(list_distinct(a.f || c.f)) END AS near_next,
       CASE WHEN len(a.f) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.f, b.f))::DOUBLE / len(a.f) END AS kept_in_edited
FROM e JOIN f a ON a.text = e.text JOIN f b ON b.text = e.edited JOIN f c ON c.text = e.nxt
"""
