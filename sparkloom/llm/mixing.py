"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by a hash into blocks of a few hundred documents, or a few for a small source; block order is
the source's permutation. A source whose target is r times its size contributes floor(r) whole passes over its blocks and
one partial pass that ends within the document that reaches the target. The blocks that the passes draw are counted, and
these counts are the source's quota; a binary tree over the output shards splits the vector of quotas at each node by a
multivariate hypergeometric draw, so that every shard gets a random but exact share of each source. Shards take disjoint
runs of the permuted blocks, all of each quota, and order their documents by a hash.

The driver gathers one row for each source and pass, and holds the table of quotas, sources by shards. A block holds
about BLOCK_DOCS documents whatever the source's size, so that blocks grow in number and not in size.

Edge cases: a null text has size 0; a source whose sizes sum to 0 has target 0 and draws nothing; repeated rows are
separate documents with equal hashes (ties are ordered by doc_id, then by text hash); rows equal in doc_id, text and
source but not in other columns each keep their own; an empty table gives an empty result; extra columns, whatever their
names, are carried through ``mix`` and ignored by ``plan_mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, few, hashable

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK_DOCS = 512
#: A source of fewer documents than this many blocks hold has blocks of fewer documents, one at least.
LEAST_BLOCKS = 64
SHARD_WORDS = 4_000_000
#: Shards beyond this number would make the driver's table of quotas large; shards then hold more words each.
MAX_SHARDS = 4_096
SEED = 20_240_517


def words(column: Column) -> Column:
    """Number of runs of anything but space and the five ASCII controls from tab to carriage return."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sizes: list[int], weights=WEIGHTS, ceiling: int = CEILING) -> list[float]:
    """Targets of sources in order: weights repeat; what is above ceiling x size is shared anew by weight."""
    total = sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target: list[float | None] = [0.0 if s == 0 else None for s in sizes]
    while any(t is None for t in target):
        rest = total - sum(t for t in target if t is not None)
        heavy = sum(w for w, t in zip(weight, target, strict=True) if t is None)
        over = [i for i, t in enumerate(target) if t is None and rest * weight[i] / heavy > ceiling * sizes[i]]
        if not over:
            return [rest * w / heavy if t is None else t for w, t in zip(weight, target, strict=True)]
        for i in over:
            target[i] = float(ceiling * sizes[i])
    return [float(t) for t in target]


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Exact quotas of each source (columns) in each shard (rows), by recursive multivariate hypergeometric halving."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        room = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, room, method="marginals") if total else have
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def plan_mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, taken, draws (shard and words of each copy), one row per row of docs.

    The table of sources (one row each) is the only thing gathered on the driver.
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("row_hash"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
    ))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["source_size"]) for r in sources]
    targets = share_targets(sizes, weights, ceiling)
    known = []
    for r, s, t in zip(sources, sizes, targets, strict=True):
        passes = min(int(t // s), ceiling) if s else 0
        known.append((r["source"], s, float(t), passes, float(t - passes * s), max(1, -(-r["n"] // BLOCK_DOCS), min(r["n"], LEAST_BLOCKS))))
    facts = spark.createDataFrame(known, "source string, source_size long, target double, passes int, rest double, blocks int")
    dealt = sized.alias("d").join(few(facts, len(known)).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.row_hash", "d.h", "source_size", "target", "passes", "rest", "blocks",
        F.pmod(F.col("d.h"), F.col("blocks")).cast("int").alias("block"),
    )
    totals = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    upto = F.sum("block_size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("source", "block", F.coalesce(upto, F.lit(0)).alias("block_start"))
    inside = F.sum("size").over(Window.partitionBy("source", "block").orderBy("h", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("before", F.coalesce(inside, F.lit(0))).alias("p").join(
        starts.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))
    ).select("p.*", "block_start")
    # the partial pass ends inside one document, of which it takes the first words
    left = F.floor(F.col("rest") + F.lit(0.5)) - F.col("block_start") - F.col("before")
    placed = placed.withColumn("cut", F.least("size", F.greatest(left, F.lit(0))).cast("long"))
    placed = placed.withColumn("copies", (F.col("passes") + (F.col("cut") > 0).cast("int")).cast("int"))

    placed = cut_lineage(placed)
    used = placed.where("copies > 0").groupBy("source", "block").agg(F.max("copies").alias("copies"))
    # blocks are drawn pass by pass, each pass in block order; a block without words in the last pass is not drawn
    passes = used.select("source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("turn"))
    drawn = {(r["source"], r["turn"]): r["n"] for r in passes.groupBy("source", "turn").agg(F.count(F.lit(1)).alias("n")).collect()}  # some rows for each source
    shards = max(1, min(-(-sum(sizes) // shard_words), MAX_SHARDS))
    quotas = np.array([sum(drawn.get((k[0], c), 0) for c in range(ceiling + 1)) for k in known], dtype=np.int64)
    split = split_quotas(quotas, shards, seed) if len(known) else np.zeros((shards, 0), dtype=np.int64)
    ends = np.cumsum(split, axis=0)
    # where each pass begins in the source's order of draws, and the shards that have blocks with the ends of their runs
    turns = lambda k: [sum(drawn.get((k, c), 0) for c in range(n)) for n in range(ceiling + 1)]
    runs = spark.createDataFrame(
        [(k[0], turns(k[0]), [int(x) for x in np.flatnonzero(split[:, i])], [int(x) for x in ends[split[:, i] > 0, i]]) for i, k in enumerate(known)],
        "source string, turns array<long>, shards array<int>, ends array<long>",
    )
    # a block's place in a pass is its rank among the blocks that the pass draws
    rank = lambda c: F.col("ranks")[c]
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = used.select("source", "block", F.array(*[F.coalesce(F.sum((F.col("copies") > c).cast("long")).over(by_block), F.lit(0)) for c in range(ceiling + 1)]).alias("ranks"))
    dealt = ranks.alias("b").join(few(runs, len(known) * (1 + shards)).alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")))
    place = lambda c: F.col("turns")[c] + rank(c)
    shard = lambda c: F.col("shards")[_first_above(F.col("ends"), place(c))]
    blocks = dealt.select("b.source", "block", F.array(*[shard(c) for c in range(ceiling + 1)]).alias("shard_of"))
    draw = lambda c: F.struct(F.col("shard_of")[c].alias("shard"), F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("cut")).alias("take"))
    met = placed.alias("p").join(blocks.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.block") == F.col("b.block")), "left")
    return met.select(
        "p.doc_id", "row_hash", "p.source", "size", "h", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("cut")).alias("taken"),
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), draw)).otherwise(
            F.array().cast("array<struct<shard:int,take:bigint>>")).alias("draws"),
    )


def _first_above(ends: Column, place: Column) -> Column:
    """The index of the first of some growing ends that is above a place; NULL if none is."""
    n = F.size(F.filter(ends, lambda e: e <= place))
    return F.when(n < F.size(ends), n)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end."""
    gap = r"[\x20\x09-\x0D]+"
    limit = n.cast("int") + F.when(text.rlike("^" + gap), 2).otherwise(1)
    rest = F.element_at(F.split(text, gap, limit), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), gap + "$", "")


def mix(docs: DataFrame, **params) -> DataFrame:
    """Rows of docs as often as the mix takes them, in shards, each shard in a hashed order; columns as in docs.

    The one document of a source at which its partial pass ends is cut after the last word taken.
    """
    sealed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"), F.xxhash64(*hashable(docs)).alias("whole"))
    # rows equal in (doc_id, text, source) are dealt their draws in turn; no key is NULL, so that one shuffle does for all
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("k_doc"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("k_source")]
    same = Window.partitionBy("k_doc", "k_source", "row_hash")
    plan = plan_mix(sealed, **params).select(*key, "row_hash", "size", "taken", "draws")
    plan = plan.select("k_doc", "k_source", "row_hash", "size", "draws", F.row_number().over(same.orderBy(F.col("taken").desc(), "draws")).alias("q_turn"))
    rows = sealed.select(*key, F.xxhash64("text").alias("row_hash"), "row", "doc_id", "text", "whole")
    rows = rows.withColumn("turn", F.row_number().over(same.orderBy("whole")))
    met = rows.join(plan, ["k_doc", "k_source", "row_hash"]).where(F.col("turn") - F.col("q_turn") == 0)
    drawn = met.select("row", "doc_id", "text", "size", F.xxhash64(F.lit(SEED), "doc_id", "turn").alias("own"), F.posexplode("draws").alias("copy", "draw"))
    text = F.when(F.col("draw.take") < F.col("size"), first_words(F.col("text"), F.col("draw.take"))).otherwise(F.col("text"))
    order = F.xxhash64("own", "copy")
    placed = drawn.select("row", text.alias("text"), F.col("draw.shard").alias("shard"), order.alias("order"))
    placed = placed.repartition(F.col("shard"), F.pmod("order", F.lit(8))).sortWithinPartitions("shard", "order")
    return placed.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.concat_ws(",", F.col("draws.shard").cast("array<string>")).alias("shards"),
    )
