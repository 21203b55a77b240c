"""MinHash near-dedup by DartMinHash: sparse weighted signatures and banded joining.

A text's elements are its shingles of five words (all of it, if it has fewer), with a weight each. A dart is a hashed
point of an element's half-plane of weight and rank; darts are a Poisson process of rate 1 that depends on the element
alone. The plane is cut into cells (unit steps of weight, dyadic steps of rank); a hash gives each cell's number of
darts, their weight, rank and coordinate. A text throws the darts of its elements below their weights and keeps, for
each of K coordinates, the dart of least rank. Cells are thrown by growing rank until all coordinates of a text have a
dart, which takes about K ln K + 2 K darts however many elements it has. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity.

Weights are 1 by default, so that the similarity is that of sets of shingles; ``weights="count"`` takes how often a
text has a shingle.

Equal texts are one class from the start. Bands of ROWS coordinates give buckets. Links are found in two passes.

1. Each member of a bucket is compared with the bucket's centre, its least id. That is linear, and joins almost all of a
   large group of near copies. Its links make classes.
2. What is left are pairs that share a bucket and lie in different classes; every one of them is compared, so that no
   link is lost that joins two classes. Buckets of PAIRED members at most give such pairs. The members of a larger bucket
   are dealt into blocks of about BLOCK texts and BLOCK_BYTES at most, those in the centre's class apart from the rest,
   and each two blocks, but for two of the centre's class, meet in a bounded group of their own. A pair counts in the first bucket that it shares.

Before texts are sent, signatures are compared whole: two texts of the wanted similarity agree in fewer than ``least_equal``
of 128 coordinates with a chance below 1e-7. What passes is compared exactly, by shingles. Links make classes by minimum
labels over rounds that each double their reach.

A bucket whose members are unlike each other is compared by signatures alone, at some 0.1 microseconds a pair. Where many
members lie just below the similarity, all their pairs are compared by shingles, as matrices. Both works grow with the
square of the bucket's distinct texts, but rows only with its blocks, and both are spread over its groups.

Recall: at similarity 0.8, two texts share none of the 32 bands of 4, and are so not compared, with a chance of
(1 - 0.8^4)^32 = 5e-8.

Texts are told apart by 64-bit hashes; a second one finds texts that share the first by chance, which then get ids of
their own.

Edge cases: a null text counts as an empty one; texts without words are one class; repeated rows are one class; classes
carry the smallest doc_id (null only if all are); of several rows with a class's smallest doc_id, ``dedup`` keeps the one
of the least text id, then of the least hash of all columns; an empty table gives no rows; extra columns, whatever their
names, are kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hashable, whole_text

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
LEAST_CELL = -4  # ranks below 2^-3 are one cell
PAIRED, BLOCK, BLOCK_BYTES = 32, 512, 8_000_000
VOCABULARY = 8_192  # columns of a block's matrix at a time
MOST_DARTS = 12  # of one cell: the chance of more is below 1e-8 for the largest cell that is not split

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
BASES = np.arange(1, MOST_DARTS + 2, dtype=np.uint64) * BASE


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of no white space) of all texts, and how many each text has."""
    import pandas as pd

    words, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        counts[i] = len(w)
        words += w
    if not words:
        return np.zeros(0, np.uint64), counts
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False), counts


def shingle_hashes(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Hashes of all shingles of each text, in order."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        m = max(n - k + 1, 1)
        h = np.zeros(m, np.uint64)
        for i in range(min(k, n)):
            h = mix((h ^ w[i : i + m]) + BASE)
        out.append(h)
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson(mean: float, u: np.ndarray) -> np.ndarray:
    """Numbers of darts by inversion."""
    p = total = np.exp(-mean)
    n = np.zeros(len(u), np.int8)
    for i in range(1, MOST_DARTS + 1):
        more = u >= total
        if not more.any():
            break
        n += more
        p *= mean / i
        total += p
    return n


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """One row of k dart names for each set of weighted elements; zeros for a set without weight."""
    n = len(elements)
    best, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    todo = np.array([bool((w > 0).any()) for w in weights], dtype=bool)
    if not todo.any():
        return name.reshape(n, k)
    # a row for each unit step of an element's weight; below: how much of the step counts
    weight = np.concatenate(weights)
    steps = np.maximum(np.ceil(weight), 0).astype(np.int64)
    level = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    step = mix(np.repeat(np.concatenate(elements), steps) ^ mix(level.astype(np.uint64) * BASE))
    below = np.minimum(np.repeat(weight, steps) - level, 1.0)
    owner = np.repeat(np.repeat(np.arange(n), [len(e) for e in elements]), steps)
    cell = LEAST_CELL
    while todo.any():
        now = np.ones(len(step), bool) if todo.all() else todo[owner]
        step, below, owner = step[now], below[now], owner[now]
        _throw(step, below, owner, cell, k, best, name)
        todo &= ~np.isfinite(best.reshape(n, k)).all(axis=1)
        cell += 1
    return name.reshape(n, k)


def _throw(step: np.ndarray, below: np.ndarray, owner: np.ndarray, cell: int, k: int, best: np.ndarray, name: np.ndarray) -> None:
    """The darts of one dyadic cell of ranks, cut into parts of area 1 at most; all later cells have greater ranks."""
    low = 0.0 if cell == LEAST_CELL else 2.0**cell
    width = 2.0 ** (cell + 1) - low
    parts = max(1, round(width))
    salt = mix((np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(256) + np.uint64(cell + 64)) * BASE)
    h = mix(np.repeat(step, parts) ^ np.tile(salt, len(step)))
    counts = poisson(width / parts, _unit(h))
    has, d, found = np.flatnonzero(counts), 0, []
    while len(has):
        g = mix(h[has] + BASES[d])
        row, part = np.divmod(has, parts)
        hit = _unit(mix(g ^ _MIX1)) < below[row]  # where the dart's weight lies within its step
        g, row, part = g[hit], row[hit], part[hit]
        at = owner[row] * k + (mix(g ^ _MIX2) % np.uint64(k)).astype(np.int64)
        found.append((at, low + (part + _unit(g)) * (width / parts), g))
        d += 1
        has = has[counts[has] > d]
    if not found:
        return
    at, rank, g = (np.concatenate(x) for x in zip(*found, strict=True))
    new = ~np.isfinite(best[at])
    at, rank, g = at[new], rank[new], g[new]
    order = np.argsort(-rank, kind="stable")  # the last write, of the least rank, stays
    best[at[order]], name[at[order]] = rank[order], g[order]


def weighted(hashes: np.ndarray, weights: str = "set") -> tuple[np.ndarray, np.ndarray]:
    e, c = np.unique(hashes, return_counts=True)
    return e, (c.astype(np.float64) if weights == "count" else np.ones(len(e)))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of sorted elements with weights; 1 of two empty ones."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum() + b[1].sum()) - both)


SKETCH = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("buckets", pa.list_(pa.int64())), ("coordinates", pa.binary())])
WORDLESS = 0  # the one bucket of texts without words


def least_equal(coordinates: int, similarity: float) -> int:
    """Six deviations below the number of coordinates in which two texts of the similarity agree on average."""
    return max(int(coordinates * similarity - 6 * (coordinates * similarity * (1 - similarity)) ** 0.5), 0)


def sketches(texts: DataFrame, weights: str = "set", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, size (characters), buckets (one for each band, in order), coordinates (16 bits of each) for each of (id, text)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                given = part.column(1).to_pylist()
                sets = [weighted(h, weights) for h in shingle_hashes(given)]
                sig = signatures([e for e, _ in sets], [w for _, w in sets], n_bands * rows)
                h = np.tile(mix(np.arange(1, n_bands + 1, dtype=np.uint64) * BASE), (len(sets), 1))
                for r in range(rows):
                    h = mix((h ^ sig.reshape(-1, n_bands, rows)[:, :, r]) + BASE)
                short = (sig >> np.uint64(48)).astype("<u2")
                buckets = [x if len(e) else [WORDLESS] for x, (e, _) in zip(h.view(np.int64).tolist(), sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in given], pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())], schema=SKETCH)

    return texts.select("id", "text").mapInArrow(run, "id long, size long, buckets array<long>, coordinates binary")


def _coordinates(column) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "<u2").reshape(len(cells), -1)


def promising(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the similarity out."""
    side = lambda x: sketched.select(F.col("id").alias(x), F.col("coordinates").alias(f"at_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "at_a", "at_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _coordinates(batch.column(2)), _coordinates(batch.column(3))
                good = (a == b).sum(axis=1) >= least_equal(a.shape[1], similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, weights: str = "set") -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar, exactly. texts: one row for each id, dealt by id; both
    joins read the same exchange."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                a = [weighted(h, weights) for h in shingle_hashes(part.column(2).to_pylist())]
                b = [weighted(h, weights) for h in shingle_hashes(part.column(3).to_pylist())]
                alike = pa.array([jaccard(x, y) >= similarity for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(alike)

    return both.mapInArrow(run, "a long, b long")


def units(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A set whose intersections have the size of the least weights: an element for each unit of weight."""
    n = weights.astype(np.int64)
    level = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(elements, n) ^ mix(level.astype(np.uint64) * BASE))


def similarities(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Jaccard similarities of the first sets (rows) and the others (columns); of all with all if all are first."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    at, owner = (np.cumsum(n > 1) - 1)[at[shared]], np.repeat(np.arange(len(sets)), sizes)[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    rows, columns = slice(first), slice(first if first < len(sets) else 0, None)
    both = np.zeros((len(sizes[rows]), len(sizes[columns])))
    for lo in range(0, int((n > 1).sum()), VOCABULARY):
        l, r = np.searchsorted(at, [lo, lo + VOCABULARY])
        m = np.zeros((len(sets), VOCABULARY), np.float32)
        m[owner[l:r], at[l:r] - lo] = 1
        both += m[rows] @ m[columns].T
    if first == len(sets):
        np.fill_diagonal(both, sizes)
    either = sizes[rows][:, None] + sizes[columns][None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def group_labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each member reaches by the links of a symmetric matrix."""
    a, b = np.nonzero(linked)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


def dealt_blocks(large: DataFrame) -> DataFrame:
    """bucket, i, j, id, label, first for the members of each two blocks that may hold links between classes: blocks of
    the centre's class come before the others, and no two of them meet. large: bucket, id, size, label, main."""
    is_main = F.col("label") == F.col("main")
    needed = lambda these: F.ceil(F.greatest(F.sum(these.cast("int")) / BLOCK, F.sum(F.when(these, F.col("size"))) / BLOCK_BYTES)).cast("int")
    large = large.join(large.groupBy("bucket").agg(needed(is_main).alias("n_main"), needed(~is_main).alias("n_rest")), "bucket")
    n_main, n_rest = F.col("n_main"), F.col("n_rest")
    h = F.xxhash64(F.lit(7), "id")
    block = F.when(is_main, F.pmod(h, n_main)).otherwise(n_main + F.pmod(h, n_rest)).cast("int")
    others = F.sequence(F.when(is_main, n_main).otherwise(F.lit(0)), n_main + n_rest - 1)
    dealt = large.select("bucket", "id", "label", block.alias("block"), F.explode(others).alias("other"))
    return dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", (F.col("block") <= F.col("other")).alias("first"))


def _sides(table: pa.Table) -> tuple[pa.Table, int]:
    """The members of the first block before those of the second, and how many the first has."""
    first = table.column("first").to_numpy(zero_copy_only=False)
    return table.take(pa.array(np.argsort(~first, kind="stable"))), int(first.sum())


def _across(label: np.ndarray, m: int) -> np.ndarray:
    """Whether members of the first block (rows) and the second (columns; the first again if there is none) differ in class."""
    return label[:m, None] != label[m if m < len(label) else 0 :][None, :]


def promising_members(groups: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The members of groups that have a partner there, by signatures, in a class other than their own."""

    def run(table: pa.Table) -> pa.Table:
        table, m = _sides(table)
        lo = m if m < table.num_rows else 0
        due = _across(table.column("label").to_numpy(), m)
        if due.any():
            at = _coordinates(table.column("coordinates"))
            equal = np.zeros(due.shape, np.int32)
            for c in range(at.shape[1]):
                equal += at[:m, c][:, None] == at[lo:, c][None, :]
            due &= equal >= least_equal(at.shape[1], similarity)
        if due.any():
            buckets = table.column("buckets").to_pylist()
            here = buckets[0].index(table.column("bucket")[0].as_py())
            earlier = np.array([b[:here] for b in buckets], np.int64).reshape(len(buckets), -1)
            for c in range(here):
                due &= earlier[:m, c][:, None] != earlier[lo:, c][None, :]
        has = np.zeros(table.num_rows, bool)
        has[:m] = due.any(axis=1)
        has[lo:] |= due.any(axis=0)
        return table.select(["bucket", "i", "j", "id", "label", "first"]).filter(pa.array(has))

    full = groups.join(sketched.select("id", "buckets", "coordinates"), "id")
    return full.groupBy("bucket", "i", "j").applyInArrow(run, "bucket long, i int, j int, id long, label long, first boolean")


def linked_members(groups: DataFrame, texts: DataFrame, similarity: float, weights: str = "set") -> DataFrame:
    """Links (a, b) that join the members of each group as all its links between classes do."""

    def run(table: pa.Table) -> pa.Table:
        table, m = _sides(table)
        ids, label, n = table.column("id").to_numpy(), table.column("label").to_numpy(), table.num_rows
        lo, linked = m if m < n else 0, np.zeros((n, n), bool)
        if 0 < m:
            sets = [units(*weighted(h, weights)) for h in shingle_hashes(table.column("text").to_pylist())]
            linked[:m, lo:] = _across(label, m) & (similarities(sets, m) >= similarity)
            linked |= linked.T
        least = group_labels(linked, ids)
        has = least != ids
        return pa.table({"a": ids[has], "b": least[has]})

    return groups.join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, label for each id in links (a, b): label is the least id that links reach. In each round every id takes the
    least label of its neighbours, then that label's own label, so that long chains shrink by half."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(step.join(far, "label").select("id", "old", F.least("label", "far").alias("label")))
        changed = not new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError("classes need more rounds")


def text_ids(docs: DataFrame) -> DataFrame:
    """docs with id: a hash of the text, another one for a text that shares it with a text of lesser second hash."""
    text = whole_text()
    both = docs.select(F.xxhash64(text).alias("__one"), F.xxhash64(F.lit(1), text).alias("__two"))
    clash = cut_lineage(both.groupBy("__one").agg(F.min("__two").alias("__least"), F.max("__two").alias("__most")).where(F.col("__least") < F.col("__most")).select("__one", "__least"))
    if clash.isEmpty():
        return docs.withColumn("id", F.xxhash64(text))
    kept = docs.withColumn("__one", F.xxhash64(text)).join(clash, "__one", "left")
    two = F.xxhash64(F.lit(1), text)
    return kept.withColumn("id", F.when(F.col("__least") < two, F.xxhash64("__one", two)).otherwise(F.col("__one"))).drop("__one", "__least")


def _class_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(components(links), "id", "left").select(*ids.columns, F.coalesce("label", "id").alias("label"))


def text_classes(texts: DataFrame, similarity: float = SIMILARITY, weights: str = "set", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links (a, b) whose components are the classes of texts (id, text), a row for each id."""
    sketched = cut_lineage(sketches(texts, weights, n_bands, rows))
    found = sketched.select("id", F.explode("buckets").alias("bucket"))
    centres = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where(F.col("n") > 1)
    met = cut_lineage(found.join(centres, "bucket").select("bucket", "id", "n", "centre"))
    stars = met.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    near = cut_lineage(verified(promising(stars, sketched, similarity), texts, similarity, weights))

    known = _class_of(near, met)
    main = known.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.min_by("label", "id").alias("main"))
    mixed = cut_lineage(known.join(main.where(F.col("one") < F.col("other")).select("bucket", "main"), "bucket").select("bucket", "id", "n", "label", "main"))
    small = mixed.where(F.col("n") <= PAIRED).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("at"))
    rest = F.slice("at", F.lit(2), F.size("at"))  # all are compared with the first already
    pairs = small.select(F.explode(rest).alias("x"), rest.alias("at")).select(
        F.col("x.id").alias("a"), F.explode(F.filter("at", lambda y: (y["id"] > F.col("x.id")) & (y["label"] != F.col("x.label")))["id"]).alias("b")
    ).distinct()
    more = verified(promising(pairs, sketched, similarity), texts, similarity, weights)
    if not mixed.where(F.col("n") > PAIRED).isEmpty():
        large = mixed.where(F.col("n") > PAIRED)
        sized = large.join(sketched.select("id", "size"), "id")
        groups = cut_lineage(promising_members(dealt_blocks(sized), sketched, similarity))
        more = more.unionAll(linked_members(groups, texts, similarity, weights))
    return near.unionAll(cut_lineage(more)) if not mixed.isEmpty() else near


def classes(docs: DataFrame, **params) -> DataFrame:
    """id, label, class_id for each distinct text: class_id is the least doc_id of the text's class, label is the same for
    all texts of a class."""
    return classes_of_ids(text_ids(docs.select("doc_id", "text")), **params)


def classes_of_ids(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "set", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``classes`` of docs that have the id of their text."""
    texts = docs.select("id", whole_text().alias("text")).dropDuplicates(["id"])
    links = text_classes(texts, similarity, weights, n_bands, rows)
    owners = docs.groupBy("id").agg(F.min(F.col("doc_id").cast("long")).alias("owner"))
    joined = cut_lineage(_class_of(links, owners))
    least = joined.groupBy("label").agg(F.min("owner").alias("class_id"))
    return joined.join(least, "label").select("id", "label", "class_id")


def dedup(docs: DataFrame, **params) -> DataFrame:
    """One row of docs for each class; columns as in docs."""
    keys = hashable(docs)
    named = text_ids(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"), F.xxhash64(*keys).alias("h")))
    known = classes_of_ids(named, **params)
    first = named.select("id", "row", "h", F.col("doc_id").cast("long").alias("doc")).join(known, "id").where(F.col("doc").eqNullSafe(F.col("class_id")))
    return first.groupBy("label").agg(F.min_by("row", F.struct("id", "h")).alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = text_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "id").join(classes_of_ids(docs), "id").select("doc_id", "class_id")
