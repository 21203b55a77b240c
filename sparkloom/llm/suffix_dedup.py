"""Exact removal of repeated byte strings by prefix-free parsing and the suffix array of its dictionary.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Parsing. In every string of LENGTH bytes the TRIGGER-byte substring with the least rolling hash is its trigger. Strings
that follow each other share triggers, so a document falls into overlapping phrases: a phrase is a trigger with all
strings it serves, at most 2 LENGTH - TRIGGER bytes. Both are decided by content alone, so a passage is parsed alike
wherever it stands, but for its ends. The dictionary is the set of distinct phrases, each with the smallest doc_id that
has it; the parse of a document is its sequence of phrases.

Order. Equal strings have equal triggers, so the dictionary is ordered by parts, a part for each range of trigger hashes.
Within a part, phrases are sorted by their bytes, and equal ones are one entry; then the suffixes of the entries are
sorted by their bytes to a depth of LENGTH: the part's suffix array. Neighbours that agree to that depth are one string;
its smallest doc_id is handed along the parse to all its places. Phrases overlap by LENGTH - 1 bytes, so that every string
lies within one phrase, and suffixes are never compared beyond their phrase's end: that comparison, across phrases, is
what a suffix array of the parse is for, and at this depth it has nothing to decide. So none is built.

Hashes only choose triggers, deal phrases to parts and set aside the phrases whose trigger is in one document alone;
equality is always that of bytes.

Exchange. Documents are dealt into groups of some megabytes. Each group tells the parts its distinct triggers, six bytes
each, and learns which are in several documents; of these it sends the distinct phrases (not each of their occurrences),
and gets back which of their strings go. So a passage that a third of all documents share is sent once by each group.

Edge cases: a null or empty text, or one under LENGTH bytes, is kept as it is; repeated rows (one doc_id) do not remove
each other; a null doc_id is larger than any other; an empty table gives no rows; extra columns are ignored; texts of
any length are parsed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

LENGTH, TRIGGER = 50, 20
WIDEST = 2 * LENGTH - TRIGGER  # bytes of a phrase
MOST = LENGTH - TRIGGER + 1  # strings of a phrase
GROUP_BYTES = 8_000_000
CHUNK_BYTES = 131_072  # hashed at a time: arrays of eight bytes each stay in the cache
LAST_ID = 2**63 - 1
_U = np.uint64
_RANDOM = np.random.default_rng(987_654_321).integers(0, 2**64, 256, dtype=np.uint64)
_C1, _C2, _C3 = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * _C1
    x ^= x >> _U(32)
    x += b
    x *= _C2
    x ^= x >> _U(29)
    return x


def _ladder(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 2, 4, 8, 16 and 32 bytes from each place on."""
    h, out = _RANDOM[data], {}
    for n in (1, 2, 4, 8, 16):
        h = _pair(h[:-n], h[n:]) if len(h) > n else np.zeros(0, _U)
        out[2 * n] = h
    return out


def string_hashes(data: np.ndarray, ladder: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the LENGTH bytes from each place on."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = ladder or _ladder(data)
    return _pair(_pair(h[32][:n], h[16][32 : 32 + n]), h[2][48 : 48 + n])


def parse(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of documents that lie end to end in data: trigger, phrase hash, document, first string, number of strings.

    ends: where each document ends.
    """
    out, begin, first = [], 0, 0
    while first < len(ends):  # runs of documents of about CHUNK_BYTES; a longer document is a run of its own
        last = int(np.searchsorted(ends, begin + CHUNK_BYTES, side="right"))
        last = max(last, first + 1)
        out.append(_parse_run(data[begin : ends[last - 1]], ends[first:last] - begin, begin, first))
        begin, first = int(ends[last - 1]), last
    if not out:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse_run(data: np.ndarray, ends: np.ndarray, begin: int, first: int):
    n = len(data) - LENGTH + 1
    empty = (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n <= 0:
        return empty
    ladder = _ladder(data)
    m = len(data) - TRIGGER + 1
    grams = _pair(ladder[16][:m], ladder[4][16 : 16 + m])
    bits = int(len(data)).bit_length()
    low = _U((1 << bits) - 1)
    least = (grams & ~low) | np.arange(m, dtype=_U)
    width, span = LENGTH - TRIGGER + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :]) if span < width else least
    at = (least & low).astype(np.int64)  # of the string's trigger, for each string
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    good = np.arange(n) + LENGTH <= ends[doc]
    strings = np.flatnonzero(good)
    if not len(strings):
        return empty
    trigger = at[strings]
    new = np.ones(len(strings), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[strings[1:]] != doc[strings[:-1]])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(strings)))
    lo = strings[start]
    whole = string_hashes(data, ladder)
    phrase = _pair(_pair(whole[lo], whole[lo + count - 1]), count.astype(_U) + _C3)
    return grams[trigger[start]], phrase, doc[lo] + first, lo + begin, count


def _six(x: np.ndarray) -> bytes:
    """The upper 48 bits of each."""
    return np.ascontiguousarray((x >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes | memoryview, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    return out.reshape(-1).view(_U)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: planes of zeros compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes | memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view("<i8")


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data has the same bytes from a and from b on, for so many bytes each."""
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), 50_000):
        n = size[lo : lo + 50_000]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(a[lo : lo + 50_000], n) + step] == data[np.repeat(b[lo : lo + 50_000], n) + step]
        out[lo : lo + 50_000] = np.add.reduceat(equal, first) == n
    return out


class Group:
    """The documents of one group, parsed."""

    def __init__(self, table: pa.Table, buckets: int):
        order = np.argsort(table.column("__order").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.doc_ids = table.column("doc_id").to_pylist()
        self.order = table.column("__order").to_numpy()
        raw = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        del raw, table
        self.trigger, self.phrase, doc, self.first, self.count = parse(self.data, self.ends)
        self.at = self.order[doc]  # of each occurrence; it grows, as documents are in order
        # distinct triggers by bucket, and whether several documents of this group have them
        t, first, inverse = np.unique(self.trigger, return_index=True, return_inverse=True)
        last = np.empty(len(t), np.int64)
        last[inverse.reshape(-1)] = np.arange(len(self.trigger))
        bucket = (t >> _U(32)) % _U(max(buckets, 1))
        by = np.argsort(bucket, kind="stable")
        self.several, self.distinct = (self.at[first] < self.at[last])[by], t[by]
        rank = np.empty(len(t), np.int64)
        rank[by] = np.arange(len(t))
        self.kind = rank[inverse.reshape(-1)]  # of each occurrence
        self.cuts = np.searchsorted(bucket[by], np.arange(buckets + 1).astype(_U))
        self.buckets = buckets

    def triggers(self):
        """(bucket, blob) of the distinct triggers."""
        for b in np.flatnonzero(np.diff(self.cuts)):
            rows = slice(self.cuts[b], self.cuts[b + 1])
            yield int(b), np.packbits(self.several[rows]).tobytes() + _six(self.distinct[rows])

    def learn(self, replies: list[tuple[int, bytes]]) -> None:
        """Takes which triggers are shared, and finds the distinct phrases of these, each at its first occurrence."""
        shared = np.zeros(len(self.distinct), bool)
        for b, blob in replies:
            shared[self.cuts[b] + np.frombuffer(blob, "<u4")] = True
        self.used = np.flatnonzero(shared[self.kind])
        size = self.count[self.used] + LENGTH - 1
        names = _pair(self.trigger[self.used], self.phrase[self.used])
        _, at, inverse = np.unique(names, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        leader = at[inverse]
        copies = np.flatnonzero(leader != np.arange(len(leader)))
        same = size[copies] == size[leader[copies]]
        same[same] = _same_bytes(self.data, self.first[self.used[copies[same]]], self.first[self.used[leader[copies[same]]]], size[copies[same]])
        # a phrase that only shares the hash of another is an entry of its own, wherever it occurs
        odd = copies[~same]
        inverse[odd] = len(at) + np.arange(len(odd))
        at = np.append(at, odd)
        # in a bucket, phrases lie as they first occur: the column of doc_ids is in order and takes next to no room
        by_place = np.argsort(at)
        bucket = (self.trigger[self.used[at[by_place]]] >> _U(32)) % _U(max(self.buckets, 1))
        by_bucket = by_place[np.argsort(bucket, kind="stable")]
        self.entry = self.used[at[by_bucket]]  # the first occurrence of each distinct phrase
        rank = np.empty(len(at), np.int64)
        rank[by_bucket] = np.arange(len(at))
        self.member = rank[inverse]  # the distinct phrase of each used occurrence
        self.entry_cuts = np.searchsorted((self.trigger[self.entry] >> _U(32)) % _U(max(self.buckets, 1)), np.arange(self.buckets + 1).astype(_U))

    def phrases(self):
        """(bucket, blob) of the distinct phrases whose triggers are shared."""
        for b in np.flatnonzero(np.diff(self.entry_cuts)):
            rows = self.entry[self.entry_cuts[b] : self.entry_cuts[b + 1]]
            size = self.count[rows] + LENGTH - 1
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text = self.data[np.repeat(self.first[rows], size) + step]
            yield int(b), np.array([len(rows)], "<u4").tobytes() + self.count[rows].astype(np.uint8).tobytes() + _six(self.trigger[rows]) + _planes(self.at[rows]) + text.tobytes()

    def removed(self, replies: list[tuple[int, bytes]]) -> np.ndarray:
        """Whether each byte goes."""
        n = len(self.data)
        edges = np.zeros(n + 1, np.int32)

        def cover(first: np.ndarray, last: np.ndarray) -> None:
            nonlocal edges
            edges += np.bincount(first, minlength=n + 1).astype(np.int32) - np.bincount(last, minlength=n + 1).astype(np.int32)

        mask = np.zeros(len(self.entry), np.uint32)
        for b, blob in replies:
            m = len(blob) // 8
            mask[self.entry_cuts[b] + np.frombuffer(blob, "<u4", m)] = np.frombuffer(blob, "<u4", m, 4 * m)
        later = self.at[self.used] > self.at[self.entry[self.member]]  # a smaller document of this group has the phrase
        whole = self.used[later]
        cover(self.first[whole], self.first[whole] + self.count[whole] + LENGTH - 1)
        bits = np.where(later, 0, mask[self.member])
        some = np.flatnonzero(bits)
        first, bits = self.first[self.used[some]], bits[some]
        starts = [first[(bits >> j) & 1 > 0] + j for j in range(MOST)]
        start = np.concatenate(starts)
        cover(start, start + LENGTH)
        return np.cumsum(edges[:-1]) > 0

    def kept(self, replies: list[tuple[int, bytes]]) -> pa.Table:
        """A row for each document: what is left of it, and the runs that go."""
        gone = self.removed(replies)
        kept, spans, lo, sizes = [], [], 0, []
        for hi in self.ends.tolist():
            mask = gone[lo:hi]
            edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)) if len(mask) else np.zeros(0, np.int64)
            kept.append(self.data[lo:hi][~mask].tobytes())
            spans.append(edge.tolist())
            sizes.append(hi - lo)
            lo = hi
        return pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int64()))})


def share_triggers(table: pa.Table) -> pa.Table:
    """One bucket: for each sender the triggers that several documents have."""
    senders, blobs = table.column("g").to_pylist(), table.column("blob").to_pylist()
    sizes = [_trigger_count(len(b)) for b in blobs]
    trigger = np.concatenate([_unsix(memoryview(b)[-6 * n :], n) for b, n in zip(blobs, sizes, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8)), count=n) for b, n in zip(blobs, sizes, strict=True)]) > 0
    order = np.argsort(trigger, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = trigger[order][1:] != trigger[order][:-1]
    first = np.flatnonzero(new)
    shared = np.logical_or.reduceat(several[order], first) | (np.diff(np.append(first, len(order))) > 1)
    tell = np.empty(len(order), bool)
    tell[order] = shared[np.cumsum(new) - 1]
    cuts = np.cumsum([0, *sizes])
    out = [np.flatnonzero(tell[lo:hi]).astype("<u4").tobytes() or None for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return _replies(senders, table.column("b").to_pylist(), out)


def _trigger_count(size: int) -> int:
    """How many triggers of six bytes and a bit each a blob of this size has."""
    return size * 8 // 49


def _word(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as numbers that order as the bytes do."""
    w = flat[at].astype(_U)
    for k in range(1, 8):
        w = (w << _U(8)) | flat[at + k]
    return w


def dictionary(phrases: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each phrase (rows of bytes, zeros beyond their ends), and one phrase of each entry, in byte order."""
    words = np.ascontiguousarray(phrases).view(">u8")
    order = np.lexsort((count, *words.T[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1) | (count[order[1:]] != count[order[:-1]])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return entry, order[new]


def suffix_array(entries: np.ndarray, row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of entries from offset on, in the order of their first LENGTH bytes, and where a new string begins in
    that order. Ties are broken by eight bytes at a time."""
    flat = np.concatenate([entries.reshape(-1), np.zeros(8, np.uint8)])
    at = row * entries.shape[1] + offset
    key = _word(flat, at)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for depth in range(8, LENGTH, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        run, these = np.cumsum(new)[place], order[place]
        key = _word(flat, at[these] + depth)
        if depth + 8 > LENGTH:
            key >>= _U(8 * (depth + 8 - LENGTH))
        by = np.lexsort((key, run))
        order[place] = these[by]
        key = key[by]
        new[place[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
    return order, new


def order_strings(table: pa.Table) -> pa.Table:
    """One part of the dictionary: for each sender its phrases with strings that a smaller doc_id has, and which."""
    senders, blobs = table.column("g").to_pylist(), table.column("blob").to_pylist()
    sizes = [int(np.frombuffer(b, "<u4", 1)[0]) for b in blobs]
    count = np.concatenate([np.frombuffer(b, np.uint8, n, 4) for b, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
    trigger = np.concatenate([_unsix(memoryview(b)[4 + n : 4 + 7 * n], n) for b, n in zip(blobs, sizes, strict=True)])
    doc = np.concatenate([_unplanes(memoryview(b)[4 + 7 * n : 4 + 15 * n], n) for b, n in zip(blobs, sizes, strict=True)])
    text = np.concatenate([np.frombuffer(b, np.uint8, offset=4 + 15 * n) for b, n in zip(blobs, sizes, strict=True)])
    phrases = np.zeros((len(count), WIDEST), np.uint8)
    phrases[np.arange(WIDEST) < (count + LENGTH - 1)[:, None]] = text
    del text
    entry, leader = dictionary(phrases, count)
    least = np.full(len(leader), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, doc)
    # suffixes are sorted for triggers of several entries; the one entry of another trigger has its own doc_id throughout
    _, kind, n = np.unique(trigger[leader], return_inverse=True, return_counts=True)
    mixed_entries = np.flatnonzero(n[kind.reshape(-1)] > 1)
    known = np.repeat(least[:, None], MOST, axis=1)
    rows = np.repeat(mixed_entries, count[leader[mixed_entries]])
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(count[leader[mixed_entries]]) - count[leader[mixed_entries]], count[leader[mixed_entries]])
    if len(rows):
        order, new = suffix_array(phrases[leader], rows, offset)
        smallest = np.minimum.reduceat(least[rows[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        known[rows[order], offset[order]] = smallest
    out, lo = [], 0
    for n in sizes:
        hit = (known[entry[lo : lo + n]] < doc[lo : lo + n, None]) & (np.arange(MOST) < count[lo : lo + n, None])
        mask = (hit.astype(np.uint32) << np.arange(MOST, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        i = np.flatnonzero(mask)
        out.append(i.astype("<u4").tobytes() + mask[i].astype("<u4").tobytes() if len(i) else None)
        lo += n
    return _replies(senders, table.column("b").to_pylist(), out)


def _replies(senders: list[int], buckets: list[int], blobs: list[bytes | None]) -> pa.Table:
    keep = [i for i, x in enumerate(blobs) if x is not None]
    return pa.table({"g": pa.array([senders[i] for i in keep], pa.int32()), "b": pa.array([buckets[i] for i in keep], pa.int32()), "blob": pa.array([blobs[i] for i in keep], pa.binary())})


SENT = "g int, b int, blob binary"


def _sent(g: int, made) -> pa.Table:
    made = list(made)
    return pa.table({"g": pa.array([g] * len(made), pa.int32()), "b": pa.array([b for b, _ in made], pa.int32()), "blob": pa.array([x for _, x in made], pa.binary())})


def _blobs(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = zip(table.column("kind").to_pylist(), table.column("b").to_pylist(), table.column("blob").to_pylist(), strict=True)
    return [(b, x) for k, b, x in rows if k == kind]


def dedup_spans(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, kept (bytes) and spans (starts and ends of removed runs, in turn) for each row of docs."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes), 1)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(9), "doc_id", F.xxhash64("text")), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__order"), whole_text().alias("text"),
    )

    def send_triggers(table: pa.Table) -> pa.Table:
        return _sent(table.column("g")[0].as_py(), Group(table, groups).triggers())

    def send_phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent(0, [])
        group = Group(left, groups)
        group.learn(_blobs(right, 1))
        return _sent(left.column("g")[0].as_py(), group.phrases())

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in KEPT})
        group = Group(left, groups)
        group.learn(_blobs(right, 1))
        return group.kept(_blobs(right, 2))

    by_group = dealt.groupBy("g")
    first = dealt.groupBy("g").applyInArrow(send_triggers, SENT).groupBy("b").applyInArrow(share_triggers, SENT)
    first = first.select("g", F.lit(1).alias("kind"), "b", "blob")
    second = by_group.cogroup(first.groupBy("g")).applyInArrow(send_phrases, SENT).groupBy("b").applyInArrow(order_strings, SENT)
    both = first.unionAll(second.select("g", F.lit(2).alias("kind"), "b", "blob"))
    return dealt.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(finish, "doc_id long, n_bytes long, kept binary, spans array<long>")


KEPT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))]


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    made = dedup_spans(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
