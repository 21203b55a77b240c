"""Packing token sequences by non-negative least squares over a histogram of lengths.

A document of n ids (its end id included) gives n // window full windows. Its remainder is cut into a body, a multiple
of GRAIN ids, and a tail of fewer. Bodies fall into window / GRAIN length bins. All shallow combinations of bins that
fill a window exactly are enumerated; non-negative least squares finds how often to repeat each so that the histogram of
bodies is used up; the counts are rounded down and topped up greedily. Bodies that no combination uses, and all tails,
form one residual stream that is packed greedily: it is laid end to end and cut at every window. So only the last
window of the stream is padded.

No task holds more than one partition's rows: a piece's place is a closed form of its rank within its bin, and ranks
are local ranks plus offsets by partition (a table that rows are joined to; only the counts of each bin reach the driver).

Edge cases: a null or empty text is the end id alone; repeated rows are packed as separate documents; an empty table
gives no pieces; extra columns are ignored; a text of any length is tokenized whole.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, whole_text, written

WINDOW = 2048
GRAIN = 32
DEPTH = 3
END_ID = 1
CACHE_WORDS = 500_000
LONGEST_CACHED = 48

_encoders: dict[str, Encoder] = {}

#: Letters up to U+024F, all that this tokenizer takes for letters there.
LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Runs of letters; runs without letters and apostrophes; from such a run's start to white space if an apostrophe follows.
PIECES = re.compile(f"[{LETTERS}]+|[^{LETTERS} \t\n\r']++(?!')|[^ \t\n\r]+")
#: Characters that normalisation may change otherwise than lower() does, or that lower() takes out of the range.
ODD = re.compile("[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
SPACES = re.compile("[ \t\n\r]+")
#: What the names of this tokenizer's special tokens end with.
SPECIAL = "oftext|>"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    White space separates words for this tokenizer, and so do the ends of runs of letters, but for the apostrophes of
    contractions: from such an apostrophe's run to the next white space a word is one piece. So the ids of a text are those
    of its pieces in turn, and a piece's ids are kept once they are known. Texts are lower-cased whole; a word with
    an odd character or a special token's name stays as it is and is a piece of its own. Runs of letters are encoded many at a time
    by a tokenizer without normalisation, and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, pieces: set[str], group: int = 200) -> None:
        runs = [p for p in pieces if p.isalpha() and (p.isascii() or not ODD.search(p))]
        groups = [runs[i : i + group] for i in range(0, len(runs), group)]
        for words, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) != len(words) + 1:
                self.known.update(zip(words, self._encode(words), strict=True))
                continue
            data = ids.tobytes()
            self.known.update(zip(words, [data[lo:hi] for lo, hi in itertools.pairwise(cuts)], strict=True))
        rest = list(pieces.difference(runs))
        self.known.update(zip(rest, self._encode(rest), strict=True))

    def forget(self) -> None:
        """A worker lives on after its task; what it knew of words need not."""
        self.known = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        low = text.lower()
        if SPECIAL not in low and (text.isascii() or not ODD.search(text)):
            return PIECES.findall(low)
        out = []
        for word in SPACES.split(text):
            low = word.lower()
            if SPECIAL in low or ODD.search(word):
                out.append(word)
            else:
                out += PIECES.findall(low)
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = set().union(*split).difference(known)
        self._learn(fresh)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in fresh:
            if len(p) > LONGEST_CACHED:
                del known[p]
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def shift_crc(crc: int, n_bytes: int) -> int:
    """What a CRC-32 contributes once n_bytes more bytes follow: crc(a + b) = shift_crc(crc(a), len(b)) ^ crc(b)."""
    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    square = lambda m: [times(m, x) for x in m]
    m, bits = one_bit, n_bytes * 8
    while bits:
        if bits & 1:
            crc = times(m, crc)
        m, bits = square(m), bits >> 1
    return crc


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


TOKEN_SCHEMA = (
    "doc_id long, doc_tokens long, part int, full_crcs array<long>, bin int, bin_rank long, body_crcs binary, "
    "tail binary, tail_start long, full_start long"
)


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """One row for each document: counts and CRCs of what it is cut into, with ranks within the partition.

    body_crcs: CRC-32 of the body's first 1, 2, ... grains as unsigned 32-bit numbers; tail: ids after the body.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        ranks, tail_start, full_start = [0] * (window // grain), 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                rows = []
                for doc_id, data in zip(ids[lo:hi], enc.batch(texts[lo:hi]), strict=True):
                    data += end
                    n = len(data) // 4
                    full, rest = divmod(n, window)
                    crcs = [zlib.crc32(data[i * window * 4 : (i + 1) * window * 4]) for i in range(full)]
                    q, tail = divmod(rest, grain)
                    at, crc, steps = full * window * 4, 0, []
                    for _ in range(q):
                        crc = zlib.crc32(data[at : at + grain * 4], crc)
                        steps.append(crc)
                        at += grain * 4
                    rows.append((doc_id, n, part, crcs, q, ranks[q], np.array(steps, dtype="<u4").tobytes(), data[at:], tail_start, full_start))
                    ranks[q] += 1
                    tail_start += tail
                    full_start += full
                yield _batch(rows, TOKEN_TYPES)
        enc.forget()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, TOKEN_SCHEMA)
    return out


TOKEN_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("full_crcs", pa.list_(pa.int64())), ("bin", pa.int32()),
    ("bin_rank", pa.int64()), ("body_crcs", pa.binary()), ("tail", pa.binary()), ("tail_start", pa.int64()), ("full_start", pa.int64()),
])


def _slices(texts: list[str], most: int = 1_000_000):
    """Runs of texts of about so many characters: what is held at once stays small."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most depth bins that sum to bins exactly (a window alone is no combination)."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        low = prefix[-1] if prefix else 1
        if prefix and left >= low:
            out.append((*prefix, left))
        if len(prefix) + 2 <= depth:
            for b in range(low, left // 2 + 1):
                grow((*prefix, b), left - b)

    grow((), bins)
    return sorted({c for c in out if len(c) <= depth})


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Active-set solution of min |a x - b| with x >= 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if not np.isfinite(gradient[j]) or gradient[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return np.maximum(x, 0)


def repeats(histogram: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Combinations and how often each is used, never more than the histogram (by bin, from 0) has."""
    bins = len(histogram)
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for q in c:
            a[q, j] += 1
    have = histogram.astype(np.int64).copy()
    have[0] = 0
    scale = max(1, int(have.max()))
    times = np.floor(non_negative_least_squares(a, have / scale) * scale + 1e-6).astype(np.int64) if have.any() else np.zeros(len(combos), np.int64)
    need = a.astype(np.int64)
    for j in np.argsort(-times):  # rounding of an inexact fit may ask for more than there is
        used = need[:, j]
        times[j] = min([times[j], *(have[used > 0] // used[used > 0])])
        have -= used * times[j]
    for j in range(len(combos)):  # top up
        used = need[:, j]
        more = int(min(have[used > 0] // used[used > 0]))
        times[j] += more
        have -= used * more
    return combos, times


class Places:
    """Where the piece of a given rank in a bin, or of the residual stream, goes."""

    def __init__(self, histogram: np.ndarray, full: int, tails: int, window: int, grain: int, depth: int):
        self.window, self.grain = window, grain
        combos, times = repeats(histogram, depth)
        self.first = np.cumsum([0, *times])[:-1] + full  # sequence of each combination's first window
        self.slots: dict[int, list[tuple[int, int, int, int, int]]] = {}  # bin: (first rank, combination, slots, first offset, windows)
        self.used = np.zeros(len(histogram), dtype=np.int64)
        for j, c in enumerate(combos):
            if not times[j]:
                continue
            offset = 0
            for q, same in itertools.groupby(c):
                m = len(list(same))
                self.slots.setdefault(q, []).append((int(self.used[q]), j, m, offset, int(times[j])))
                self.used[q] += m * int(times[j])
                offset += m * q * grain
        self.stream = full + int(times.sum())  # the stream's first sequence
        left = np.maximum(histogram - self.used, 0)
        left[0] = 0
        self.base = np.cumsum([0, *(left * np.arange(len(histogram)) * grain)])
        self.tails = int(self.base[-1])

    def body(self, q: int, rank: int) -> tuple[int, int] | int:
        """(sequence, offset), or the place in the stream."""
        if rank >= self.used[q]:
            return int(self.base[q]) + (rank - int(self.used[q])) * q * self.grain
        slots = self.slots[q]
        i = int(np.searchsorted([s[0] for s in slots], rank, side="right")) - 1
        low, j, m, offset, _ = slots[i]
        window, k = divmod(rank - low, m)
        return int(self.first[j]) + window, offset + k * q * self.grain


PIECE_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = cut_lineage(tokenized(docs, path, window, grain))
    bins = window // grain
    upto = lambda c, by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each part and bin, and for each part: counts, and what the parts before hold, by windows over one bin each
    by_bin = rows.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"))
    by_part = rows.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("full"), F.sum((F.length("tail") / 4).cast("long")).alias("tails"))
    streams = by_part.select("part", F.explode(F.create_map(F.lit(-1), "full", F.lit(-2), "tails")).alias("bin", "n"))
    counted = written(by_bin.unionAll(streams.select("part", "bin", "n")).withColumn("before", upto(F.col("n"), ["bin"])))
    totals = {r["bin"]: int(r["n"]) for r in counted.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # bins + 2 rows at most
    places = Places(np.array([totals.get(q, 0) for q in range(bins)], dtype=np.int64), totals.get(-1, 0), totals.get(-2, 0), window, grain, depth)
    of = lambda q, name: counted.where(F.col("bin") == q).select("part", F.col("before").alias(name))
    offsets = written(counted.where("bin >= 0").select("part", "bin", F.col("before").alias("bin_offset")).join(of(-1, "full_offset"), "part").join(of(-2, "tail_offset"), "part"))
    rows = rows.join(offsets, ["part", "bin"])

    def place(batches):
        for batch in batches:
            pieces = []
            for r in batch.to_pylist():
                bin_offset, full_offset, tail_offset = r["bin_offset"], r["full_offset"], r["tail_offset"]
                n, doc, q, start = r["doc_tokens"], r["doc_id"], r["bin"], 0
                for i, crc in enumerate(r["full_crcs"]):
                    pieces.append((doc, start, window, crc, n, full_offset + r["full_start"] + i, 0))
                    start += window
                if q:
                    at, steps = places.body(q, bin_offset + r["bin_rank"]), np.frombuffer(r["body_crcs"], dtype="<u4")
                    if isinstance(at, tuple):
                        pieces.append((doc, start, q * grain, int(steps[-1]), n, *at))
                        start += q * grain
                    else:
                        done, crc_done = 0, 0
                        while done < q * grain:  # the stream is cut at windows, here always at whole grains
                            sequence, offset = divmod(at + done, window)
                            take = min(q * grain - done, window - offset)
                            upto = int(steps[(done + take) // grain - 1])
                            pieces.append((doc, start, take, upto ^ shift_crc(crc_done, take * 4), n, places.stream + sequence, offset))
                            done, start, crc_done = done + take, start + take, upto
                tail, done = r["tail"], 0
                at = places.tails + tail_offset + r["tail_start"]
                while done < len(tail) // 4:
                    sequence, offset = divmod(at + done, window)
                    take = min(len(tail) // 4 - done, window - offset)
                    pieces.append((doc, start, take, zlib.crc32(tail[done * 4 : (done + take) * 4]), n, places.stream + sequence, offset))
                    done, start = done + take, start + take
            yield _batch(pieces, PIECE_TYPES)

    return rows.mapInArrow(place, PIECE_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
