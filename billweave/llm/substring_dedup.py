"""Passages that an earlier document holds too, cut out.

Method: Rabin-Karp. Every window of `window` consecutive words of one document gets a rolling hash
(a polynomial in the words' 64-bit hashes, modulo 2 ** 64). Spark deals the hashes of all windows into
buckets by a second polynomial; a bucket finds the smallest id of each hash. A window is repeated if
a document with a smaller id holds it. The words of repeated windows go; touching and overlapping
windows are one removal interval, the longest possible.

Windows are told apart by 64 bits and the number of their bucket, some million windows to each: the
chance that any two different windows of a corpus of 1e13 are taken for one is below a half.

How it is spread: texts are dealt into blocks of about `BLOCK_BYTES`. A block sends each bucket one
sorted list of its different hashes with the smallest id of each, so a passage that a third of all
documents share comes once for each block. The bucket answers with one bit for each entry (whether a
smaller id holds it elsewhere); the block meets the answers and cuts its texts. Texts are shuffled
once; both steps read the same shuffle.

Words are runs without blanks (space and \\t to \\r), unchanged. Null and empty texts have none, and texts
of fewer words than a window lose nothing. A row whose id is null neither loses words nor makes others
lose any. Rows with equal ids don't count against each other; rows with equal id and text travel as
one and come out as often as they came in. Other columns are not read, so their names can't clash.
An empty table gives an empty table. A text is held whole by the task that cuts it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 13
#: Bytes of text of a block; windows of a bucket, at four bytes of text for each.
BLOCK_BYTES, BUCKET = 8_000_000, 2_000_000
#: Odd bases of the two polynomials: the fractions of the golden ratio and of the root of 3.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B
INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                      T.StructField("end", T.IntegerType())]))


class WordHashes(dict):
    """64-bit hashes of words; those of short words are kept for a while."""

    KEPT, LONGEST = 300_000, 48

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = value
        return value


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    steps = np.full(count, base % 2**64, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def rolling(codes: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of the `size` codes from each place on: the sum of codes[i + j] * base ** (size - 1 - j).

    All are differences of one running sum, in which the place's power of the base is divided out.
    """
    count = len(codes)
    if count < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(codes * powers(pow(base, -1, 2**64), count), out=sums[1:])
    return (sums[size:] - sums[:-size]) * powers(base, count)[size - 1:]


def planes(values: np.ndarray) -> bytes:
    """Eight-byte numbers with all their first bytes first: what is alike in them compresses well."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(cells: Iterable[bytes]) -> np.ndarray:
    """The numbers of several cells of `planes`, one after the other."""
    parts = [np.frombuffer(c, np.uint8).reshape(8, -1).T for c in cells]
    whole = np.ascontiguousarray(np.concatenate(parts)) if parts else np.zeros((0, 8), np.uint8)
    return whole.view(">u8").ravel().astype(np.uint64)


class Block:
    """The windows of some texts, sorted by bucket and hash."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes | None], size: int,
                 buckets: int) -> None:
        """`ids` ascend; rows that are not `known` have no id and no windows to compare."""
        hashes = WordHashes()
        codes, counts = [], []
        for text in texts:
            words = (text or b"").split()
            counts.append(len(words))
            codes.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        #: words of each text, and where each text's words begin among all
        self.counts = np.array(counts, np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        row = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)
        last = max(len(codes) - size + 1, 0)
        starts = np.flatnonzero((row[:last] == row[size - 1:]) & known[row[:last]])
        value = rolling(codes, size, BASE)[starts]
        bucket = (rolling(codes, size, OTHER_BASE)[starts] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        bucket = bucket.astype(np.uint16 if buckets <= 2**16 else np.int64)
        # stable, so that equal windows stay in the order of their ids
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        self.starts, value, bucket = starts[order], value[order], bucket[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
        #: of each window: its document's id, and its entry among the different ones
        self.ids = ids[row[self.starts]]
        self.entry = np.cumsum(first) - 1
        #: of each entry: hash, smallest id, bucket
        self.values, self.firsts, self.buckets = value[first], self.ids[first], bucket[first]

    def lists(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, hashes, smallest ids) of every bucket that has entries."""
        cuts = np.flatnonzero(np.diff(self.buckets)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(self.buckets)]):
            if end > begin:
                yield int(self.buckets[begin]), self.values[begin:end], self.firsts[begin:end]

    def removed(self, smaller: dict[int, bytes], size: int) -> np.ndarray:
        """Which words go; `smaller` has for each bucket a bit for each of its entries."""
        gone = np.zeros(len(self.values), bool)
        for bucket, bits in smaller.items():
            begin, end = np.searchsorted(self.buckets, [bucket, bucket + 1])
            gone[begin:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - begin)
        repeated = self.starts[gone[self.entry] | (self.firsts[self.entry] < self.ids)]
        step = np.zeros(int(self.counts.sum()) + 1, np.int32)
        np.add.at(step, repeated, 1)
        np.subtract.at(step, repeated + size, 1)
        return np.cumsum(step[:-1]) > 0


def block_of(rows: pa.Table, size: int, buckets: int) -> tuple[pa.Table, Block]:
    """The rows by id, and their windows."""
    rows = rows.sort_by("id")
    ids = rows.column("id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return rows, Block(ids.fill_null(0).to_numpy(zero_copy_only=False), known, rows.column("text").to_pylist(), size,
                       buckets)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with equal id and text as one, within a batch."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["id", "text"]).aggregate([([], "count_all")])
        yield from rows.rename_columns(["id", "text", "copies"]).to_batches()


def _sender(size: int, buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        _, windows = block_of(rows, size, buckets)
        lists = list(windows.lists())
        return pa.table({"bucket": pa.array([b for b, _, _ in lists], pa.int64()),
                         "block": pa.array([block] * len(lists), pa.int64()),
                         "hashes": pa.array([planes(h) for _, h, _ in lists], pa.binary()),
                         "firsts": pa.array([planes(f) for _, _, f in lists], pa.binary())})
    return send


def _answer(rows: pa.Table) -> pa.Table:
    """For each list of a bucket: which of its hashes other lists hold with a smaller id."""
    value = from_planes(rows.column("hashes").to_pylist())
    ident = from_planes(rows.column("firsts").to_pylist()).view(np.int64)
    order = np.lexsort((ident, value))
    ordered = value[order]
    first = np.ones(len(value), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    least = ident[order][first][np.cumsum(first) - 1]
    smaller = np.zeros(len(value), bool)
    smaller[order] = ident[order] > least
    blocks, bits, at = [], [], 0
    for block, cell in zip(rows.column("block").to_pylist(), rows.column("hashes")):
        end = at + len(cell.as_buffer()) // 8
        if smaller[at:end].any():
            blocks.append(block)
            bits.append(np.packbits(smaller[at:end]).tobytes())
        at = end
    bucket = rows.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int64()),
                     "smaller": pa.array(bits, pa.binary())})


def _cutter(size: int, buckets: int, schema: pa.Schema):
    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, windows = block_of(rows, size, buckets)
        gone = windows.removed(dict(zip(answers.column("bucket").to_pylist(), answers.column("smaller").to_pylist())),
                               size)
        intervals, kept = [], []
        for text, begin, count in zip(rows.column("text").to_pylist(), windows.begins.tolist(),
                                      windows.counts.tolist()):
            words, mine = (text or b"").split(), gone[begin:begin + count]
            if mine.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                intervals.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                words = [words[n] for n in np.flatnonzero(~mine).tolist()]
            else:
                intervals.append([])
            kept.append(b" ".join(words))
        return pa.table([rows.column("id"), rows.column("copies"), pa.array(windows.counts),
                         pa.array(intervals, schema.field("removed").type), pa.array(kept, pa.binary())],
                        names=schema.names)
    return cut


def cut_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """The id, n_words, removed (array of (start, end), counted in words) and kept (text) of every row.

    `kept` holds the words that stay, with one space between them. Ids are whole numbers.
    """
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is not a column of whole numbers")
    texts = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = size // block_bytes + 1, size // (4 * bucket) + 1
    dealt = (texts.mapInArrow(_merged, "id long, text binary, copies long")
             .withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))))
    lists = dealt.groupBy("block").applyInArrow(_sender(window, buckets),
                                                "bucket long, block long, hashes binary, firsts binary")
    answers = lists.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, smaller binary")
    names = T.StructType([T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()),
                          T.StructField("n_words", T.LongType()), T.StructField("removed", INTERVALS),
                          T.StructField("kept", T.BinaryType())])
    arrow = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("n_words", pa.int64()),
                       ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                       ("kept", pa.binary())])
    cut = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cutter(window, buckets, arrow), names)
    return (cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").cast(df.schema[doc_id].dataType).alias(doc_id), "n_words", "removed",
                    F.col("kept").cast("string").alias("kept")))


def removed_words(removed) -> F.Column:
    """How many words the intervals hold."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, r: n + (r.end - r.start))
