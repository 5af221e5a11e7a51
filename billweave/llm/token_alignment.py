"""Tokens of two tokenizers over the same texts, linked where they cover the same bytes.

Method: sparse matrices in compressed rows (indptr, indices, data), built by hand. Each tokenizer's tokens are
the rows of a token-byte incidence matrix; Gustavson's product A * B^T, which for every entry of a row of A
adds up the row of B^T that it names, has an entry for every pair of tokens that overlap, and its value is
the number of bytes they share. Byte offsets at which tokens of both end cut the text into groups; of the
product of the token-group incidence matrices, whose entries are the pairs that share a group, only the row
sizes are worked out, since a group of m and n tokens has m * n of them. `counts` sums over the corpus
how many links each pair of ids has.

A: a byte-level BPE (a file of ranks for tiktoken) over a space and the text. B: a sentencepiece BPE with byte
fallback over the text, before which it puts a space itself. Strings of special tokens are plain text. A
null or empty text has no tokens, and neither has one whose bytes either tokenizer does not give back as
a space and the text. Equal rows count as often as they occur; ids may be null or repeated; columns
besides id and text are not read; an empty table gives an empty table. A long text is tokenised
whole, and its product is worked out some rows at a time.

How it is spread: tasks align texts in blocks of about `BLOCK_BYTES`. A block keeps, for each text, its links as
numbers into the block's list of different pairs, and for each pair how many links it has. Only those
lists are summed in Spark; a block gets back the values of its own pairs and meets its texts with
them. What is shuffled for a frequent pair is one row for each block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.llm.rows import saved, slices

#: Bytes of text of a block, and of texts that are aligned at once.
BLOCK_BYTES, SLICE_BYTES = 16_000_000, 1_000_000
#: Entries of a product that are worked out at once.
ENTRIES = 2_000_000
#: Fixed value: how sentencepiece writes a space.
SPACE = "▁"


class Csr(NamedTuple):
    """A sparse matrix: row i has the columns indices[indptr[i]:indptr[i + 1]] with these data."""
    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray


def incidence(lengths: np.ndarray) -> Csr:
    """Rows that cover the columns from left to right, so many each."""
    indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Csr(indptr, np.arange(indptr[-1], dtype=np.int32), np.ones(indptr[-1], np.int32))


def transposed(m: Csr, columns: int) -> Csr:
    """The columns as rows."""
    rows = np.repeat(np.arange(len(m.indptr) - 1, dtype=np.int32), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=columns))])
    return Csr(indptr, rows[order], m.data[order])


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each entry of `a`, how many entries the row of `b` that it names has."""
    return np.diff(b.indptr)[a.indices]


def product(a: Csr, b: Csr, entries: int = ENTRIES) -> Csr:
    """The product by rows: each entry of a row of `a` adds the row of `b` that it names.

    Rows are taken as many at once as have about `entries` terms.
    """
    rows = len(a.indptr) - 1
    terms = np.concatenate([[0], np.cumsum(product_sizes(a, b), dtype=np.int64)])[a.indptr]
    counts, indices, data = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(terms, terms[at] + entries, side="right")) - 1)
        low, high = a.indptr[at], a.indptr[end]
        named = a.indices[low:high]
        sizes = np.diff(b.indptr)[named]
        places = spans(b.indptr[named], sizes)
        row = np.repeat(np.repeat(np.arange(end - at), np.diff(a.indptr[at:end + 1])), sizes)
        column, value = b.indices[places], np.repeat(a.data[low:high], sizes) * b.data[places]
        if len(row):
            key = row * (int(column.max()) + 1) + column
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, row, column, value = key[order], row[order], column[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            row, column, value = row[first], column[first], np.add.reduceat(value, first)
        counts.append(np.bincount(row, minlength=end - at))
        indices.append(column)
        data.append(value)
        at = end
    return Csr(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(indices),
               np.concatenate(data))


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_level: str, pattern: str, pieces: str) -> None:
        with open(byte_level, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [self.piece_bytes(n) for n in range(self.b.get_piece_size())]
        self.a_lengths = np.array([len(t) for t in self.a_bytes], np.int32)
        self.b_lengths = np.array([len(t) for t in self.b_bytes], np.int32)
        #: decimal numbers followed by nothing, a comma, a bar, a semicolon
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{n}{sign}" for sign in ("", ",", "|", ";") for n in range(most)]
        self.most = most

    def piece_bytes(self, n: int) -> bytes:
        piece = self.b.id_to_piece(n)
        if self.b.is_byte(n):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both of every text; none where the bytes differ."""
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.b.encode(texts, num_threads=1)
        for n, text in enumerate(texts):
            whole = b" " + text.encode(errors="surrogatepass")
            if not text or (self.a.decode_bytes(a[n]) != whole
                            or b"".join(map(self.b_bytes.__getitem__, b[n])) != whole):
                a[n], b[n] = [], []
        return a, b


@lru_cache(maxsize=2)
def tokenizers(byte_level: str, pattern: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pattern, pieces)


class Aligned(NamedTuple):
    """Texts that were aligned at once; links are sorted by text."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    n_group_links: np.ndarray
    groups: list[str]
    #: of each link: id of A * tokens of B + id of B
    links: np.ndarray
    shared: np.ndarray


def concatenated(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after the other, and how many each list has."""
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((n for x in lists for n in x), np.int64, int(counts.sum()))
    return flat, counts


def sums_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, so many in each."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def align_texts(texts: list[str | None], both: Tokenizers) -> Aligned:
    """All texts as one: the matrices are diagonal by blocks, as offsets go on from text to text."""
    a_lists, b_lists = both.encode([t or "" for t in texts])
    (a, n_a), (b, n_b) = concatenated(a_lists), concatenated(b_lists)
    a_rows, b_rows = incidence(both.a_lengths[a]), incidence(both.b_lengths[b])
    size = int(a_rows.indptr[-1])
    overlap = product(a_rows, transposed(b_rows, size))
    degrees = np.diff(overlap.indptr)
    links = np.repeat(a, degrees) * len(both.b_bytes) + b[overlap.indices]
    # groups end where tokens of both end; texts do
    ends = np.intersect1d(a_rows.indptr[1:], b_rows.indptr[1:], assume_unique=True)
    a_group, b_group = np.searchsorted(ends, a_rows.indptr[1:]), np.searchsorted(ends, b_rows.indptr[1:])
    group_a = Csr(np.arange(len(a) + 1), a_group, np.ones(len(a), np.int32))
    group_b = Csr(np.arange(len(b) + 1), b_group, np.ones(len(b), np.int32))
    in_group = product_sizes(group_a, transposed(group_b, len(ends)))
    last = np.concatenate([a_group[1:] != a_group[:-1], [True]]) if len(a) else np.zeros(0, bool)
    return Aligned(n_a, n_b, sums_by(n_a, last), sums_by(n_a, degrees), sums_by(n_a, in_group),
                   group_texts(a, a_group, n_a, b, b_group, n_b, both), links, overlap.data)


def group_texts(a: np.ndarray, a_group: np.ndarray, n_a: np.ndarray, b: np.ndarray, b_group: np.ndarray,
                n_b: np.ndarray, both: Tokenizers) -> list[str]:
    """`a1,a2|b1;a3|b2` of every text."""
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    ids = np.concatenate([a, b])[order]
    side = (np.arange(len(ids)) >= len(a)).astype(np.int8)[order]
    group = np.concatenate([a_group, b_group])[order]
    # 1: comma within a side, 2: bar after A, 3: semicolon after B
    sign = np.zeros(len(ids), np.int64)
    sign[:-1] = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
    ends = np.cumsum(n_a + n_b)
    sign[ends[(n_a + n_b) > 0] - 1] = 0
    names = list(map(both.names.__getitem__, (sign * both.most + ids).tolist()))
    return ["".join(names[end - count:end]) for end, count in zip(ends.tolist(), (n_a + n_b).tolist())]


class Files(NamedTuple):
    """Where the tokenizers are: ranks and split pattern of A, model of B."""
    byte_level: str
    pattern: str
    pieces: str


_ROWS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("id", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")],
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("links", T.BinaryType()), T.StructField("times", T.BinaryType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
_ARROW = pa.schema([*[(c, pa.int64()) for c in ("block", "id", "n_a", "n_b", "n_groups", "n_links", "n_group_links")],
                    ("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary()),
                    ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


class _Gatherer:
    """The rows of one block: one for each text, and one with the block's pairs."""

    def __init__(self, block: int) -> None:
        self.block, self.size = block, 0
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list, found: Aligned) -> None:
        ends = np.cumsum(found.n_links)
        for n, ident in enumerate(ids):
            pairs, times = np.unique(found.links[ends[n] - found.n_links[n]:ends[n]], return_counts=True)
            self.pairs.append(pairs)
            self.times.append(times)
            text = found.groups[n]
            self.rows.append((ident, int(found.n_a[n]), int(found.n_b[n]), int(found.n_groups[n]),
                              int(found.n_links[n]), int(found.n_group_links[n]),
                              hashlib.sha256(text.encode()).hexdigest() if text else ""))

    def batches(self) -> Iterator[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([np.zeros(0), *self.times]), len(pairs)).astype(np.int64)
        ends = np.cumsum([len(p) for p in self.pairs])
        links = [place[end - len(p):end].astype("<u4").tobytes() for p, end in zip(self.pairs, ends.tolist())]
        times = [t.astype("<u4").tobytes() for t in self.times]
        for at in range(0, len(self.rows), 1_000):
            part = list(zip(*self.rows[at:at + 1_000]))
            n = len(part[0])
            yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, [
                [self.block] * n, *part, links[at:at + n], times[at:at + n], [None] * n, [None] * n])), _ARROW)
        empty = [None] * (len(_ARROW.names) - 3)
        yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, [[self.block], *[[x] for x in empty], [pairs],
                                                                 [counts]])), _ARROW)


def _aligner(files: Files, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        number = TaskContext.get().partitionId() << 32
        block = _Gatherer(number)
        for batch in batches:
            for part in slices(batch, min(SLICE_BYTES, block_bytes)):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                block.add(ids, align_texts(texts, both))
                block.size += part.nbytes
                if block.size >= block_bytes:
                    yield from block.batches()
                    number += 1
                    block = _Gatherer(number)
        if block.rows:
            yield from block.batches()
    return run


def _meet(texts: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over the links of each text of a block; `values` has a row for each of the block's pairs."""
    place = values.column("place").to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place] = values.column("total").to_numpy()
    best[place] = values.column("best").to_numpy()
    n_best, count_sum = [], []
    for links, times in zip(texts.column("links").to_pylist(), texts.column("times").to_pylist()):
        at, n = np.frombuffer(links, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int((best[at] * n).sum()))
        count_sum.append(int((total[at] * n).sum()))
    kept = texts.select(["id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256"])
    return (kept.append_column("n_best", pa.array(n_best, pa.int64()))
            .append_column("count_sum", pa.array(count_sum, pa.int64())))


def link_blocks(df: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A table of the aligned texts by block, and of each block's pairs, written to the shared folder."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return saved(rows.mapInArrow(_aligner(files, block_bytes), _ROWS))


def counts(blocks: DataFrame, files: Files) -> DataFrame:
    """pair, a_id, b_id, total (links of the corpus) and best: whether no other id of A has more with this B id."""
    size = len(tokenizers(*files).b_bytes)
    pairs = (blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
             .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")))
    # an id of B has at most as many pairs as A has ids
    rivals = Window.partitionBy("b_id")
    return (pairs.withColumn("a_id", F.floor(F.col("pair") / size)).withColumn("b_id", F.col("pair") % size)
            .withColumn("best", F.col("total") == F.max("total").over(rivals)))


def align(df: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256.

    n_best: links whose total is the highest of their B id's; count_sum: the totals of all its links.
    """
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is not a column of whole numbers")
    blocks = link_blocks(df, files, doc_id, text, block_bytes)
    wanted = (blocks.where("pairs IS NOT NULL")
              .select("block", F.posexplode("pairs").alias("place", "pair")))
    values = (wanted.join(counts(blocks, files).select("pair", "total", F.col("best").cast("int").alias("best")), "pair")
              .select("block", "place", "total", "best"))
    texts = blocks.where("pairs IS NULL").drop("pairs", "counts").withColumnRenamed("block", "of_block")
    out = T.StructType([*[f for f in _ROWS if f.name in ("id", "n_a", "n_b", "n_groups", "n_links", "n_group_links",
                                                         "groups_sha256")],
                        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    met = texts.groupBy("of_block").cogroup(values.groupBy("block")).applyInArrow(_meet, out)
    return met.select(F.col("id").cast(df.schema[doc_id].dataType).alias(doc_id), *out.names[1:])
