"""Passages of benchmark items in documents.

Method: Wu-Manber multi-pattern search over words. Patterns are the windows of `window` consecutive
words of the items; an item of fewer words is one pattern. For each pattern length, a shift table
under the hash of a block of two words tells how far the search may jump (the whole pattern where
the block stands in no pattern). Where it may not jump, the hash of all words of the place is looked
up, and places that pass meet the patterns of equal words in a join: the direct comparison.

Words: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters. Null has none,
and so has empty text; such items are no pattern. Items without an id mark words as hit, but are
not listed. Rows with equal texts get equal results, all columns stay, and columns called like the
new ones are replaced. A very long text is searched by one task, which holds its words and no more
than its places that pass.

Spread: the items stay a table. What goes to the driver and to all tasks are the tables of hashes,
at most `window` x SLOTS + PLACES bytes whatever the benchmark's size (blocks of equal hash share
the smallest shift, so a full table costs time and no result). Places that pass are rows, one for
each different window of a text, equal texts combined before the shuffle. Documents meet their hits
under the hash of their text; they are not shuffled where the hits are few enough for Spark to
broadcast them. `find_passages` runs the search and writes the hits to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.llm.rows import LOWER, UPPER, fresh, saved, slices, with_arrow

WINDOW = 13
#: Bytes of text whose words are held at once; a longer text comes alone.
BLOCK_BYTES = 1_000_000
#: Slots of a length's shift table, and of the table of whole windows; powers of two.
SLOTS, PLACES = 1 << 20, 1 << 23
#: Slots that come to the driver as one row.
SEGMENT = 1 << 16
#: Rows that Python passes on at once.
ROWS = 10_000
#: Of contamination: hit words and the share of all words, 1 / SHARE.
SHARE = 20

_TABLE = bytearray(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
for _upper, _lower in zip(UPPER, LOWER, strict=True):
    _TABLE[ord(_upper)] = ord(_lower)
_TABLE = bytes(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> Iterator[bytes]:
    size = min(window, len(words))
    for at in range(len(words) - size + 1 if size else 0):
        yield b" ".join(words[at:at + size])


def block_hash(words: list[bytes], last: int, size: int) -> int:
    """Of the two words before `last`, or of the one that a pattern of one word has."""
    return crc32(words[last - 1], crc32(words[last - 2])) if size > 1 else crc32(words[last - 1])


def longest_shift(size: int) -> int:
    """Where a block stands in no pattern of this length."""
    return min(255, size - min(2, size) + 1)


def slots_of(words: list[bytes], window: int, slots: int, places: int) -> Iterator[tuple[int, int, int]]:
    """(length, slot, shift) for each block of an item, (0, slot, 1) for each window."""
    size = min(window, len(words))
    for last in range(min(2, size), len(words) + 1 if size else 0):
        yield size, block_hash(words, last, size) % slots, min(255, max(0, size - last))
    for held in windows_of(words, window):
        yield 0, crc32(held) % places, 1


def from_items(items: DataFrame, make: Callable[[list[bytes]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """A row of `schema` for each tuple that `make` gives from an item's words, after the item itself."""
    block = BLOCK_BYTES
    schema = T.StructType([items.schema["item"], *schema])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, block):
                texts = part.column("text").to_pylist()
                rows = ((n, *row) for n, text in enumerate(texts) for row in make(words_of(text)))
                for some in batched(rows, ROWS):
                    at, *cells = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("item").take(pa.array(at)), *map(pa.array, cells)], names)

    return items.mapInArrow(run, schema)


def hash_tables(items: DataFrame, window: int) -> dict[int, bytes]:
    """Shift tables by length of pattern, and under 0 which hashes whole windows have."""
    slots, places = SLOTS, PLACES
    sizes = {0: places}
    rows = from_items(items, lambda words: slots_of(words, window, slots, places), T.StructType(
        [T.StructField(c, T.LongType()) for c in ("kind", "slot", "value")]))
    rows = rows.groupBy("kind", "slot").agg(F.min("value").alias("value"))

    def packed(group: pa.Table) -> pa.Table:
        kind, slot = group["kind"][0].as_py(), group["slot"].to_numpy()
        values = np.full(SEGMENT, longest_shift(kind) if kind else 0, np.uint8)
        values[slot % SEGMENT] = group["value"].to_numpy()
        return pa.table({"kind": [kind], "segment": [int(slot[0]) // SEGMENT], "cells": [values.tobytes()]})

    tables = {}
    for row in rows.groupBy("kind", F.floor(F.col("slot") / SEGMENT)).applyInArrow(
            packed, "kind long, segment long, cells binary").collect():
        kind, size = row["kind"], sizes.get(row["kind"], slots)
        whole = tables.setdefault(kind, bytearray([longest_shift(kind) if kind else 0]) * size)
        at = row["segment"] * SEGMENT
        whole[at:at + SEGMENT] = row["cells"][:size - at]
    return {kind: bytes(whole) for kind, whole in tables.items()}


def places_of(words: list[bytes], tables: dict[int, bytes]) -> dict[bytes, list[list[int]]]:
    """Window -> [start, end] of where it may be a pattern; touching places are one."""
    found: dict[bytes, list[list[int]]] = {}
    if not tables:
        return found
    known, end = tables[0], len(words)
    places = len(known)
    for size, shifts in tables.items():
        last, slots = size or end + 1, len(shifts)
        while last <= end:
            if go := shifts[block_hash(words, last, size) % slots]:
                last += go
                continue
            held = b" ".join(words[last - size:last])
            if known[crc32(held) % places]:
                runs = found.setdefault(held, [])
                if runs and runs[-1][1] == last - 1:
                    runs[-1][1] = last
                else:
                    runs.append([last - size, last])
            last += 1
    return found


def candidates(texts: DataFrame, tables: dict[int, bytes]) -> DataFrame:
    """(key, words, runs) from (key, text): a row for each text and window that may be a pattern."""
    shared, block = texts.sparkSession.sparkContext.broadcast(tables), BLOCK_BYTES
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, block):
                found = ((n, held, [{"start": a, "end": b} for a, b in at])
                         for n, text in enumerate(part.column("text").to_pylist())
                         for held, at in places_of(words_of(text), shared.value).items())
                for some in batched(found, ROWS):
                    row, held, at = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(row)), pa.array(held, pa.binary()), pa.array(at, runs)],
                        ["key", "words", "runs"])

    return texts.mapInArrow(run, "key binary, words binary, runs array<struct<start: int, end: int>>")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def counter():
    return lambda texts: [[len(words_of(text)) for text in texts]]


def hits_by_text(texts: Column, df: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, hits) of the texts that hold a pattern."""
    patterns = from_items(items, lambda words: ((w,) for w in windows_of(words, window)),
                          T.StructType([T.StructField("words", T.BinaryType())])).distinct()
    keyed = df.select(text_key(texts).alias("key"), texts.alias("text")).where(F.length("text") > 0)
    places = candidates(keyed, hash_tables(items, window)).distinct().join(patterns, "words")
    runs = places.select("key", "item", F.inline("runs"))
    # windows of one item that touch are one hit
    order = Window.partitionBy("key", "item").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(order))
    merged = runs.groupBy("key", "item", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", F.col("item").cast("string").alias("name"), "item")))
    return merged.groupBy("key").agg(F.transform(ordered, lambda h: F.struct(
        h.item.alias("item"), h.start.alias("start"), h.end.alias("end"))).alias("hits"))


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`df` with n_words and hits: an array of (item, start, end), counted in words of the text."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    items = items.where(F.length("text") > 0).distinct()
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_words", "hits")]
    key, found = fresh(df, "text_key"), fresh(df, "found_hits")
    hits = saved(hits_by_text(F.col(f"`{text}`"), df, items, window))
    hits = hits.select(F.col("key").alias(key), F.col("hits").alias(found))
    named = with_arrow(df.withColumn(key, text_key(F.col(f"`{text}`"))), [text],
                       [T.StructField("n_words", T.LongType())], counter, BLOCK_BYTES).join(hits, key, "left")
    none = F.array().cast(hits.schema[found].dataType)
    return named.select(*kept, "n_words", F.coalesce(found, none).alias("hits"))


def hit_words(hits: Column) -> Column:
    """How many words stand in any of the hits."""
    return F.size(F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h.start, h.end - 1))))).cast("long")


def hit_items(hits: Column) -> Column:
    """The ids of the items hit, as text, sorted."""
    ids = F.transform(hits, lambda h: h.item.cast("string"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def without_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` that are not contaminated."""
    hits, words = F.col("hits"), F.col("n_words")
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                      F.col(f"`{text}`").alias("text"))
    found = find_passages(named, benchmark)
    return found.where(~is_contaminated(hit_words(hits), words)).select("row.*")
