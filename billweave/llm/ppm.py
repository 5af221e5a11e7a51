"""Probability of texts by prediction by partial matching.

Method: a trie of byte contexts, up to `order` bytes long, holds how often each byte followed. The
code length of a byte is taken at its longest context that training has seen. There each symbol gives
up `DISCOUNT` of its count to the escape; a byte that never followed there costs the escape and is
looked up in the next shorter context, where the symbols of the longer one are excluded. Shorter
contexts count a symbol once for each longer context that it followed in (update exclusion). Below
contexts of one byte, what is left of the alphabet is equally likely. Probabilities add up to one. A
text is scored as its tokens, A-Z lower-cased, each followed by a blank, the last by an end.

How it is spread: texts are dealt by hash into blocks of about `BLOCK_BYTES`. Each block lists its
distinct tokens (by a 64-bit hash) and byte strings of order + 1 once, with their counts in training
texts. Those lists, not the texts, are summed and joined over the whole corpus, so what is gathered
grows with the input and nothing is cut off or capped. The trie is evaluated in parts by the last two
bytes of the context; only the counts of byte pairs, 65,536 at most, go to all of them. The results
return to the blocks that asked for them and meet the texts there.

Null text counts as empty; empty text is one end. Without training rows all counts are zero. Equal
rows get equal scores. Extra columns do not matter, as only those asked for are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from billweave.llm.rows import saved, slices

ORDER = 5
#: What each symbol of a context gives up to the escape.
DISCOUNT = 0.3
BLOCK_BYTES = 32_000_000
#: Bytes of text that a task holds as tokens.
HELD_BYTES = 1_000_000
#: Integers that a task gathers before it sums their counts.
SUMS_HELD = 1_000_000
#: Bytes that UTF-8 never holds.
START, END = 0xFE, 0xFF
#: Symbols that can follow: all bytes but START.
ALPHABET = 255
WORDS, GRAMS = 0, 1
FEATURES = "block long, kind byte, feature long, n long"
VALUES = "kind byte, feature long, value double"
#: Strings of the trie that are evaluated at once, about.
TRIE_PART = 200_000
END_TOKEN = bytes([END])


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="surrogatepass").lower().split()


def byte_strings(texts: list[list[bytes]], order: int) -> np.ndarray:
    """The strings of `order` bytes and the next one of each text, as integers."""
    start, end = bytes([START]) * order, bytes([END])
    raw = np.frombuffer(b"".join(start + b" ".join(t) + end for t in texts), np.uint8)
    grams = raw[order:].astype(np.int64)
    for back in range(1, order + 1):
        grams |= raw[order - back:len(raw) - back].astype(np.int64) << (8 * back)
    return grams[(raw != START)[order:]]


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int,
                      pairs: np.ndarray) -> np.ndarray:
    """log10 of each string's last byte after the others.

    `grams` are distinct and hold every string seen in training that has the same two bytes before
    its last as one of them, with its count; others have 0. `pairs`: after how many different bytes
    each byte pair was seen, over the whole corpus.
    """
    result, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    kept, kept_counts = grams[counts > 0], counts[counts > 0]
    longer = None  # of the level above: contexts, strings, whose string it is, symbols
    for level in range(order, 0, -1):
        mask = (1 << (8 * (level + 1))) - 1
        if level > 1:
            strings, where = np.unique(kept & mask, return_inverse=True)
            times = np.bincount(where, kept_counts, len(strings))
            kept, kept_counts = strings, np.ones(len(strings))
        else:
            strings = np.flatnonzero(pairs)
            times = pairs[strings].astype(float)
        contexts, owner = np.unique(strings >> 8, return_inverse=True)
        total = np.bincount(owner, times, len(contexts))
        symbols = np.bincount(owner, minlength=len(contexts)).astype(float)
        at, known = place(contexts, (grams & mask) >> 8)
        string_at, seen = place(strings, grams & mask)
        n, q = np.zeros(len(grams)), np.zeros(len(grams))
        n[known], q[known] = total[at[known]], symbols[at[known]]
        if longer and len(longer[0]):
            # the symbols of a longer context, if training has seen it, are excluded here
            shared = times[place(strings, longer[1] & mask)[0]]
            taken = np.bincount(longer[2], shared, len(longer[0]))
            long_at, was = place(longer[0], (grams >> 8) & mask)
            n[was] -= taken[long_at[was]]
            q[was] -= longer[3][long_at[was]]
        here = known & ~done & (n > 0)
        hit, miss = here & seen, here & ~seen
        result[hit] += np.log10((times[string_at[hit]] - DISCOUNT) / n[hit])
        result[miss] += np.log10(DISCOUNT * q[miss] / n[miss])
        done |= hit
        longer = contexts, strings, owner, symbols
    at, known = place(longer[0], (grams >> 8) & 0xFF)
    left = np.full(len(grams), float(ALPHABET))
    left[known] -= longer[3][at[known]]
    result[~done] -= np.log10(left[~done])
    return result


def place(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in the ordered ones, and whether it does."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def table_slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        yield from slices(batch, HELD_BYTES)


class Sums:
    """Counts of integers, summed whenever many have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((values, counts))
        self.size += len(values)
        if self.size > SUMS_HELD and len(self.parts) > 1:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            values, counts = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(values)
            values, counts = values[order], counts[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            self.parts = [(values[first], np.add.reduceat(counts, first))]
            self.size = len(first)
        return self.parts[0]


def list_features(order: int):
    """Of a block: its distinct tokens and byte strings with their counts in training texts."""

    def run(table: pa.Table) -> pa.Table:
        words, grams = Sums(), Sums()
        for part in table_slices(table):
            cells = zip(part.column("text").to_pylist(), part.column("out").to_pylist())
            texts: tuple[list, list] = [], []
            for text, out in cells:
                texts[out].append(tokens(text))
            for out, held in enumerate(texts):
                if held:
                    found = Counter(w for t in held for w in t)
                    found[END_TOKEN] = len(held)
                    words.add(np.fromiter(map(word_hash, found), np.int64, len(found)),
                              np.fromiter(found.values(), np.int64, len(found)) * (1 - out))
                    strings, n = np.unique(byte_strings(held, order), return_counts=True)
                    grams.add(strings, n * (1 - out))
        (word, n), (gram, m) = words.total(), grams.total()
        kind = np.full(len(word) + len(gram), GRAMS, np.int8)
        kind[:len(word)] = WORDS
        block = np.full(len(kind), table.column("block")[0].as_py(), np.int64)
        return pa.table([block, kind, np.concatenate([word, gram]), np.concatenate([n, m])],
                        ["block", "kind", "feature", "n"])

    return run


def evaluate(order: int, pairs: np.ndarray):
    """Of a part of the trie: the log10 probability of each string's last byte."""

    def run(table: pa.Table) -> pa.Table:
        grams, counts = (table.column(c).to_numpy() for c in ("feature", "n"))
        value = log_probabilities(grams, counts, order, pairs)
        return pa.table([np.full(len(grams), GRAMS, np.int8), grams, value],
                        ["kind", "feature", "value"])

    return run


def add_up(order: int, norm: float, id_type: pa.DataType):
    """Of a block: the scores of its texts, from the values of their tokens and byte strings."""

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, feature, value = (values.column(c).to_numpy() for c in ("kind", "feature", "value"))
        sides = []
        for k in (WORDS, GRAMS):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(feature[mine])]
            sides.append((feature[mine], value[mine]))
        (hashes, times), (grams, logs) = sides
        rows: list[tuple] = []
        for part in table_slices(texts):
            cells = [tokens(t) for t in part.column("text").to_pylist()]
            new = list({END_TOKEN}.union(*cells))
            at = find(hashes, np.fromiter(map(word_hash, new), np.int64, len(new)))
            known = dict(zip(new, times[at].tolist()))
            for words in cells:
                seen = np.fromiter(map(known.__getitem__, [*words, END_TOKEN]), float, len(words) + 1)
                strings, n = np.unique(byte_strings([words], order), return_counts=True)
                rows.append((len(seen), int((seen > 0).sum()),
                             float(np.log10(seen + 0.5).sum()) - len(seen) * norm,
                             float(n @ logs[find(grams, strings)])))
        out = list(zip(*rows))
        return pa.table([texts.column("id").cast(id_type), texts.column("out"),
                         pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(out[2]), pa.array(out[3])],
                        ["id", "out", "n_tokens", "n_known", "base_score", "score"])

    return run


def find(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at, there = place(ordered, wanted)
    if not there.all():
        raise RuntimeError("a block's texts differ from those that its list was made of")
    return at


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows for which `held_out` is false or null are the training rows. base_score is the log10
    probability under token counts to which a half is added.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("out"))
    size = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"),
                                            F.lit(1 + size // block_bytes)))
    features = saved(dealt.select("block", "text", "out").groupBy("block")
                     .applyInArrow(list_features(order), FEATURES))
    sums = saved(features.groupBy("kind", "feature").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("kind").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v"),
                                      F.count("*").alias("rows")).collect()
    by_kind = {r["kind"]: r for r in totals}
    train_tokens, distinct = (by_kind[WORDS][c] if by_kind else 0 for c in ("n", "v"))
    norm = math.log10(train_tokens + 0.5 * (distinct + 1))
    pairs = np.zeros(1 << 16, np.int64)
    grams = sums.where(F.col("kind") == GRAMS)
    triples = grams.where("n > 0").select(F.col("feature").bitwiseAND(0xFFFFFF).alias("triple")).distinct()
    for row in (triples.groupBy(F.col("triple").bitwiseAND(0xFFFF).alias("pair"))
                .agg(F.count("*").alias("n")).collect()):
        pairs[row["pair"]] = row["n"]
    parts = 1 + (by_kind[GRAMS]["rows"] if by_kind else 0) // TRIE_PART
    root = F.shiftright("feature", 8).bitwiseAND(0xFFFF)
    logs = (grams.withColumn("part", F.pmod(F.xxhash64(root), F.lit(parts))).groupBy("part")
            .applyInArrow(evaluate(order, pairs), VALUES))
    words = sums.where(F.col("kind") == WORDS).select("kind", "feature", F.col("n").cast("double").alias("value"))
    asked = features.select("block", "kind", "feature").join(words.unionByName(logs), ["kind", "feature"])
    id_field = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_field), T.StructField("out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = (dealt.groupBy("block").cogroup(asked.groupBy("block"))
              .applyInArrow(add_up(order, norm, to_arrow_type(id_field)), schema))
    return scored.select(F.col("id").alias(doc_id), F.col("out").alias("held_out"), "n_tokens", "n_known",
                         F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
