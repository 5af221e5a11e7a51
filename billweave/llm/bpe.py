"""Byte-level BPE encoding and decoding with a given vocabulary.

Method: pair occurrence index. The distinct words of a batch stand in one row of symbols; an index
maps each adjacent pair that has a rank to all its positions, and a heap holds the ranks that occur.
The lowest rank is applied to all its positions at once; each merge puts the two pairs that it makes
into their lists. Positions that an earlier merge has used up are skipped when their turn comes. A
worker keeps the words it has encoded, up to `WORDS_KEPT`, which changes nothing but the time.

Texts stay whole. The vocabulary goes to the tasks as a broadcast of at most `MAX_VOCABULARY_BYTES`;
one that is larger is an error, as vocabularies do not grow with the data.

Null text is encoded as empty text: no ids. Empty text gives no ids. Repeated rows and ties give
equal results, all columns stay, and a column called like the new one is replaced.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from billweave.llm.rows import with_arrow

WORDS_KEPT = 100_000
#: Bytes of text whose words are indexed together.
PARTITION_BYTES = 1_500_000
MAX_VOCABULARY_BYTES = 64_000_000
#: How byte-level BPE cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    hidden = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + n): b for n, b in enumerate(list(hidden))}


class Tokenizer:
    """Vocabulary, merges and added tokens of a tokenizer file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, words = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or words["type"] != "ByteLevel" or words["add_prefix_space"]
                or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout")):
            raise ValueError(f"{path} is not plain byte-level BPE")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()
                      if t not in self.added}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        ids = {b: i for i, b in self.bytes.items() if i not in self.added.values()}
        self.single = np.array([ids[bytes([b])] for b in range(256)])
        made: dict[int, int] = {}
        parts = []
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ")
                                      for x in model["merges"]):
            left, right, both = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if made.get(left, -1) >= rank or made.get(right, -1) >= rank:
                raise ValueError(f"merge {rank} of {path} uses a token made by a later one")
            parts.append((left, right, both))
            made[both] = rank
        #: by rank: left id, right id, id of both together
        self.parts = np.array(parts, np.int64).reshape(-1, 3)
        keys = (self.parts[:, 0] << 32) + self.parts[:, 1]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.pattern = WORD_PATTERN
        self.cut = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for those without one."""
        wanted = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


class PairIndex:
    """Symbols of many words in one row, and where each pair that has a rank stands."""

    def __init__(self, words: list[bytes], tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(sizes + 1)
        self.symbols = np.full(int(self.ends[-1]), -1, np.int64)  # no pair goes over a word's end
        inside = np.ones(len(self.symbols), bool)
        inside[self.ends - 1] = False
        self.symbols[inside] = tokenizer.single[np.frombuffer(b"".join(words), np.uint8)]
        self.after = np.arange(1, len(self.symbols) + 1)
        self.before = np.arange(-1, len(self.symbols) - 1)
        #: rank -> positions of its pair, as a list of arrays
        self.places: dict[int, list[np.ndarray]] = {}
        #: the ranks that occur
        self.active: list[int] = []
        self.add(np.arange(len(self.symbols) - 1))

    def add(self, at: np.ndarray) -> None:
        """Puts the pairs that start at these positions into the index."""
        left, right = self.symbols[at], self.symbols[self.after[at]]
        ranks = self.tokenizer.ranks_of(left, right)
        ranks[(left < 0) | (right < 0)] = -1
        found = np.flatnonzero(ranks >= 0)
        if not len(found):
            return
        found = found[np.argsort(ranks[found], kind="stable")]
        at, ranks = at[found], ranks[found]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, start, end in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(at[start:end])

    def apply(self) -> None:
        """Merges the lowest rank wherever it still stands; indexes the pairs that this makes."""
        rank = heapq.heappop(self.active)
        left, right, both = self.tokenizer.parts[rank].tolist()
        lists = self.places.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        then = self.after[at]
        whole = (self.symbols[at] == left) & (self.symbols[then] == right)
        if not whole.all():
            at, then = at[whole], then[whole]
        if left == right:  # of overlapping places the first counts
            at = np.array(first_of_runs(np.sort(at).tolist(), self.after), np.int64)
            then = self.after[at]
        if not len(at):
            return
        last = self.after[then]
        self.symbols[at], self.symbols[then] = both, -2
        self.after[at], self.before[last] = last, at
        first = self.before[at]
        self.add(np.concatenate([first[first >= 0], at]))


def first_of_runs(at: list[int], after: np.ndarray) -> list[int]:
    taken, used = [], -1
    for place in at:
        if place != used:
            taken.append(place)
            used = int(after[place])
    return taken


def merge_words(words: list[bytes], tokenizer: Tokenizer) -> list[bytes]:
    """Token ids of each word (little-endian), by a pair occurrence index over all of them."""
    if not words:
        return []
    index = PairIndex(words, tokenizer)
    while index.active:
        index.apply()
    left = index.symbols >= 0
    ends = 4 * np.cumsum(left)[index.ends - 1]
    ids = index.symbols[left].astype("<u4").tobytes()
    return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class Encoder:
    """Encodes batches of texts; keeps words it has seen."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.words = regex.compile(tokenizer.pattern).findall
        self.cut = regex.compile(f"({tokenizer.cut})") if tokenizer.cut else None
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, one after the other."""
        parts: list[list[str]] = []
        added = self.tokenizer.added
        for text in texts:
            if self.cut and any(t in (text or "") for t in added):
                pieces = self.cut.split(text)
                parts.append([w for k, x in enumerate(pieces)
                              for w in ([x] if k % 2 else self.words(x))])
            else:
                parts.append(self.words(text or ""))
        known = self.known
        new = {w for words in parts for w in words if w not in known}
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = {w for words in parts for w in words}
        plain = [w for w in new if w not in added]
        for word, ids in zip(plain, merge_words([w.encode() for w in plain], self.tokenizer),
                             strict=True):
            known[word] = ids
        known |= {w: added[w].to_bytes(4, "little") for w in new if w in added}
        return [b"".join(map(known.__getitem__, words)) for words in parts]


_ENCODERS: dict[int, Encoder] = {}


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with a binary column of token ids (little-endian unsigned 32-bit integers)."""
    shared = SparkSession.active().sparkContext.broadcast(tokenizer)

    def start():
        if id(shared.value) not in _ENCODERS:  # a worker that runs several tasks keeps its words
            _ENCODERS.clear()
            _ENCODERS[id(shared.value)] = Encoder(shared.value)
        encoder = _ENCODERS[id(shared.value)]
        return lambda texts: [encoder.encode(texts)]

    return with_arrow(df, [text], [T.StructField(ids, T.BinaryType())], start, PARTITION_BYTES)


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the text of its ids; special tokens are kept. Null ids give empty text."""
    shared = SparkSession.active().sparkContext.broadcast(tokenizer.bytes)

    def start():
        pieces = shared.value.__getitem__

        def work(cells):
            return [[b"".join(map(pieces, np.frombuffer(x or b"", "<u4").tolist())).decode(errors="replace")
                     for x in cells]]
        return work

    return with_arrow(df, [ids], [T.StructField(text, T.StringType())], start, PARTITION_BYTES)
