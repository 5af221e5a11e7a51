"""Toxicity of texts, after undoing disguised spelling.

Method: noisy channel. Runs of characters that look disguised (digits and symbols between letters,
letters repeated three times or more, single letters set apart) become a lattice: each place offers
the letters that its character may stand for, a repeated run offers itself once or twice, marks in
between may fall away, marks after the last letter may stay, separators of single letters, in any
mix, may fall away or be a word's edge. Viterbi decoding picks the path with the best sum of a
trigram model of letters and the cost of the disguise. Between longer pieces of words only the two
letters on either side matter to that sum, so those choices are read from a table of all such fours
(a-z). Runs of any length are decoded whole. The restored words are then scored.

Letter model: trigrams over a-z, one class for other letters and the word's edge, counted over all
texts; 28 to the power of 3 numbers, whatever the input. Lexicon: pieces of words, of 5 to 7 letters at any
place (a word's beginning and end count as letters), told apart by 64-bit hashes, that labelled toxic texts hold clearly more often
than others, once or twice; all of them. Score: a logistic curve over how much of the lexicon a text holds, absolutely
and by its number of words. Lexicon and curve are fitted on labelled rows, at most `MAX_LABELS` labels and
as many different texts (those with the smallest hashes); a larger set is sampled by that bound, which is
a parameter. Equal texts with equal labels count once. Letter counts cover all texts. The lexicon that
goes to the tasks is as large as that many texts give, whatever the input. Labelled texts are restored
once.

Null text counts as empty. Texts without words get the score of a text that holds nothing of the
lexicon. Labels other than 0 and 1, and labels without a text, are ignored; without labels of both
kinds every score is the share of toxic labels, or 0. A text that occurs several times gets equal
scores. All columns stay; one called like the new one is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.llm.rows import fresh, saved, with_arrow

MAX_LABELS = 50_000
#: An entry's log odds less so many standard errors must lie above `CLEAR`.
SURE, CLEAR = 2.0, 1.5
#: Lengths of pieces of words, in which a word's beginning and its end count as one letter each.
SIZES = (5, 6, 7)
OTHER, EDGE, CLASSES = 26, 27, 28
#: Letters that digits and symbols stand for in disguised spelling.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
        "#": "h", "(": "c"}
#: Log cost of reading a mark as a letter, of dropping one or several equal marks, of a repeated run,
#: of dropping a character between pieces of more than one letter.
SWAP, DROP, REPEAT, PIECE = -1.0, -6.0, -0.5, -3.0

LETTER, MARK = r"[^\W\d_]", r"[0-9@$!|+€£*#(]"
#: Marks that are no punctuation at a word's end.
LAST_MARK = "0123456789@$€£*|+#"
#: What sets letters apart.
BETWEEN = " \t\n\r.-_*"
WORD = re.compile(rf"{LETTER}+")
#: Marks between letters, before two letters at the start of a word or at its end; words all of marks.
MARKED = re.compile(rf"{LETTER}{MARK}+{LETTER}|(?<!\S)[0-9@$]+{LETTER}{{2}}|{LETTER}{MARK}*[{LAST_MARK}]"
                    rf"|(?<!\S)(?!\$[0-9])(?=[0-9!|+€£*#(]*[@$])({MARK})\1*(?!\1){MARK}{{1,}}(?!\S)")
DISGUISED = re.compile(rf"(?:{LETTER}|[0-9@$])(?:{LETTER}|{MARK})*")
SINGLE, GAP = r"(?:[^\W_]|[@$!€£+])", r"[ \t\n\r.\-_*]+"
APART = re.compile(rf"(?<![^\W_])[^\W_]{GAP}{SINGLE}(?:{GAP}{SINGLE})+(?![^\W_])")
APART_OF_MARK = re.compile(rf"(?<!\S)[@$]{GAP}{SINGLE}(?:{GAP}{SINGLE})+(?![^\W_])")
LONG_RUN = re.compile(rf"({LETTER})\1\1")
NO_LETTER = re.compile(r"[\W\d_]")
#: Only shorter runs are kept once decoded.
LONGEST = 64
#: Kinds of characters, by code point; all further ones are as the last.
GAP_KIND, MARK_KIND, LETTER_KIND, WORD_KIND, SIGN_KIND = 1, 2, 4, 8, 16
KINDS = np.array([GAP_KIND * (c in BETWEEN) + MARK_KIND * (c in "0123456789@$!|+€£*#(") + SIGN_KIND * (c in "@$")
                  + WORD_KIND * c.isalnum() + LETTER_KIND * (c.isalnum() and not c.isdecimal())
                  for c in map(chr, range(0x20000))] + [LETTER_KIND + WORD_KIND], np.uint8)
#: Bytes of text whose pieces are looked at at once.
SCORED_BYTES = 300_000
#: Base of the hashes of pieces, an odd number: the fraction of the golden ratio.
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_class(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of letter trigrams of the words of the texts, the edges included."""
    table = np.full(256, OTHER, np.int64)
    table[:128] = EDGE
    table[97:123] = np.arange(26)
    raw = " ".join(t for t in texts if t).lower().encode(errors="replace")
    codes = table[np.frombuffer(b" " + raw + b" ", np.uint8)]
    # continuation bytes belong to the letter before; edges in a row count once
    as_bytes = np.frombuffer(b" " + raw + b" ", np.uint8)
    codes = codes[(as_bytes & 0xC0) != 0x80]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == EDGE) & (codes[:-1] == EDGE)
    codes = codes[~again]
    if len(codes) < 3:
        return np.zeros(CLASSES**3, np.int64)
    grams = (codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:]
    return np.bincount(grams, minlength=CLASSES**3)


class Letters:
    """Log probability of a letter class after the two before."""

    def __init__(self, counts: np.ndarray) -> None:
        cube = counts.reshape(CLASSES, CLASSES, CLASSES) + 0.0
        pair = cube.sum(0)
        # interpolated with the bigram model, which is smoothed by adding a half
        lower = (pair + 0.5) / (pair.sum(1, keepdims=True) + 0.5 * CLASSES)
        seen = cube.sum(2, keepdims=True)
        log = np.log((cube + 5 * lower[None]) / (seen + 5))
        self.log = log.tolist()
        # of the two classes before and after a separator: what dropping it adds to the sum
        join = log[:, :, :, None] + log[None]
        edge = (log[:, :, EDGE][:, :, None, None] + log[:, EDGE, :][None, :, :, None]
                + log[EDGE][None, None])
        held = cube > 0
        # smoothing alone is no ground to join
        self.gain = np.where(held[:, :, :, None] & held[None], join - edge, -np.inf).astype(np.float32)
        self.gain[:, OTHER:] = self.gain[:, :, OTHER:] = -np.inf

    def decode(self, run: str) -> str:
        """The likeliest letters behind a disguised run; what can't be a letter falls away."""
        # state: the last two classes; value: (log probability, (what came before, letters))
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for offers in lattice(run):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (value, before) in best.items():
                for cost, letters in offers:
                    p, q, total = a, b, value + cost
                    for x in letters:
                        if x.isalpha() or x == " ":  # marks that stay are in no word
                            k = EDGE if x == " " else letter_class(x)
                            total += self.log[p][q][k]
                            p, q = q, k
                    if (p, q) not in after or total > after[p, q][0]:
                        after[p, q] = total, (before, letters)
            best = after
        _, back = max(((v + self.log[a][b][EDGE], t) for (a, b), (v, t) in best.items()), key=lambda x: x[0])
        out = []
        while back:
            back, letters = back
            out.append(letters)
        return "".join(reversed(out))

    def joined(self, text: str) -> str:
        """The text without separators between pieces that are likelier one word."""
        points = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)
        if len(points) < 3:
            return text
        low = POINTS[np.minimum(points, 128)]
        gap = GAPS[np.minimum(points, 128)]
        starts = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = ends[np.searchsorted(ends, starts[0], side="right"):] if len(starts) else ends
        starts = starts[:len(ends)]
        padded = np.concatenate([[EDGE], low, [EDGE]])  # one further on than in the text
        gain = self.gain[padded[starts - 1], padded[starts], padded[ends + 1], padded[ends + 2]]
        drop = np.flatnonzero(gain + PIECE * (ends - starts) > 0)
        if not len(drop):
            return text
        out, at = [], 0
        for start, end in zip(starts[drop].tolist(), ends[drop].tolist()):
            out.append(text[at:start])
            at = end
        return "".join([*out, text[at:]])


#: Letter class of a code point, 128 for all above; whether it is a separator.
POINTS = np.array([ord(c) - 97 if "a" <= c <= "z" else EDGE for c in map(chr, range(128))] + [OTHER])
GAPS = np.array([c in BETWEEN for c in map(chr, range(128))] + [False])


def collapsed(run: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in run:
        if out and out[-1][0] == c and c not in BETWEEN:
            out[-1] = c, out[-1][1] + 1
        elif out and out[-1][0][0] in BETWEEN and c in BETWEEN:
            out[-1] = out[-1][0] + c, 1
        else:
            out.append((c, 1))
    return out


def lattice(run: str) -> Iterator[list[tuple[float, str]]]:
    """What each place of a run offers: (cost, letters)."""
    places = collapsed(run)
    last = max((k for k, (c, _) in enumerate(places) if c.isalpha()), default=len(places))
    for place, (c, n) in enumerate(places):
        if c.isalpha():
            yield [(0.0 if n == 1 else REPEAT, c)] + ([(REPEAT, c + c)] if n > 1 else [])
        elif c[0] in BETWEEN:
            yield [(0.0, ""), (0.0, " "), *((SWAP, x) for x in LEET["*"] if "*" in c)]
        else:
            cost = DROP * min(n, 2) if place < last or c in LAST_MARK else 0.0
            yield [(cost, c * n if place > last else ""), *((SWAP + REPEAT * (n > 1), x) for x in LEET.get(c, "")),
                   *((SWAP, x + x) for x in LEET.get(c, "") if n > 1)]


class Restorer:
    """Words of texts in lower case, disguised ones restored; keeps runs it has decoded."""

    KEPT = 200_000

    def __init__(self, counts: np.ndarray) -> None:
        self.letters = Letters(counts)
        self.known: dict[str, str] = {}

    def read(self, run: str) -> str:
        if len(run) > LONGEST:
            return self.letters.decode(run)
        if run not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[run] = self.letters.decode(run)
        return self.known[run]

    def restored(self, text: str | None) -> str:
        text = (text or "").lower()
        may = may_hold(text)
        if may.apart:
            before = text
            for apart in (APART, APART_OF_MARK):
                text = apart.sub(lambda m: self.read(m[0]), text)
            may = may if text == before else may_hold(text)
        if may.marked:
            text = self._rewritten(text, MARKED, str.isspace, self._undisguised)
        if may.repeated or may.marked:
            text = self._rewritten(text, LONG_RUN, NO_LETTER.match, self.read)
        return self.letters.joined(text)

    @staticmethod
    def _rewritten(text: str, pattern: re.Pattern, outside: Callable, rewrite: Callable[[str], str]) -> str:
        """The text with every stretch around a match, up to characters that are `outside`, rewritten."""
        out, at = [], 0
        while found := pattern.search(text, at):
            begin, end = found.span()
            while begin > at and not outside(text[begin - 1]):
                begin -= 1
            while end < len(text) and not outside(text[end]):
                end += 1
            out += text[at:begin], rewrite(text[begin:end])
            at = end
        return "".join([*out, text[at:]]) if out else text

    def _undisguised(self, piece: str) -> str:
        return DISGUISED.sub(lambda m: self.read(m[0]) if MARKED.search(m[0]) else m[0], piece)

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(self.restored(text))


class May(NamedTuple):
    """What a text may hold; False is certain."""
    apart: bool
    marked: bool
    repeated: bool


def may_hold(text: str) -> May:
    """Looks at all characters at once, as that is quicker than the patterns."""
    points = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)
    if len(points) < 2:
        return May(False, False, False)
    kinds = KINDS[np.minimum(points, len(KINDS) - 1)]
    gap, mark, letter = (kinds & GAP_KIND) > 0, (kinds & MARK_KIND) > 0, (kinds & LETTER_KIND) > 0
    marked = bool(((mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])).any() or (kinds & SIGN_KIND).any())
    same = points[1:] == points[:-1]
    repeated = bool((same[1:] & same[:-1]).any())
    # a piece between gaps that is one character, with single characters on either side
    joint = (kinds & WORD_KIND) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    if len(begins) < 3:
        return May(False, marked, repeated)
    last_alone = (ends - begins == 1) | ~joint[ends - 2]
    first_alone = (ends - begins == 1) | ~joint[np.minimum(begins + 1, len(points) - 1)]
    apart = bool((last_alone[:-2] & (ends - begins == 1)[1:-1] & first_alone[2:]).any())
    return May(apart, marked, repeated)


class Pieces(NamedTuple):
    """The pieces of the words of several texts."""
    hashes: np.ndarray
    #: of each piece: its word and its text
    word: np.ndarray
    text: np.ndarray
    #: of each word: its text; of each text: how many words it has
    word_text: np.ndarray
    words: np.ndarray


def pieces_of(texts: list[str]) -> Pieces:
    """All pieces of all words, at any place. What is between words counts as one letter at both ends of a
    word; a word too short for the smallest size is one piece."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    raw = ("".join(t + "\n" for t in texts)).encode("utf-32-le", errors="surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    letter = (KINDS[np.minimum(points, len(KINDS) - 1)] & LETTER_KIND) > 0
    codes = np.concatenate([[0], np.where(letter, points, 0)]).astype(np.uint64)
    of_text = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])
    # what is between words is one 0, and there is one before the first and after the last
    kept = np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])
    codes, of_text = codes[kept], of_text[kept]
    edge = codes == 0
    starts = ~edge & np.concatenate([[True], edge[:-1]])
    word, edges = np.cumsum(starts) - 1, np.cumsum(edge)
    word_text = of_text[starts]
    hashes, words, value = [], [], codes
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        value = value[:-1] * BASE + codes[size - 1:]
        # no edge inside, be it first or last
        valid = edges[size - 2:len(edges) - 1] - edges[:len(edges) - size + 1] == 0
        if size < min(SIZES):
            valid &= edge[:len(edges) - size + 1] & edge[size - 1:]
            valid &= size > 2
        at = np.flatnonzero(valid)
        hashes.append(value[at] + np.uint64(size))
        words.append(word[at + 1])
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    of_word = np.concatenate(words) if words else np.zeros(0, np.int64)
    return Pieces(found.view(np.int64), of_word, word_text[of_word], word_text,
                  np.bincount(word_text, minlength=len(texts)))


def piece_hash(piece: str) -> int:
    """The hash of a piece; `<` and `>` are the ends of a word."""
    value = 0
    for c in piece:
        value = value * int(BASE) + (0 if c in "<>" else ord(c))
    value = (value + len(piece)) % 2**64
    return value - 2**64 if value >= 2**63 else value


@dataclass
class Model:
    letters: np.ndarray
    #: hashes of pieces, ascending; their weights in texts that hold them, and if twice or more
    entries: np.ndarray
    once: np.ndarray
    twice: np.ndarray
    curve: list[float]

    def __post_init__(self) -> None:
        #: whether an entry's hash may begin with these 20 bits
        self.beginnings = np.zeros(1 << 20, bool)
        self.beginnings[self.entries.view(np.uint64) >> np.uint64(44)] = True

    def features(self, texts: list[str]) -> np.ndarray:
        """Of restored texts: one, the lexicon's weight in it, that weight by words, and the words.

        A word weighs as much as the weightiest entry that it holds.
        """
        pieces = pieces_of(texts)
        size = np.maximum(pieces.words, 1)
        total = np.zeros(len(texts))
        at = np.flatnonzero(self.beginnings[pieces.hashes.view(np.uint64) >> np.uint64(44)])
        if len(at) and len(self.entries):
            place = np.minimum(np.searchsorted(self.entries, pieces.hashes[at]), len(self.entries) - 1)
            there = self.entries[place] == pieces.hashes[at]
            at, place = at[there], place[there]
            _, pair, often = np.unique(pieces.text[at] * len(self.entries) + place, return_inverse=True,
                                       return_counts=True)
            weight = np.where(often[pair] > 1, np.maximum(self.once, self.twice)[place], self.once[place])
            words, word = np.unique(pieces.word[at], return_inverse=True)
            best = np.zeros(len(words))
            np.maximum.at(best, word, weight)
            total = np.bincount(pieces.word_text[words], best, len(texts))
        return np.column_stack([np.ones(len(texts)), np.log1p(total), np.log1p(100 * total / size), np.log1p(size)])

    def score(self, texts: list[str]) -> list[float]:
        # column by column, as a matrix product rounds by the number of rows
        z = sum(weight * column for weight, column in zip(self.curve, self.features(texts).T, strict=True))
        return (1 / (1 + np.exp(-np.clip(z, -35, 35)))).tolist()


def log_odds_bound(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Lower bound of the log of how much more often toxic texts hold an entry than others."""
    ratio = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
    return ratio - SURE * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton's steps, slightly drawn to zero."""

    def loss(weights: np.ndarray) -> float:
        z = rows @ weights
        return float(np.logaddexp(0, z).sum() - labels @ z + 0.05 * weights @ weights)

    weights = np.zeros(rows.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -35, 35)))
        slope = rows.T @ (labels - p) - 0.1 * weights
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(len(weights))
        step, here = np.linalg.solve(bend, slope), loss(weights)
        while loss(weights + step) > here and np.abs(step).max() > 1e-9:
            step /= 2
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def count_letters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Letter trigrams of all texts; each task sends at most CLASSES ** 3 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            cells = batch.column(0).to_pylist()
            for at in range(0, len(cells), 500):
                total += trigram_counts(cells[at:at + 500])
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(total[grams])],
                                         ["gram", "n"])

    rows = (docs.select(F.col(f"`{text}`")).mapInArrow(run, "gram int, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(CLASSES**3, np.int64)
    for row in rows:
        out[row["gram"]] = row["n"]
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, letters: np.ndarray, doc_id: str, text: str, label: str,
                   max_rows: int) -> DataFrame:
    """toxic and the restored text of labelled texts.

    Rows with equal text and label are one; of the different ones those with the smallest hash of the
    text are taken, at most `max_rows`.
    """
    marked = (labels.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{label}`").cast("int").alias("toxic"))
              .where("toxic IN (0, 1) AND _doc IS NOT NULL").distinct()
              .orderBy(F.xxhash64("_doc"), "_doc", "toxic").limit(max_rows))
    texts = (docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
             .where("_text IS NOT NULL").withColumn("_digest", F.md5(F.col("_text").cast("binary")))
             .join(F.broadcast(marked), "_doc"))
    key = ["_digest", "toxic"]
    # of equal texts that with the smallest id; only rows that are equal in all must meet in a shuffle
    rows = texts.groupBy(*key, "_doc").agg(F.count("*").alias("_rows"))
    chosen = (rows.groupBy(*key).agg(F.min(F.struct("_doc", "_rows")).alias("_first"))
              .select(*key, "_first.*").orderBy(*key).limit(max_rows))
    picked = texts.join(F.broadcast(chosen), [*key, "_doc"])
    once = (picked.where("_rows = 1").unionByName(picked.where("_rows > 1").dropDuplicates(key))
            .select("toxic", "_text"))
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    def start():
        restorer = Restorer(shared.value)
        return lambda cells: [[restorer.restored(t) for t in cells]]

    return with_arrow(once, ["_text"], [T.StructField("restored", T.StringType())], start).drop("_text")


def count_pieces(known: DataFrame) -> DataFrame:
    """entry, often, clean and toxic: in how many texts of either label each piece stands, and (`often`)
    stands twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by (label, often): the pieces of one text after the other
        held: dict[tuple[int, bool], list[np.ndarray]] = {(y, o): [] for y in (0, 1) for o in (False, True)}
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (toxic, often), lists in held.items():
                entries, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_counts=True)
                zeros, counts = np.zeros(len(entries), np.int64), counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entries), pa.array(np.full(len(entries), often)), pa.array(zeros if toxic else counts),
                     pa.array(counts if toxic else zeros)], ["entry", "often", "clean", "toxic"])
                lists.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entries, counts = np.unique(pieces_of([text]).hashes, return_counts=True)
                held[toxic, False].append(entries)
                held[toxic, True].append(entries[counts > 1])
                waiting += len(entries)
                if waiting > 500_000:
                    yield from out()
                    waiting = 0
        yield from out()

    return (known.select("restored", "toxic").mapInArrow(count, "entry long, often boolean, clean long, toxic long")
            .groupBy("entry", "often").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def lexicon(letters: np.ndarray, weights: dict[tuple[int, bool], float]) -> Model:
    """A model of these weights of (hash, often), without a curve."""
    entries = np.array(sorted({e for e, _ in weights}), np.int64)
    once, twice = (np.array([weights.get((e, often), 0.0) for e in entries.tolist()]) for often in (False, True))
    return Model(letters, entries, once, twice, [0.0] * 4)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", max_labels: int = MAX_LABELS) -> Model:
    """Letter counts of all `docs`; lexicon and curve from the rows of `labels`."""
    letters = count_letters(docs, text)
    known = saved(labelled_texts(docs, labels, letters, doc_id, text, label, max_labels))
    totals = known.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    n_clean, n_toxic = totals["clean"] or 0, totals["toxic"] or 0
    if not n_clean or not n_toxic:
        none = lexicon(letters, {})
        none.curve = [35.0 if n_toxic else -35.0, 0.0, 0.0, 0.0]
        return none
    bound = log_odds_bound(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    rows = count_pieces(known).withColumn("weight", bound).where(F.col("weight") > CLEAR).collect()
    model = lexicon(letters, {(r["entry"], r["often"]): r["weight"] for r in rows})
    held_by = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda texts: [held_by.value.features(texts).tolist()]

    field = T.StructField("features", T.ArrayType(T.DoubleType()))
    rows = with_arrow(known, ["restored"], [field], start, SCORED_BYTES).select("features", "toxic").collect()
    rows.sort()
    model.curve = fit_curve(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    return model


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`df` with a score from 0 to 1; higher: likelier toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        restorer = Restorer(shared.value.letters)
        return lambda texts: [shared.value.score([restorer.restored(t) for t in texts])]

    return with_arrow(df, [text], [T.StructField(name, T.DoubleType())], start, SCORED_BYTES)


def without_toxic(df: DataFrame, model: Model, text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of `df` whose text scores below `at`."""
    name = fresh(df, "toxic_score")
    return score(df, model, text, name).where(F.col(name) < at).drop(name)
