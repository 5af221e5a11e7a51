"""Spelling variants: frequent words that differ by one character, grouped under the commoner spelling.

Method: pivotal grams. The bigrams of a word are ordered by how many words hold them, rarest first. The
prefix of a word are its first three places in that order and all places of grams up to the third's;
its pivots are two places of the prefix that share no character, chosen by dynamic programming for
the smallest sum of counts. One edit leaves one of two disjoint grams whole. So of two words that are
one edit apart, the one whose prefix ends earlier in the order has a pivot that stands in the other's
prefix, and pivots only have to meet prefixes.

Position limits: the edit lies to one side of the surviving pivot, so on the other side the words are equal,
the gram's distance to that end included. A place is therefore indexed under the whole of what lies to its
left, and under the whole of what lies to its right (its gram with both). A word looks for others under
all that lies to the left of its first pivot, and under all that lies to the right of its last one. Words
that met and whose length differs by one at most are compared: first by halves, then in full.

Words are what `word_counts` gives: runs of letters (A-Z and U+00C0 to U+00FF; only A-Z are lower-cased) of at
least `least_length` characters that occur `least_count` times or more, over all texts. Null and empty
texts hold none, an empty table gives an empty table, a null id counts as the empty text, rows that are
equal count as often as they occur, and columns besides id and text are not read. Texts are read whole.
Two words are near if they differ by one inserted, deleted or replaced character. A word's form is the
near word of largest count (ties: the smallest in code-point order) if that count is `ratio` times the
word's own or more. Its root is where forms lead; counts grow along them, so they end.

How it is spread: words are counted in tasks and summed; what follows works on distinct words alone. Grams
are at most 90 * 90, so their counts are broadcast. Candidates come from one equi-join, whose keys adaptive
execution may split; links are rows of two words, and forms are sums that combine before the shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.rows import LOWER, UPPER, saved

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
GRAM = 2
#: Of the prefix: one gram more than an edit can destroy.
PREFIX = GRAM + 1
PIVOTS = 2
#: One in so many runs loses a character before it is counted.
SLIP = 199

RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points of words: a-z and U+00C0 to U+00FF.
ALPHABET = 26 + 64
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def runs(text: str | None) -> Counter:
    """The runs of letters of a text and how often they occur."""
    lowered = (text or "").encode(errors="surrogatepass").translate(_LOWER).decode(errors="surrogatepass")
    return Counter(RUN.findall(lowered))


def with_slips(doc_id: object, counts: Counter) -> Iterator[tuple[str, int]]:
    """Words and counts of a document; runs whose checksum with the id falls so lose one character."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def as_they_are(doc_id: object, counts: Counter) -> Iterator[tuple[str, int]]:
    yield from counts.items()


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT,
                read: Callable[[object, Counter], Iterator[tuple[str, int]]] = as_they_are) -> DataFrame:
    """word and n: every word of the corpus that is long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()),
                                               pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for ident, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in read(ident, runs(cell)):
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > 200_000:
                    yield out()
                    total.clear()
        yield out()

    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram stands; there are at most ALPHABET ** 2 of them."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1),
                                         lambda p: F.substring(F.col("word"), p, F.lit(GRAM))))
    rows = words.where(F.length("word") >= GRAM).select(F.explode(grams).alias("gram")).groupBy("gram").count()
    found = {r["gram"]: r["count"] for r in rows.collect()}
    assert len(found) <= ALPHABET**GRAM
    return found


def pivots(places: list[int], cost: Callable[[int], int], count: int = PIVOTS) -> list[int]:
    """`count` of the ascending places, at least GRAM apart, of the smallest total cost."""
    # best[k]: (cost, places) of the cheapest choice of k among the places so far
    history: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for n, place in enumerate(places):
        before = history[-1] if history else [(0, ())] + [None] * count
        # choices that end far enough to the left for this place to be added
        free = next((history[m] for m in range(n - 1, -1, -1) if places[m] <= place - GRAM),
                    [(0, ())] + [None] * count)
        here = list(before)
        for k in range(1, count + 1):
            if free[k - 1] is not None:
                added = free[k - 1][0] + cost(place), (*free[k - 1][1], place)
                if here[k] is None or added < here[k]:
                    here[k] = added
        history.append(here)
    best = history[-1][count] if history else None
    return list(best[1]) if best else []


def prefix(word: str, counts: dict[str, int]) -> tuple[list[int], list[int]]:
    """(all places of the word's rarest grams, its pivots)."""
    grams = [word[p:p + GRAM] for p in range(len(word) - GRAM + 1)]
    order = sorted((counts[g], g, p) for p, g in enumerate(grams))
    last = order[min(PREFIX, len(order)) - 1][:2]
    places = sorted(p for n, g, p in order if (n, g) <= last)
    return places, pivots(places, lambda p: counts[grams[p]])


def keys(word: str, counts: dict[str, int]) -> tuple[list[str], list[str]]:
    """(the keys under which a word is found, those under which it looks for others).

    An edit to the left of the last pivot leaves that and all to its right as it is; any other edit leaves
    all to the left of the last pivot, and so the first pivot and what is before it.
    """
    places, (first, *_, last) = prefix(word, counts)
    found = [side for p in places for side in ("<" + word[:p + GRAM], ">" + word[p:])]
    return found, ["<" + word[:first + GRAM], ">" + word[last:]]


def _index(shared, seeking: bool):
    """Rows (key, word, n) of words to be found or of words that look for others."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                rows = [(key, word, n) for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                        for key in keys(word, shared.value)[seeking]]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                    ["key", "word", "n"])

    return index


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words that are one edit apart, both ways, once each.

    Words have to be distinct and of four characters at least, for two disjoint grams.
    """
    counts = words.sparkSession.sparkContext.broadcast(gram_counts(words))
    fields = "key string, word string, n long"
    found = words.select("word", "n").mapInArrow(_index(counts, False), fields).withColumn("size", F.length("word"))
    seeking = words.select("word", "n").mapInArrow(_index(counts, True), fields)
    # one of the halves has no edit in it
    half = F.floor(F.length("word") / 2).cast("int")
    seeking = seeking.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"),
                             F.length("word").alias("near_size"), F.substring("word", F.lit(1), half).alias("left"),
                             F.expr("substring(word, cast(floor(length(word) / 2) as int) + 1)").alias("right"))
    agree = F.col("word").startswith(F.col("left")) | F.col("word").endswith(F.col("right"))
    met = (found.join(seeking, "key").where("abs(size - near_size) <= 1 AND word <> near").where(agree)
           .where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"))
    other = met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                       F.col("n").alias("near_n"))
    return met.unionByName(other).distinct()


def roots(forms: DataFrame, largest: int, ratio: int) -> DataFrame:
    """word and root of every word of `forms` (word, form), by doubling the steps taken.

    Every step multiplies the count by `ratio`, which bounds their number by that of the largest count.
    """
    steps, done = 1, 1
    while ratio**steps <= largest:
        steps += 1
    reached = forms.select("word", F.col("form").alias("root"))
    while done < steps:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = saved(reached.join(further, "root", "left")
                        .select("word", F.coalesce("next", "root").alias("root")))
        done *= 2
    return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `words` (word, n)."""
    words = saved(words.select("word", "n"))
    # of the largest count the smallest word: the least of (-count, word)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    rows = saved(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")))
    largest = words.agg(F.max("n")).first()[0] or 1
    ends = roots(rows.where("form IS NOT NULL"), largest, ratio)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")
