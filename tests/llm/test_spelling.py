import itertools
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from billweave.llm import spelling as s
from helpers import LONG, documents, rng


def one_edit(a, b):
    """Whether one inserted, deleted or replaced character makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts, ratio=5):
    """(word, form, root, n, n_near, form_n) of every word."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    forms = {}
    for w, around in near.items():
        top = min(around, key=lambda x: (-counts[x], x), default=None)
        if top and counts[top] >= ratio * counts[w]:
            forms[w] = top

    def root(w):
        while w in forms:
            w = forms[w]
        return w
    return sorted((w, forms.get(w), root(w), n, len(near[w]), counts.get(forms.get(w))) for w, n in counts.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(r, letters, count, edits):
    words = {"".join(r.choices(letters, k=r.randrange(6, 11))) for _ in range(count)}
    for w in r.sample(sorted(words), min(edits, len(words))):
        for _ in range(3):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice(letters) + w[k + 1:], w[:k] + r.choice(letters) + w[k:],
                          w + r.choice(letters), r.choice(letters) + w])
            if len(w) >= 6:
                words.add(w)
    return sorted(words)


@pytest.mark.parametrize("letters, count", [("ab", 150), ("abcdefgh", 250), ("aeéßÿÀz", 250)])
def test_like_all_pairs(spark, letters, count):
    r = rng(len(letters))
    counts = {w: 5 * 6 ** r.randrange(6) for w in vocabulary(r, letters, count, 120)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = brute(counts)
    assert found(s.variants(words)) == expected
    assert sum(e[1] is not None for e in expected) > 20 and any(e[1] != e[2] and e[1] for e in expected)


def test_every_pair_meets_by_pivot_and_prefix():
    r = rng(4)
    words = vocabulary(r, "abcd", 200, 150)
    counts = Counter(g for w in words for g in {w[p:p + 2] for p in range(len(w) - 1)})
    keys = {}
    for w in words:
        places, chosen = s.prefix(w, counts)
        assert set(chosen) <= set(places) and len(chosen) == 2 and chosen[1] - chosen[0] >= 2
        keys[w] = list(map(set, s.keys(w, counts)))
        assert keys[w][0] == {k for p in places for k in ("<" + w[:p + 2], ">" + w[p:])}
        assert keys[w][1] == {"<" + w[:chosen[0] + 2], ">" + w[chosen[1]:]}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            assert keys[a][1] & keys[b][0] or keys[b][1] & keys[a][0]


def test_pivots_are_the_cheapest_disjoint_places():
    r = rng(9)
    for _ in range(200):
        places = sorted(r.sample(range(9), r.randrange(0, 6)))
        costs = {p: r.randrange(5) for p in places}
        pairs = [(costs[a] + costs[b], (a, b)) for a, b in itertools.combinations(places, 2) if b - a >= 2]
        assert s.pivots(places, costs.get) == (list(min(pairs)[1]) if pairs else [])
    assert s.pivots([0, 2, 4], {0: 1, 2: 1, 4: 1}.get, 3) == [0, 2, 4]


def test_words_of_texts_with_slips(spark):
    r = rng(6)
    base = ["letters", "Ünderway", "ÉCOLES", "straße", "seven×two", "abc", "a", "o"]
    texts = [" ".join(r.choices(base, k=300)) + "-x1y" for _ in range(150)] + [None, "", LONG, "letters " * 10] * 2
    slip = next(i for i in itertools.count(1000) if zlib.crc32(f"{i}:letters".encode()) % 199 == 0)
    ids = [slip, *range(len(texts) - 3), None, None]
    docs = documents(spark, texts, ids).withColumns({"word": F.lit(1), "n": F.lit("n")})
    expected = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            expected[run] += 1
    wanted = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    got = {r.word: r.n for r in s.word_counts(docs, read=s.with_slips).collect()}
    assert got == wanted and set(got) > {"letters", "Ünderway", "Écoles", "straße", "seven×two"}
    assert any(len(w) == 6 and one_edit(w, "letters") for w in wanted)
    assert found(s.variants(s.word_counts(docs, read=s.with_slips))) == brute(wanted)
    plain = {r.word: r.n for r in s.word_counts(docs, least_length=1, least_count=1).collect()}
    assert plain["letters"] == sum((t or "").count("letters") for t in texts) and plain["x"] == 150
    assert s.variants(s.word_counts(documents(spark, []))).count() == 0


def test_ties_and_long_chains(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625,
              "bbbbbb": 78125, "caaaaa": 25, "zzzzzzz": 9, "zzzzzz": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(s.variants(words))
    assert got == brute(counts)
    assert got[0][:3] == ("aaaaaa", "aaaaab", "bbbbbb")
