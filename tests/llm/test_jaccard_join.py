import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import jaccard_join as j
from billweave.llm.components import components
from helpers import LONG, documents, prose, rng


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_force(ids, texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for a in range(len(ids)):
        groups.setdefault(root(a), []).append(ids[a])
    return [(len(sets[a]), min((i for i in groups[root(a)] if i is not None), default=None)) for a in range(len(ids))]


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    """A loose group, a chain of copies, copies with other case and blanks, shared passages."""
    r = rng(8)
    out = []
    base = prose(r, 160, 3000).split()
    out += [" ".join(changed(r, base, r.randrange(0, 9))) for _ in range(60)]
    chain = prose(r, 120, 3000).split()
    for _ in range(12):
        chain = changed(r, chain, 2)
        out.append(" ".join(chain))
    passage = prose(r, 60, 3000)
    out += [f"{passage} {prose(r, r.randrange(5, 120), 3000)}" for _ in range(40)]
    out += ["One  two three", "one two THREE", "one two four", "x", "X", None, "", " \n ", None, LONG, LONG, "same five words in here"] * 2
    out += [prose(r, r.randrange(1, 200), 3000) for _ in range(60)]
    return out


@pytest.mark.parametrize("block, chunk", [(j.BLOCK, j.CHUNK), (10, 8)])
def test_like_brute_force_however_groups_are_split(spark, texts, monkeypatch, block, chunk):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "CHUNK", chunk)
    ids = list(range(1, len(texts) + 1))
    r = rng()
    r.shuffle(ids)
    got = j.similar_groups(documents(spark, texts, ids).withColumns({"name": F.lit(1), "group": F.lit(2)}))
    expected = dict(zip(ids, brute_force(ids, texts)))
    assert {g.id: (g.n, g.group) for g in got.collect()} == expected


def test_trees_lose_nothing(texts):
    sets = [s for t in texts if len(s := j.shingles(t))]
    one = list(j.tree_links(sets, np.zeros(len(sets), int)))
    groups = j.Groups(len(sets))
    for a, b in one:
        groups.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert groups.root(a) == groups.root(b)
    side = np.arange(len(sets)) % 2 + 1
    assert all(side[a] != side[b] for a, b in j.tree_links(sets, side))


def test_keep_one_of_each_group(spark, texts):
    ids = list(range(1, len(texts) + 1))
    docs = documents(spark, texts, ids).withColumn("rid", F.lit("mine"))
    twice = docs.unionByName(docs.where("doc_id = 1"))
    kept = j.keep_one(twice)
    expected = {g for n, g in brute_force(ids, texts) if n} | {i for i, (n, _) in zip(ids, brute_force(ids, texts)) if not n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and kept.columns == docs.columns


def test_null_ids_and_empty_table(spark):
    texts = ["a b c d e f g"] * 3 + ["q r s t u v"] * 2
    got = j.similar_groups(documents(spark, texts, [None, 5, 4, None, None])).collect()
    assert sorted((g.id or 0, g.group or 0) for g in got) == [(0, 0), (0, 0), (0, 4), (4, 4), (5, 4)]
    assert j.similar_groups(documents(spark, [])).count() == 0
    assert j.keep_one(documents(spark, [])).count() == 0


def test_groups_of_one_name_are_apart(spark):
    first, second, third = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(first, None), (first + " more", None), (second, None), (third, None), ("", None), (None, None),
            ("m n o p q r", 7), ("s t u v w x", 7), ("S t u v w x", 9), ("s t u v w x", None)]
    texts, ids = [t for t, _ in rows], [i for _, i in rows]
    got = j.similar_groups(documents(spark, texts, ids))
    assert got.where("root IS NOT NULL").select("root").distinct().count() == 5
    assert got.where("root IS NULL").count() == 2
    kept = [(r.text, r.doc_id) for r in j.keep_one(documents(spark, texts, ids)).collect()]
    assert len(kept) == 7 and len({t for t, _ in kept} & {first, first + " more"}) == 1
    assert {(second, None), (third, None), ("", None), (None, None), ("m n o p q r", 7), ("s t u v w x", 7)} < set(kept)


def test_components(spark):
    r = rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)] + [
        (r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(120)] + [(5, 5)]
    groups = j.Groups(2000)
    for a, b in edges:
        groups.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: groups.root(n) for e in edges for n in e if e[0] != e[1]}


def test_bitmaps_allow_every_link():
    """Sizes on both sides of a width, folded maps, and maps that are full."""
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 30, 32, 33, 40, 500, 513, 600, 17_000, 40_000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.75, 0.8, 0.9, 1.0):
            kept = base[:max(1, int(np.ceil(n * share)))]
            sets += [np.unique(kept), np.unique(np.concatenate([kept, r.integers(0, 2**63, n // 8, dtype=np.uint64)]))]
    maps = j.Bitmaps(np.array([len(s) for s in sets]), [j.bitmap(s) for s in sets], np.array([s[0] for s in sets]))
    a, b = np.triu_indices(len(sets), 1)
    linked = np.array([j.links(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist())])
    allowed = maps.may_link(a, b)
    assert linked.any() and not (linked & ~allowed).any()
    assert allowed.sum() < 2 * linked.sum()
    met = {(min(x, y), max(x, y)) for left, right in j.leaf_pairs(maps, np.arange(len(sets)))
           for x in left.tolist() for y in right.tolist()}
    assert {(x, y) for x, y in zip(a[linked].tolist(), b[linked].tolist())} <= met


def test_bitmaps_tell_long_unlike_sets_apart():
    r = np.random.default_rng(4)
    for n in (40, 400, 4_000, 16_000):
        sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(10)]
        maps = j.Bitmaps(np.array([len(s) for s in sets]), [j.bitmap(s) for s in sets], np.zeros(10))
        assert not maps.may_link(*np.triu_indices(10, 1)).any()


def test_one_text_of_millions_of_words(spark):
    def numbers(first, last):
        return F.array_join(F.sequence(F.lit(first), F.lit(last)).cast("array<string>"), " ")

    docs = spark.range(1, 6).select(F.col("id").alias("doc_id"), F.expr("CASE id WHEN 5 THEN 'a b c d e f' END").alias("text"))
    for doc, first, last in ((1, 0, 5_000_000), (2, 90, 5_000_000), (3, 0, 60), (4, 2, 60)):
        docs = docs.withColumn("text", F.when(F.col("doc_id") == doc, numbers(first, last)).otherwise(F.col("text")))
    got = {g.id: (g.n, g.group) for g in j.similar_groups(docs).select("id", "n", "group").collect()}
    assert got == {1: (4_999_997, 1), 2: (4_999_907, 1), 3: (57, 3), 4: (55, 3), 5: (2, 5)}
