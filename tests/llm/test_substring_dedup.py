import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import queries
from billweave.llm import substring_dedup as s
from helpers import LONG, documents, prose, rng


def brute(rows, size=13):
    """(id, words, intervals, kept text) of every row, by sets of windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owners = {}
    for (i, _), words in zip(rows, split):
        for at in range(len(words) - size + 1):
            if i is not None:
                owners.setdefault(tuple(words[at:at + size]), set()).add(i)
    out = []
    for (i, _), words in zip(rows, split):
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            if i is not None and min(owners[tuple(words[at:at + size])]) < i:
                gone[at:at + size] = [True] * size
        edges = [n for n in range(len(words) + 1)
                 if (n > 0 and gone[n - 1]) != (n < len(words) and gone[n])]
        out.append((i, len(words), list(zip(edges[::2], edges[1::2])),
                    " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r.n_words, [tuple(x) for x in r.removed], r.kept) for r in df.collect()), key=repr)


def test_rolling_hash_is_the_polynomial():
    codes = np.random.default_rng(3).integers(0, 2**64, 40, np.uint64)
    for size in (1, 4, 40, 41):
        wanted = [sum(int(c) * s.BASE ** (size - 1 - j) for j, c in enumerate(codes[i:i + size])) % 2**64
                  for i in range(40 - size + 1)]
        assert s.rolling(codes, size, s.BASE).tolist() == wanted


def test_planes_give_the_numbers_back():
    a, b = np.array([1, 2**64 - 1, 7], np.uint64), np.array([], np.uint64)
    assert s.from_planes([s.planes(a), s.planes(b), s.planes(a[:1])]).tolist() == [1, 2**64 - 1, 7, 1]
    assert s.from_planes([]).tolist() == []


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 3000, "bucket": 200}])
def test_like_sets_of_windows(spark, limits):
    r = rng()
    passages = [prose(r, n, 400) for n in (13, 14, 30, 60)]
    texts = []
    for n in range(120):
        words = prose(r, r.randrange(0, 60), 400).split()
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages).split()
        texts.append(r.choice([" ", "\t", "\n\r "]).join(words))
    texts += [texts[5]] * 4 + [passages[0] + " " + passages[0], "a b c " * 40, "a b c " * 40, "Ünï ほ x " * 15] * 2
    rows = list(zip(r.sample(range(10_000), len(texts)), texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"n_words": F.lit("x"), "block": F.lit(1), "copies": F.lit(0)})
    assert found(s.cut_repeats(docs.repartition(5), **limits)) == brute(rows)


def test_nulls_ties_repeated_rows_long_and_empty(spark):
    passage = prose(rng(8), 20, 1000)
    rows = [(1, None), (2, ""), (None, passage), (3, passage), (3, passage), (3, "so " + passage), (4, passage),
            (4, passage), (None, None), (5, LONG), (6, LONG), (-7, "before " + passage), (7, "few words"), (8, "few words")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = s.cut_repeats(docs.coalesce(1))
    assert found(got) == brute(rows) and got.schema["doc_id"].dataType.simpleString() == "int"
    assert s.cut_repeats(documents(spark, [])).count() == 0
    assert found(s.cut_repeats(docs, window=1)) == brute(rows, 1)
    with pytest.raises(TypeError):
        s.cut_repeats(docs.withColumn("doc_id", F.lit("a")))


def test_texts_are_shuffled_once(spark, tmp_path):
    documents(spark, [prose(rng(2), 50)] * 9).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op13_substrings(spark, str(tmp_path))
    got = {r.doc_id: r for r in df.collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed) == (50, 0, 50)
    assert got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("hashpartitioning(block") < 4
