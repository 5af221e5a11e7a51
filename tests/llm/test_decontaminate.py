import re

import pytest
from pyspark.sql import functions as F

from billweave.llm import decontaminate as d
from helpers import LONG, documents, prose, rng

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items):
    found, hit, ids = words(text), set(), set()
    for item, passage in items:
        parts = words(passage)
        size = min(13, len(parts))
        for at in range(len(parts) - size + 1 if size else 0):
            for p in range(len(found) - size + 1):
                if found[p:p + size] == parts[at:at + size]:
                    hit |= set(range(p, p + size))
                    ids.add(item)
    return len(found), len(hit), ids


@pytest.fixture(scope="module")
def tables(spark):
    r = rng()
    items = [(i, prose(r, r.randrange(14, 40), 500)) for i in range(20)]
    items += [(100, "only two"), (101, "single"), (102, ""), (103, None), (3, items[3][1]), (104, "Été, ñu; 中文 x9"),
              (105, "w1 " * 13), (None, "no id at all here")]
    texts = [None, "", "?!", LONG, "a single word", "Only, TWO! and only-two", "été ñu 中文 X9", "w1 " * 30, "no id at all here"]
    for _ in range(60):
        item = items[r.randrange(20)][1].split()
        cut = r.randrange(len(item))
        texts.append(" ".join([prose(r, r.randrange(60)), *item[cut:cut + r.randrange(5, 30)], prose(r, r.randrange(400))]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return documents(spark, texts).withColumns({"hits": F.lit("x"), "n_words": F.lit("y")}), benchmark, texts, items


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 1500])
def test_like_brute_force_also_with_items_in_blocks(spark, tables, block, monkeypatch):
    docs, benchmark, texts, items = tables
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    found = d.find_passages(docs, benchmark)
    rows = found.select("n_words", d.hit_words(F.col("hits")).alias("n"), d.hit_items(F.col("hits")).alias("ids"),
                        "doc_id").orderBy("doc_id").collect()
    for text, row in zip(texts, rows, strict=True):
        n, hit, ids = brute_force(text, items)
        assert (row.n_words, row.n, row.ids) == (n, hit, sorted(str(i) for i in ids if i is not None)), text


def test_hashes_that_collide_and_copies_cost_no_result(spark, tables, monkeypatch):
    docs, benchmark, texts, items = tables
    monkeypatch.setattr(d, "SLOTS", 4)
    monkeypatch.setattr(d, "PLACES", 8)
    found = d.find_passages(docs.union(docs), benchmark)
    rows = found.select("n_words", d.hit_words(F.col("hits")).alias("n"), d.hit_items(F.col("hits")).alias("ids"),
                        "doc_id").orderBy("doc_id").collect()
    for text, *pair in zip(texts, rows[::2], rows[1::2], strict=True):
        n, hit, ids = brute_force(text, items)
        for row in pair:
            assert (row.n_words, row.n, row.ids) == (n, hit, sorted(str(i) for i in ids if i is not None)), text


def test_tables_of_hashes_are_bounded_and_texts_stay_where_they_are(spark, tables):
    docs, benchmark, _, _ = tables
    items = benchmark.selectExpr("item_id AS item", "text").where(F.length("text") > 0)
    held = d.hash_tables(items, d.WINDOW)
    assert sum(map(len, held.values())) <= d.WINDOW * d.SLOTS + d.PLACES and set(held) <= set(range(d.WINDOW + 1))
    plan = d.find_passages(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_dropping_and_empty_tables(spark, tables):
    docs, benchmark, texts, items = tables
    kept = d.without_contaminated(docs, benchmark)
    clean = []
    for i, text in enumerate(texts, 1):
        n, hit, _ = brute_force(text, items)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    assert sorted(r.doc_id for r in kept.collect()) == clean and kept.columns == docs.columns
    assert d.find_passages(docs.limit(0), benchmark).count() == 0
    assert d.without_contaminated(docs, benchmark.limit(0)).count() == len(texts)
