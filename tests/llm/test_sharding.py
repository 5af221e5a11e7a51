import hashlib

import pytest
from pyspark.sql import functions as F

from billweave.llm import sharding
from helpers import LONG, documents, rng


def extendible(rows, limit):
    """rows: (bits, bytes). Splits buckets one bit at a time; bits -> prefix."""
    todo, out = [("", rows)], {}
    while todo:
        prefix, held = todo.pop()
        if sum(b for _, b in held) <= limit or len(held) == 1:
            out |= {bits: prefix for bits, _ in held}
        else:
            for bit in "01":
                part = [r for r in held if r[0].startswith(prefix + bit)]
                if part:
                    todo.append((prefix + bit, part))
    return out


def bits(key):
    return f"{int(hashlib.md5(str(key).encode()).hexdigest(), 16):0128b}"


@pytest.mark.parametrize("limit", [10_000_000, 3000, 50])
def test_like_splitting_one_bit_at_a_time(spark, limit):
    r = rng()
    texts = ["x" * r.randrange(200) for _ in range(300)] + [LONG, "é" * 70, ""]
    docs = documents(spark, texts).withColumns({"shard": F.lit("mine"), "bytes": F.lit("b")})
    got = sharding.assign(docs, limit).collect()
    expected = extendible([(bits(i), len(t.encode())) for i, t in enumerate(texts, 1)], limit)
    assert {g.key: g.shard for g in got} == {i: expected[bits(i)] for i in range(1, len(texts) + 1)}
    sums = {}
    for g in got:
        sums[g.shard] = sums.get(g.shard, 0) + g.bytes
    assert all(g.shard_bytes == sums[g.shard] and g.depth == len(g.shard) for g in got)
    assert all(g.fits == (g.shard_bytes <= limit) and (g.fits or g.shard_rows == 1) for g in got)


def test_hot_keys_and_repeated_rows_split_too(spark):
    texts = ["a" * 100] * 60 + [f"b{i}" * 30 for i in range(60)] + [None] * 5
    got = sharding.assign(documents(spark, texts, ids=[7] * 120 + [None] * 5), 500).collect()
    assert len(got) == 125 and all(g.fits and g.shard_bytes <= 500 for g in got)
    assert len({g.shard for g in got}) > 20


def test_files_and_empty_table(spark, tmp_path):
    docs = documents(spark, [f"text {i} " * 20 for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(1, 51))
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(sizes) > 2 and max(s.n for s in sizes) <= 2000
    assert sharding.assign(documents(spark, []), 10).count() == 0


def test_no_row_is_lost_whatever_the_plan(spark, tmp_path):
    docs = (spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                       F.repeat(F.lit("wide "), 50).alias("shard"), F.lit(1).alias("row_number"))
            .repartition("doc_id"))
    sharding.write_shards(docs, str(tmp_path / "out"), 5000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == back.select("doc_id").distinct().count() == 20_000
    assert set(back.columns) == {"doc_id", "text", "shard", "row_number", "_shard"}
    assert back.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 5000").count() == 0
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 10)
