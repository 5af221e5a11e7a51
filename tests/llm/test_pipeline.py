import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from billweave.llm import queries
from helpers import documents

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", queries.ORACLE)
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS FROM '{SF_DIR}/{table}.parquet'")
    df, expected = queries.QUERIES[name](spark, SF_DIR), duck.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert (sorted(repr(tuple(r)) for r in df.select(*columns).collect())
            == sorted(repr(r) for r in expected.select(*columns).fetchall()))


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_take_effect(spark, tmp_path):
    passage = " ".join(f"benchmark{i}" for i in range(30))
    clean = [f"{i} " + " ".join(f"w{i * 60 + k}" for k in range(60)) for i in range(60)]
    bad = [f"bad{i} " + " ".join(f"v{i * 20 + k}" for k in range(20)) + " idiot moron idiot stupid moron idiot" for i in range(40)]
    special = {
        200: "copy " + clean[3], 201: passage + " tail", 202: "user token = abcdefabcdef12 kept", 203: None, 204: "",
        205: clean[5], 206: "bad idiot moron stupid idiot moron new words"}
    texts, ids = [*clean, *bad, *special.values()], [*range(1, 101), *special]
    docs = documents(spark, texts, ids).withColumn("extra", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i > 60)) for i in range(1, 101)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept[name] = {r.doc_id: r for r in at.collect()}
        if name != "tokens":
            assert at.columns == docs.columns
    everyone = set(ids)
    assert everyone - set(kept["toxicity"]) == {*range(61, 101), 206}
    assert set(kept["toxicity"]) - set(kept["similar"]) == {200, 205}
    assert set(kept["similar"]) - set(kept["contaminated"]) == {201}
    assert set(kept["secrets"]) == set(kept["contaminated"]) == set(kept["tokens"])
    assert kept["secrets"][202].text == "user [SECRET] kept" and kept["secrets"][203].text is None
    assert kept["secrets"][202].n_chars == len("user [SECRET] kept")
    assert kept["tokens"][203].n_tokens == 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in run.collect()} == {i: r.ids_sha256 for i, r in kept["tokens"].items()}
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert kept["tokens"][202].n_tokens == len(theirs.encode("user [SECRET] kept", add_special_tokens=False).ids)


def test_stages_on_no_rows(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
