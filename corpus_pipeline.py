"""Pipeline over `documents`: stages that each take all rows that the one before kept.

1. toxicity: rows whose text scores 0.5 or more go.
2. similar: of each group of documents with similar word shingles (and of equal ones) one stays.
3. contaminated: rows that hold passages of benchmark items, by the rule of the operator, go.
4. secrets: spans that look like secrets are masked in the text; all rows stay.
5. tokens: every text is encoded.

Stages one to four return the columns they were given. Null and empty texts go through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import bpe, decontaminate, jaccard_join, queries, secret_scan, toxicity
from billweave.llm.rows import fresh, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, queries.toxicity_model(docs, labels))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = fresh(docs, "secrets")
    masked = secret_scan.redact(secret_scan.scan(docs, spans=spans), spans=spans)
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, bpe.Tokenizer(queries.TOKENIZER))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("toxicity", drop_toxic), ("similar", keep_one_of_each_group),
          ("contaminated", drop_contaminated), ("secrets", mask_secrets), ("tokens", encode_texts)]

#: Scores of a fitted model and tokens of a vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
