"""Queries of the operators over the sample tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm import (bpe, decontaminate, hash_forest, jaccard_join, ppm, quotes,
                           secret_scan, sharding, spelling, substring_dedup, token_alignment,
                           toxicity, url_filter)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ALIGNED = token_alignment.Files(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                public_tokenizers.path("piece_bpe_32k.model"))
SHARD_BYTES = 1_000_000
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.Tokenizer(TOKENIZER)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(texts, tokenizer).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"))
    return bpe.decode(coded, tokenizer).select(
        "doc_id", "n_tokens", "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [url_filter.Rule(*r) for r in URL_RULES]
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return dealt.select(F.col("key").alias("doc_id"), F.col("bytes").alias("n_bytes"), "shard", "depth",
                        "shard_bytes", F.col("shard_rows").alias("shard_docs"), "fits")


def op5_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "text", "reply_to", F.array_join("path", ".").alias("path"), "thread",
        "depth", "chat")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s.kind.isin(*kinds))

    base = of(*secret_scan.BASE)
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}")
                                    for k in secret_scan.BASE],
                        F.sha2(secret_scan.spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("secrets")).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(texts, table(spark, sf_dir, "benchmark"))
    n_hit, items = decontaminate.hit_words(F.col("hits")), decontaminate.hit_items(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def fold(doc_id: str, parts: int = 5) -> Column:
    """The CRC-32 of the id as text, by its remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Labels of the fold that is held out are never read."""
    return toxicity.fit(docs, labels.where(fold("doc_id") != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(texts, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(texts, model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           held_out=fold("doc_id") == 1)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("group").alias("component_id"))


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                               is_query=F.col("vec_id") % 20 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(texts, read=spelling.with_slips))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(texts, ALIGNED).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", substring_dedup.removed_words(F.col("removed")).alias("n_removed"),
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_bpe": op1_bpe, "op2_url_rules": op2_url_rules, "op3_ppm": op3_ppm,
           "op4_shards": op4_shards, "op5_reply_order": op5_reply_order, "op6_secrets": op6_secrets,
           "op7_decontaminate": op7_decontaminate, "op8_toxicity": op8_toxicity,
           "op9_jaccard": op9_jaccard, "op10_forest": op10_forest,
           "op11_spelling": op11_spelling, "op12_alignment": op12_alignment,
           "op13_substrings": op13_substrings}

_RULE_ROWS = ", ".join(f"('{v}', '{t}')" for v, t in URL_RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = "trim(regexp_replace(" + _LOWER + r", '\s+', ' ', 'g'))"
_SHINGLED = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+')"
_SENTENCES = r"flatten(list_transform({}, lambda s: string_split(regexp_replace(s, '([.!?…]) ', '\1' || chr(1), 'g'), chr(1))))"
_UNCHANGED = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_url_rules": f"""
WITH rules AS (
  SELECT verdict, text, regexp_extract(text, '^[^/]*') AS host, regexp_extract(text, '/.*$') AS path
  FROM (VALUES {_RULE_ROWS}) t(verdict, text)),
rests AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
urls AS (
  SELECT row, page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rests),
fits AS (
  SELECT u.row, r.text, r.verdict,
         row_number() OVER (PARTITION BY u.row ORDER BY length(r.text) DESC) AS rank
  FROM urls u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.text AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.row = u.row AND f.rank = 1""",
    "op4_shards": f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(strlen(text), 0) AS n_bytes,
         format('{{:032b}}', ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT) AS bits
  FROM documents),
prefixes AS (SELECT row, depth, substr(bits, 1, depth) AS shard, n_bytes
             FROM docs, range(0, 33) t(depth)),
buckets AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
            FROM prefixes GROUP BY ALL),
first AS (
  SELECT row, min(depth) AS depth FROM prefixes JOIN buckets USING (depth, shard)
  WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1 GROUP BY row)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, b.shard, f.depth::INT AS depth, shard_bytes, shard_docs,
       shard_bytes <= {SHARD_BYTES} AS fits
FROM docs d JOIN first f USING (row)
JOIN buckets b ON b.depth = f.depth AND b.shard = substr(d.bits, 1, f.depth)""",
    "op5_reply_order": rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, conv_id, turn, role, text FROM conversations),
cut AS (SELECT row, string_split(text, chr(10)) AS lines FROM m WHERE text IS NOT NULL),
l AS (
  SELECT row, pos, lines[pos] AS line, regexp_matches(lines[pos], '{quotes.QUOTED}') AS quoted,
         regexp_matches(lines[pos], '{quotes.ATTRIBUTION}')
           AND coalesce(regexp_matches(lines[pos + 1], '{quotes.QUOTED}'), false) AS announces
  FROM (SELECT row, lines, unnest(range(1, len(lines) + 1)) AS pos FROM cut)),
own AS (SELECT row, bool_or(quoted) AS has_quote,
               string_agg(line, chr(10) ORDER BY pos) FILTER (NOT quoted AND NOT announces) AS own
        FROM l GROUP BY row),
body AS (SELECT m.*, CASE WHEN has_quote THEN trim(coalesce(own, '')) ELSE text END AS body
         FROM m LEFT JOIN own USING (row)),
placed AS (FROM body WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
q AS (
  SELECT row, conv_id, turn, pos,
         length(regexp_replace(regexp_extract(line, '{quotes.MARKS}', 1), '[ 	]', '', 'g')) AS level,
         {_NORMAL.format(f"regexp_replace(line, '{quotes.MARKS}', '')")} AS said
  FROM l JOIN placed USING (row) WHERE quoted),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY row, level ORDER BY pos) AS run FROM q),
passages AS (
  SELECT row, conv_id, turn, level, lines,
         list_transform(regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+'), lambda p: {_NORMAL.format("p")}) AS paragraphs
  FROM (SELECT row, conv_id, turn, level, list(said ORDER BY pos) AS lines FROM runs
        GROUP BY row, conv_id, turn, level, run)),
asked AS (
  SELECT DISTINCT * FROM (
    SELECT row, conv_id, turn, level, true AS whole,
           unnest(list_append(paragraphs, {_NORMAL.format("array_to_string(lines, ' ')")})) AS said FROM passages
    UNION ALL
    SELECT row, conv_id, turn, level, false, unnest(list_concat(lines, {_SENTENCES.format("paragraphs")})) FROM passages)
  WHERE said <> '' AND (whole OR len(string_split(said, ' ')) >= {quotes.LEAST_WORDS})),
told AS (
  SELECT DISTINCT conv_id, turn, {_NORMAL.format("unit")} AS said
  FROM (SELECT conv_id, turn, unnest(list_concat([body], paragraphs, string_split(body, chr(10)),
                 {_SENTENCES.format(f"list_transform(paragraphs, lambda p: {_NORMAL.format('p')})")})) AS unit
        FROM (SELECT *, regexp_split_to_array(body, '\n\s*\n') AS paragraphs FROM placed))),
met AS (
  SELECT a.row, a.level, a.whole, a.said, max(t.turn) AS reply_to
  FROM asked a JOIN told t ON a.conv_id = t.conv_id AND a.said = t.said AND t.turn < a.turn GROUP BY ALL),
votes AS (SELECT row, reply_to, min(level) AS level, bool_or(whole) AS whole, count(*) AS n
          FROM met GROUP BY row, reply_to),
links AS (SELECT row, reply_to FROM votes
          QUALIFY row_number() OVER (PARTITION BY row ORDER BY level, whole DESC, n DESC, reply_to DESC) = 1),
ups AS (SELECT conv_id, turn, max(reply_to) AS up FROM links JOIN m USING (row) GROUP BY conv_id, turn),
paths AS (
  SELECT conv_id, turn, up, [up, turn] AS path FROM ups
  UNION ALL SELECT p.conv_id, p.turn, u.up, list_prepend(u.up, p.path)
  FROM paths p JOIN ups u ON u.conv_id = p.conv_id AND u.turn = p.up),
longest AS (SELECT conv_id, turn, arg_max(path, len(path)) AS path FROM paths GROUP BY conv_id, turn),
done AS (
  SELECT b.conv_id, b.turn, b.role, b.body AS text, k.reply_to,
         CASE WHEN b.conv_id IS NULL OR b.turn IS NULL THEN NULL WHEN k.reply_to IS NULL THEN [b.turn]
              ELSE coalesce(g.path, [b.turn]) END AS path
  FROM body b LEFT JOIN links k USING (row)
    LEFT JOIN longest g ON g.conv_id = b.conv_id AND g.turn = b.turn)
SELECT conv_id, turn, role, text, reply_to, array_to_string(path, '.') AS path, path[1] AS thread,
       CAST(len(path) - 1 AS INTEGER) AS depth,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') AS chat
FROM done""",
    "op9_jaccard": rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_SHINGLED}, []) AS w FROM documents),
sets AS (
  SELECT DISTINCT row, array_to_string(w[p:p + 4], ' ') AS shingle
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT row, count(*) AS n FROM sets GROUP BY row),
common AS (SELECT a.row AS x, b.row AS y, count(*) AS c
           FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.row <> b.row GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.row = x JOIN sizes t ON t.row = y
  WHERE 100 * c >= 75 * (s.n + t.n - c)),
reached AS (
  SELECT row, row AS start FROM docs
  UNION SELECT y, start FROM reached JOIN links ON x = row),
groups AS (SELECT r.row, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.row = r.start GROUP BY r.row)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (row) LEFT JOIN groups USING (row)""",
    "op7_decontaminate": f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
         array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
        FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes)),
found AS (SELECT row, size, p, item_id FROM places JOIN windows USING (size, win)),
hits AS (
  SELECT row, count(DISTINCT q) AS n_hit
  FROM (SELECT row, unnest(range(p, p + size)) AS q FROM found) GROUP BY row),
ids AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN ids USING (row)""",
    "op11_spelling": rf"""
WITH RECURSIVE bits AS (
  SELECT n, n::UBIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}::UBIGINT) ELSE c >> 1 END, k + 1
  FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents)
  GROUP BY ALL),
bytes AS (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(
           list_transform(range(0, octet_length(b)), lambda k: ('0x' || substr(hex(b), 2 * k + 1, 2))::UBIGINT),
           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h
  FROM bytes, crc),
slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT)
                             || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest
          FROM (SELECT *, unnest(range(length(word))) AS k FROM words)),
links AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM holes a JOIN holes b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
near AS (SELECT word, count(*) AS n_near FROM links GROUP BY word),
forms AS (
  SELECT word, near AS form, near_n AS form_n FROM links WHERE true
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1 AND near_n >= 5 * n),
steps AS (
  SELECT word, word AS root FROM words
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root)
SELECT w.word, f.form, s.root, w.n, coalesce(r.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN near r USING (word) LEFT JOIN forms f USING (word)
  JOIN (FROM steps ANTI JOIN forms ON forms.word = steps.root) s ON s.word = w.word""",
    "op13_substrings": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_UNCHANGED}, []) AS w FROM documents),
windows AS (
  SELECT row, doc_id, p, array_to_string(w[p:p + 12], ' ') AS win
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT row, unnest(range(p, p + 13)) AS q
  FROM windows JOIN firsts USING (win) WHERE first < doc_id),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM docs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n
         FROM words ANTI JOIN gone USING (row, q) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)""",
}
