"""The registered queries of this subpackage: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.llm import bpe, jaccard, langid, licenses, lines, lm, mixing, neighbours, quality, search, sharding, substrings, whitening

VOCABULARY_FILE = "byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    """The public vocabulary; ``path`` names another file of the same form."""
    import public_tokenizers

    return bpe.Vocabulary(path or public_tokenizers.path(VOCABULARY_FILE), public_tokenizers.PATTERN)


def token_digests(docs: DataFrame, vocab: bpe.Vocabulary, keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and digest both."""
    ids = bpe.encode(docs, vocab)
    named = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    keep = ("doc_id", "n_tokens", "ids_sha256", *(["ids"] if keep_ids else []))
    if keep_ids:
        named = named.withColumn("again", F.col("ids"))
    back = bpe.decode(named, vocab, "again" if keep_ids else "ids", keep)
    return back.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes they decode to."""
    return token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document by its id."""
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior quality of every document."""
    return quality.score(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detected licenses of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document lie in repeated windows, and the digest of the others."""
    left = substrings.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and so how many words of, each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every document go because other documents share them, and the digest of the others."""
    left = lines.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {"op1_bpe": op1_bpe, "op2_sharding": op2_sharding, "op3_quality": op3_quality,
               "op4_neighbours": op4_neighbours, "op5_licenses": op5_licenses, "op6_substrings": op6_substrings,
               "op7_langid": op7_langid, "op8_jaccard": op8_jaccard, "op9_lm": op9_lm, "op10_mixing": op10_mixing,
               "op11_lines": op11_lines, "op12_whitening": op12_whitening, "op13_search": op13_search}

#: The table is filled turn by turn: one recursion step for each turn of a shard, its first free slot by a scan of its order.
OP2_SQL = """
WITH RECURSIVE size AS (SELECT 6553 AS m, 64 AS n),
number AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard,
         ('0x' || substr(md5('offset shard-' || lpad(i::VARCHAR, 3, '0')), 1, 8))::BIGINT % m AS first,
         ('0x' || substr(md5('skip shard-' || lpad(i::VARCHAR, 3, '0')), 1, 8))::BIGINT % (m - 1) + 1 AS skip
  FROM size, range(0, n) AS r(i)),
fixed AS (SELECT list(first ORDER BY i) AS firsts, list(skip ORDER BY i) AS skips FROM number),
turns AS (
  SELECT 0 AS turn, list_transform(range(0, m), lambda x: -1) AS taken, list_transform(range(0, n), lambda x: 0) AS ahead
  FROM size
  UNION ALL
  SELECT turn + 1,
         list_transform(taken, lambda x, k: CASE WHEN k - 1 = (firsts[s + 1] + j * skips[s + 1]) % m THEN s ELSE x END),
         list_transform(ahead, lambda x, k: CASE WHEN k - 1 = s THEN j + 1 ELSE x END)
  FROM (
    SELECT turn, taken, ahead, turn % n AS s, m, n, firsts, skips,
           list_filter(range(ahead[turn % n + 1], m),
                       lambda j: taken[(firsts[turn % n + 1] + j * skips[turn % n + 1]) % m + 1] < 0)[1] AS j
    FROM turns, fixed, size WHERE turn < m)),
owner AS (SELECT unnest(taken) AS i, generate_subscripts(taken, 1) - 1 AS slot FROM turns, size WHERE turn = m),
placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % m AS slot
  FROM documents, size)
SELECT doc_id, slot::INTEGER AS slot, shard FROM placed JOIN owner USING (slot) JOIN number USING (i)
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = " || ".join(f"chr({code})" for code in (32, 9, 10, 11, 12, 13))
_PLACE = "struct_pack(known := doc_id IS NOT NULL, id := coalesce(doc_id, 0))"

OP11_SQL = f"""
WITH line AS (
  SELECT doc_id, row, place, line, translate(trim(line, {_BLANKS}), {_AZ}) AS key
  FROM (SELECT doc_id, row, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT key, max({_PLACE}) AS last FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT {_PLACE}) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT line.*, coalesce({_PLACE} < shared.last, false) AS gone FROM line LEFT JOIN shared USING (key))
GROUP BY doc_id, row
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP13_SQL = f"""
WITH term AS (
  SELECT doc_id, row, term, count(*) AS tf
  FROM (SELECT doc_id, row, unnest(regexp_extract_all(translate(text, {_AZ}), {_TERM})) AS term
        FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents))
  GROUP BY ALL),
doc AS (SELECT doc_id, row, CAST(sum(tf) AS BIGINT) AS terms FROM term GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(terms) AS BIGINT) AS words FROM doc),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM term, total GROUP BY term),
item AS (
  SELECT item_id, item, term, count(*) AS times
  FROM (SELECT item_id, item, unnest(regexp_extract_all(translate(text, {_AZ}), {_TERM})) AS term
        FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark))
  GROUP BY ALL),
scored AS (
  SELECT item_id, item, doc_id, row,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * terms * docs) // words))))) AS BIGINT) AS score
  FROM item JOIN term USING (term) JOIN weight USING (term) JOIN doc USING (row, doc_id), total
  GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

LLM_ORACLE_SQL = {"op2_sharding": OP2_SQL, "op11_lines": OP11_SQL, "op13_search": OP13_SQL}
