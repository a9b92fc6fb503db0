"""Queries of the operators in this subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table

N_SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(read_table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False).drop("kept").withColumnRenamed("id", "doc_id")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosenpath import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2).withColumnRenamed("id", "doc_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0)).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id"), 4, 2))
    model = quality.train(docs.join(labels, "doc_id"))
    return quality.predict(docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model).drop("text")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embdedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def bpe_files() -> dict[str, str]:
    """Where the public vocabulary file is; a parameter of the operators, never copied here."""
    import public_tokenizers as P

    return {"json_path": P.path("byte_bpe_50k.json")}


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    cut = packing.pieces(read_table(spark, sf_dir, "documents"), bpe_files(), max_loss=packing.MAX_LOSS_TOKENS)
    out = packing.pack(cut, max_loss=packing.MAX_LOSS_TOKENS)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("loss").alias("loss_tokens"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .pieces import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model")).drop("ids").withColumnRenamed("id", "doc_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edits

    return compare_with_edits(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: DuckDB has no crc32: the table is made from the reflected polynomial 0xEDB88320 (fixed value), the checksum folds over the bytes.
_CRC_SQL = """
  rounds(i, k, c) AS (
    SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM rounds WHERE k < 8
  ),
  crc_table AS (SELECT list(c ORDER BY i) AS tbl FROM rounds WHERE k = 8)"""

OP1_SQL = f"""
WITH RECURSIVE {_CRC_SQL},
  texts AS (
    SELECT doc_id, text, hex(encode(text)) AS h, coalesce(octet_length(encode(text)), 0) + 1 AS size FROM documents
  ),
  summed AS (
    SELECT doc_id, size::BIGINT AS size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda j: ('0x' || substr(h, (2 * j + 1)::BIGINT, 2))::BIGINT)),
          lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM texts, crc_table
  ),
  cut AS (
    SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(size) OVER () AS total
    FROM summed
  ),
  placed AS (SELECT *, (((2 * before + size) * {N_SHARDS}) // (2 * total))::INTEGER AS shard FROM cut)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL}
