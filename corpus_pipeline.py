"""A corpus pipeline of five stages over ``documents``.

Language ID, quality classifier, near-duplicates, repeated passages, packing.
Each stage works on all that its predecessor kept; its result is written as
Parquet to the shared folder and read again, so a lost executor costs at most
a part of one stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm import chosenpath, langid, packing, quality, suffix
from quietframe.llm.common import held_out, read_table, staged
from quietframe.llm.queries import bpe_files

#: Below this a language is not credible: no letters, or almost none of the text's n-grams belong to any language.
MIN_LANGUAGE_SCORE = 0.05
QUALITY_THRESHOLD = 0.7
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a credible language go: null, empty and letterless texts among them.

    Learned from the labels that are not null, outside the held-out fold.
    Equal texts share their fate, repeated ids too; columns other than
    ``COLUMNS`` are left behind whatever their names; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return langid.predict(docs, model).where(langid.accepted(MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go.

    Learned from the labelled rows outside the held-out fold; a repeated id
    counts once a row.  Equal texts share their fate.  Without labels every
    score is the even prior, and all documents stay only if that passes.
    """
    docs = docs.select(*COLUMNS)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id"), 4, 2))
    model = quality.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    return quality.predict(docs, model, threshold=QUALITY_THRESHOLD).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays.

    Texts without words are in no group; rows that repeat an id share its fate;
    a null id is a group of its own.
    """
    docs = docs.select(*COLUMNS)
    found = chosenpath.near_duplicates(docs, words=SHINGLE_WORDS, threshold_percent=SIMILARITY_PERCENT)
    gone = found.where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of smaller id are cut out; documents of which nothing is left go.

    Empty and null texts go as well.  A cut may split a character: what is left
    of it goes.  Rows that repeat an id do not cut each other.
    """
    docs = docs.select(*COLUMNS)
    cut = suffix.remove_repeats(docs, carry=("lang", "source"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A cut may split a character: the bytes that are left of it are no text.
            texts = [b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], ["doc_id", "text", "lang", "source"])

    left = cut.where("n_removed < n_bytes").select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source")
    texts = left.mapInArrow(decoded, "doc_id long, text string, lang string, source string")
    return texts.withColumn("n_chars", F.length("text").cast("long")).where("n_chars > 0").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, placed in sequences; an empty text is its end token."""
    most = packing.MAX_LOSS_TOKENS
    packed = packing.pack(packing.pieces(docs, bpe_files(), max_loss=most), max_loss=most)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Learned models, set similarity and byte-level tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
