"""A training corpus from raw documents: known languages, one document of each near-copy group, no long repeats, mixed sources, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, and other
columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result in every stage. ``run`` writes each
stage's rows to the shared folder and reads them back, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, simhash, suffix_dedup
from millrace.llm.shared import lean, sliced, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A document whose likeliest language is less likely than this is rejected, as are those without letters.
MIN_SCORE = 0.3
#: Bytes of a repeated passage: prose of over 50 words has more, runs of short words may have fewer and stay.
REPEAT_BYTES = 240


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; nothing is learnt from fold 0.

    Rejected are null texts, texts without a letter, and those of which no language has a probability of MIN_SCORE; a table without any ``lang``
    teaches nothing, so all its documents go. Repeated rows are judged alike; whole texts are judged, however long. No other column is looked at, so
    nulls in them change nothing, but a null doc_id or lang teaches nothing.
    """
    judged = langid.identify(docs.select(*COLUMNS), langid.learn(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; rows without a doc_id stay. Rows that share a doc_id stay or go together.

    Texts without words (null, empty, white) are one group. Nulls in other columns change nothing.
    """
    groups = simhash.similar_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct().withColumn("kept_", F.lit(True))
    return docs.select(*COLUMNS).join(kept, "doc_id", "left").where("kept_ or doc_id is null").select(*COLUMNS)


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = []
        for text, spans in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            texts.append(suffix_dedup.kept(text, suffix_dedup.merged(spans)).decode("utf-8", "ignore") if spans else text.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(1), batch.column(2), pa.array([len(t) for t in texts], pa.int64())], COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat anywhere; a character that is cut through goes with them.

    Every row stays; a null text becomes an empty one; ``n_chars`` counts what is left. Repeated rows are each other's repeats, so both lose all that is
    REPEAT_BYTES long; shorter texts lose nothing. Nulls in other columns change nothing.
    """
    marked = suffix_dedup.mark_repeats(docs, ["doc_id", "lang", "source", "n_chars"], length=REPEAT_BYTES, anchor=96)
    return marked.select(F.col("doc_id").cast("long"), "lang", "source", "n_chars", "text_", "spans_").mapInArrow(lean(_without_repeats), SCHEMA)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, a text that is taken in part cut after its last word taken.

    A null source is a source, the last one; documents without words are not taken; repeated rows are documents of their own, and a null doc_id is
    an id like others. ``n_chars`` counts what is taken.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS), mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in a sequence: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is its end mark alone; repeated rows, and rows without a doc_id, are documents of their own; a long text is cut at multiples
    of 2048 tokens.
    """
    return packing.pack_documents(docs, ids=False)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("source_mixing", source_mixing), ("packing", pack)]

#: Forward algorithms, bit votes and column generation are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
