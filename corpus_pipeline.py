"""Documents to token ids: quality rules, line dedup, near dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever other columns and names of columns there are. An empty table passes through as an empty table. Each
stage says what becomes of nulls, empty and very long texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikelake.llm import bpe, lines, mixing, near, quality
from spikelake.llm.common import cut, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the thresholds of their language and source.

    Null and empty texts have no words and go. A null language or source is one of its own. Very long texts are read
    whole; values equal to a threshold pass; repeated rows are judged each, and alike.
    """
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand on many sources, each of which stays once.

    A null text stays null, an empty one empty; a null source is one of its own. A line stays where it is first, by id (null
    first) and place; rows that agree in both keep it each. Very long texts take time in proportion; n_chars follows.
    """
    return lines.clean(docs, chars="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest id stays, null after all others; ties go by the text's hash, then by all columns, so one of repeated rows
    stays. Texts without words, null ones too, are in no group and all stay. Very long texts are compared whole.
    """
    return near.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; the last of a source may be taken in part.

    Texts without words, null ones too, have no size and aren't taken. A null source is one of its own, the last. Equal rows
    are taken one after the other; what one gets is fixed by its columns. Very long texts are many blocks; of a text taken in
    part the first words stand with single spaces between them, and n_chars follows.
    """
    return mixing.mixed(docs, chars="n_chars")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and the hash of the bytes that they decode to.

    A null text has no ids, like an empty one. Very long texts are encoded in parts; each of repeated rows gives its own row.
    """
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text")).drop("text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Thresholds from sketches and similarity groups can't be told in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
