"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of docs, extra ones of any name included
(columns that differ in case only are not told apart), and all rows they do not reject, repeated rows too
where nothing else is said. An empty table gives an empty result in every stage; texts of any length are read
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import exact, language, mixing, pieces, simhash
from seqloom.llm.common import materialise, table
from seqloom.shipping import shipped


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified. Null and empty texts and those without letters are rejected;
    null labels teach nothing, a null source is a host of its own; equal texts of one source are judged alike."""
    return language.keep_identified(docs)


@shipped
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id. A null text counts as empty, a null id as smaller than
    any; of rows that repeat id and text, one stays."""
    return exact.drop_duplicates(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (Jaccard similarity of distinct five-word shingles 0.8 or more), the document with the smallest id.
    Documents without words, null texts too, all stay; null ids come last; of rows that repeat id and text, one stays."""
    return simhash.drop_near_duplicates(docs)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, 0 to 3 times. A null text has size 0, a
    null source is a source of its own; rows of one source that repeat an id are taken together."""
    return mixing.mixed(docs)


@shipped
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and the piece ids of each row; a null or empty text has none."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Fingerprints, Viterbi paths and a fitted classifier are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
