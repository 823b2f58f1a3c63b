"""A corpus pipeline of five stages over documents: (name, function) in STAGES.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Null texts count as empty; extra columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import mixing, pieces, repeats, simhash, toxicity
from tallyforge.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The documents that the mixing stage samples hold this share of its input's words.
MIX_RATE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, predicts clean."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.tag(docs, model, keep=("text", "lang", "source", "n_chars"))
    return found.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest doc_id, then of the least text.

    Groups are of rows: a row without an id is grouped by its fingerprint as any
    other and stays where its group has no row with an id; rows of one doc_id
    with different texts each stay or go with their own group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ids for rows without one, after all others
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 62) + (1 << 61)) + F.shiftrightunsigned(F.xxhash64(text), 4))
    own = docs.select(key.alias("doc_id"), text.alias("text"), F.col("doc_id").cast("long").alias("given"), "lang", "source", "n_chars")
    groups = simhash.near_duplicates(own, keep=("text", "given", "lang", "source", "n_chars"))
    row = F.struct(F.col("_1").isNull().alias("without"), F.col("_1").alias("doc_id"), F.col("_0").alias("text"), F.col("_2").alias("lang"), F.col("_3").alias("source"), F.col("_4").alias("n_chars"))
    return groups.groupBy("component_id").agg(F.min(row).alias("row")).select(*[f"row.{c}" for c in COLUMNS])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus; whole characters only."""
    found = repeats.removals(docs, repeats.BYTES, first_stays=True, text=True, keep=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked source, language and topic weights; a document asked for more than once is repeated."""
    found = mixing.mix(docs, rate=MIX_RATE, keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    again = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select("doc_id", F.col("_0").alias("text"), F.col("_1").alias("lang"), F.col("_2").alias("source"), F.col("_3").alias("n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, a digest of the ids, and the text decoded from them."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"), text=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The field's training and the fingerprint groups have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
