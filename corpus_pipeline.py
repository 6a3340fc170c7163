"""A pipeline over documents: toxicity, line dedup, near-dedup, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Every stage takes texts of any length whole, rows with nulls in any column, an empty table (which stays empty) and extra
columns of any name, which are carried (by the last stage dropped). What else it does with null, empty, tied and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.llm import line_dedup as lines
from sparkledger.llm import mixing, pieces, simhash_dedup, toxicity
from sparkledger.llm.util import columns, modest, scratch, unused

#: Documents of this score or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the limit; the model is fitted on labelled rows of all documents.

    A null or empty text has the base score and stays unless most labels are toxic; repeated rows have equal scores and stay or go together.
    """
    modest(spark)
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(every, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = unused("score", docs.columns)
    return toxicity.toxicity(docs, model, score).where(F.col(score) < TOXIC).select(*columns(docs.columns))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on too many of their source's documents; n_chars follows the text.

    A null text stays null and an empty one empty. A null source is a source of its own. Repeated rows and exact copies are separate documents in the
    counts; but a document that would lose all its lines keeps those that are not boilerplate where exact copies count once.
    """
    out = lines.line_dedup(docs, F.col("source"), F.split("text", "\\n"), spare_copies=True)
    text = F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")).otherwise(F.col("row.text"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.withColumn("text", text).select(*others, "text", chars).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    The smallest doc_id stays, null ids last. Null, empty and blank texts are copies of each other; texts under five words are one shingle; of repeated rows one stays.
    """
    return simhash_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document stands in it as often as it is taken.

    Null and blank texts have no words and are never taken; a null source is the last source; rows of equal id and length in a source are taken or left together.
    """
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of pieces, piece ids and whether they decode to the text (a text that holds the word marker itself does not).

    A null text is encoded as an empty one, with no pieces; repeated rows are encoded alike.
    """
    modest(spark)
    out = pieces.encode(docs.select("doc_id", "source", "text"), check=True)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The toxicity model, the fingerprints and the pieces have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
