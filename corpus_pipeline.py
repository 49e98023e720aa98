"""A corpus from raw documents to token ids, in five stages.

Each stage takes the documents its predecessor kept and returns documents; the last
one returns their encoding. ``run`` writes every stage's result below the shared
folder and reads it again, so a lost executor costs no earlier stage.

Defined cases, for every stage: a null text counts as the empty one (it is not toxic, holds no benchmark
passage and no secret, and is encoded as the end id alone), and stays null where it is kept; all empty and null texts are
one class of copies; rows that repeat an id and a text are judged alike; of copies under one id one row stays; ids may be
null; empty tables give empty results; documents may carry further columns of any name, which all
stages but the last hand on untouched, and need no ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import common, minhash, queries, secrets, sentencepieces, toxicity, winnow
from trapline.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a lexicon learned from the labels of those given."""
    lexicon = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name("toxicity", docs.columns)
    scored = toxicity.score(docs, lexicon, score_col=name)
    return scored.where(F.col(f"`{name}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return winnow.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked and ``n_chars``, where there is one, counted anew."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    encoded = sentencepieces.encoded_digests(docs, queries.tokenizer_path(queries.PIECES), keep=KEPT_STRETCHES)
    return encoded.withColumnRenamed("id", "doc_id")


#: Workers hold the lexicon's sums beside the stretches.
KEPT_STRETCHES = 100_000

STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: SQL can express neither the learned lexicon nor the classes; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
