"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark windows go, sources
are mixed to their target weights in curriculum order, and the mixture is tokenised into training order.

Every stage takes any columns beside doc_id, text and source, under any names, and returns them. A null or empty text is
not toxic, a duplicate of nothing and free of benchmark windows; it has no words, so the mixture leaves it out. Null ids
stay (of a class of near copies, an id before none). Null sources are a source of their own. Repeated rows are copies:
the second stage keeps one. Texts of any length go through whole, ties are broken by content, and empty tables give empty
results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.llm import classifiers, decontaminate, mixing, near_documents, queries, tokens
from sgspark.llm.runtime import Guarded, dropped, written

#: Probability from which a document is rejected as toxic.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is below TOXIC; the model learns from the labelled rows of op1's folds."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    own = Guarded(docs)
    scored = classifiers.toxicity_scored(own.rows, model, queries.TOXICITY_BITS, text=own["text"])
    return own.restored(scored.where(F.col("score") < TOXIC))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the smallest doc_id's."""
    return near_documents.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark window occurs."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, a row for each copy taken, by training position."""
    return mixing.materialised(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length token sequences in training order, read from the shards."""
    return tokens.stored(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: A trained classifier and a tokeniser can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir), "stage")
        dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
