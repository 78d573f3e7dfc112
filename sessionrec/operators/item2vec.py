"""Item vectors from sessions read as sentences of items."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.functions.order import item_lists

# Spark ML reads longer sentences in pieces of this length; so do we, which keeps
# the list of a very long session bounded without changing the model.
SENTENCE_LENGTH = 1000


def item_sentences(events: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Sentences of item tokens, oldest event first: session, part, sentence."""
    lists = item_lists(events, SENTENCE_LENGTH, hot)
    return lists.select("session", "part", F.col("aids").cast("array<string>").alias("sentence"))


def fit_item2vec(
    sentences: DataFrame,
    vector_size: int = 32,
    iterations: int = 10,
    learning_rate: float = 0.01,
    window: int = 5,
    min_count: int = 1,
    seed: int = 77,
    partitions: int | None = None,
) -> Word2VecModel:
    """Skip-gram vectors (hierarchical softmax).

    Every shard of the sentences is trained by its own task and the vectors are merged
    after each iteration; by default there is a shard per core. A task keeps catalogue
    x vector size floats, which follows the catalogue, not the log.
    """
    shards = partitions or sentences.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(
        vectorSize=vector_size,
        maxIter=iterations,
        stepSize=learning_rate,
        windowSize=window,
        minCount=min_count,
        maxSentenceLength=SENTENCE_LENGTH,
        numPartitions=shards,
        seed=seed,
        inputCol="sentence",
        outputCol="vec",
    ).fit(sentences)


def item2vec_vectors(model: Word2VecModel) -> DataFrame:
    """aid, vec."""
    return model.getVectors().select(
        F.col("word").cast("int").alias("aid"), vector_to_array("vector").alias("vec")
    )
