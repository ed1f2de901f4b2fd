"""Document chunks, embeddings and the vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.binding import let
from tallyweave.functions.numbers import l2_normalize
from tallyweave.functions.text import WS, strip


def chunk_texts(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Chunks of a text as an array: sentences packed greedily, with a tail overlap.

    A sentence longer than `size` stays whole.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("current")
    )

    def opened(done: Column, sentence: Column) -> Column:
        """The next chunk: the tail of the last one, if there is any, and the sentence."""
        head = F.concat(sentence, F.lit(" "))
        if overlap <= 0:
            return head
        tail = F.right(F.element_at(done, -1), F.lit(overlap))
        return F.when(F.size(done) > 0, F.concat(tail, F.lit(" "), head)).otherwise(head)

    def add(acc: Column, sentence: Column) -> Column:
        fits = F.length(acc["current"]) + F.length(sentence) <= size
        grown = F.struct(
            acc["done"].alias("done"),
            F.concat(acc["current"], sentence, F.lit(" ")).alias("current"),
        )
        closed = F.when(
            acc["current"] != "", F.concat(acc["done"], F.array(strip(acc["current"])))
        ).otherwise(acc["done"])
        turned = let(
            closed,
            lambda done: F.struct(done.alias("done"), opened(done, sentence).alias("current")),
        )
        return F.when(fits, grown).otherwise(turned)

    def finish(acc: Column) -> Column:
        return let(
            strip(acc["current"]),
            lambda rest: F.when(
                rest != "", F.concat(acc["done"], F.array(rest))
            ).otherwise(acc["done"]),
        )

    def pack(body: Column) -> Column:
        sentences = F.filter(
            F.transform(F.split(body, rf"(?<=[.!?]){WS}+"), strip), lambda s: s != ""
        )
        packed = F.aggregate(sentences, start, add, finish)
        return (
            F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>"))
            .when(F.length(body) <= size, F.array(body))
            .otherwise(packed)
        )

    return let(strip(text), pack)


def chunk_documents(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks per page, numbered from 0 on each page. No shuffle."""
    return pages.select(
        "doc_id",
        F.col("id").alias("page_id"),
        "page_no",
        "page_type",
        F.posexplode_outer(chunk_texts(F.col("text"), size, overlap)).alias(
            "chunk_index", "chunk_text"
        ),
    ).filter(F.col("chunk_text").isNotNull()).withColumn("chunk_size", F.length("chunk_text"))


Embedder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    text_col: str,
    make_embedder: Callable[[], Embedder],
    dimension: int,
    out: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """Unit-length vectors of a text column; empty text gives the zero vector.

    `make_embedder` runs once per task, so a model is loaded once.
    """

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = np.zeros((len(texts), dimension), dtype=np.float32)
            filled = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(filled), batch_size):
                chosen = filled[at : at + batch_size]
                rows[chosen] = embedder([texts[i] for i in chosen])
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, norms, out=rows, where=norms > 0)
            yield pd.Series(list(rows))

    return df.withColumn(out, vectors(F.col(text_col)))


def vector_table(vectors: DataFrame, index_name: str) -> DataFrame:
    """Rows of a vector index: unit-length vectors under an index name."""
    return vectors.select(
        F.lit(index_name).alias("index_name"),
        "id",
        l2_normalize(F.col("embedding")).alias("embedding"),
    )


def new_vectors(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """Vectors whose id the index does not hold yet, ready to be appended."""
    return vectors.join(index.select("id"), "id", "left_anti")
