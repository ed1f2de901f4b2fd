"""Keyword search with BM25, exact vector search, rank fusion, rerank and context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.functions.text import expand_query, search_tokens
from tallyweave.operators.grid import block_map
from tallyweave.operators.partitioning import is_small

# Ranking constants of the keyword index.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6

SCORE_DIGITS = 6
QUERY_BLOCK = 200
#: A block of documents is held by one task: at most this many, and about this many characters.
DOCUMENT_BLOCK = 20_000
TEXT_BLOCK = 8_000_000
DENSE_CELLS = 4_000_000


def _terms(df: DataFrame, keep: list[str], tokens: Column, stems: DataFrame | None) -> DataFrame:
    # An outer explode keeps the optimizer from testing the token list for emptiness
    # first, which would split the text twice.
    exploded = df.select(*keep, F.explode_outer(tokens).alias("term")).filter(
        F.col("term").isNotNull()
    )
    if stems is None:
        return exploded
    return exploded.join(stems, "term", "left").select(
        *keep, F.coalesce("stem", "term").alias("term")
    )


def postings(documents: DataFrame, text_col: str = "text", stems: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf) of every document. `stems` maps (term, stem)."""
    occurrences = _terms(documents, ["doc_id"], search_tokens(F.col(text_col)), stems)
    return occurrences.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct search words of a text column."""
    return texts.select(F.explode_outer(search_tokens(F.col(text_col))).alias("term")).filter(
        F.col("term").isNotNull()
    ).distinct()


def term_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _keyword_block(k: int, match_all: bool, schema: pa.Schema):
    """Scores of a block of queries against a block of documents, as matrix products."""

    def compare(queries: pa.Table, documents: pa.Table) -> pa.Table:
        held = documents.column("held").combine_chunks()
        words, parents = pc.list_flatten(held), pc.list_parent_indices(held)
        documents = pa.table({
            "doc_id": documents.column("doc_id").combine_chunks().take(parents),
            "term": pc.struct_field(words, "term"), "weight": pc.struct_field(words, "weight"),
        })
        vocabulary = pc.unique(queries.column("term"))
        at = pc.index_in(documents.column("term"), value_set=vocabulary)
        documents = documents.append_column("at", at).filter(pc.is_valid(at))
        if not queries.num_rows or not documents.num_rows:
            return schema.empty_table()
        query_ids, query_rows = _codes(queries.column("query_id"))
        doc_ids, doc_rows = _codes(documents.column("doc_id"))
        query_terms = pc.index_in(queries.column("term"), value_set=vocabulary).to_numpy()
        asked = np.zeros((len(query_ids), len(vocabulary)))
        asked[query_rows, query_terms] = queries.column("repeats").to_numpy()
        order = np.argsort(doc_rows, kind="stable")
        doc_rows = doc_rows[order]
        doc_terms = documents.column("at").to_numpy()[order]
        weights = documents.column("weight").to_numpy()[order]
        kept: list[list[tuple]] = [[] for _ in query_ids]
        height = max(1, DENSE_CELLS // len(vocabulary))
        for first in range(0, len(doc_ids), height):
            low, high = np.searchsorted(doc_rows, [first, first + height])
            held = np.zeros((min(height, len(doc_ids) - first), len(vocabulary)))
            held[doc_rows[low:high] - first, doc_terms[low:high]] = weights[low:high]
            scores = np.round(asked @ held.T, SCORE_DIGITS)
            matched = (asked > 0).astype(np.float32) @ (held > 0).astype(np.float32).T
            least = (asked > 0).sum(axis=1) if match_all else np.ones(len(query_ids))
            for q in range(len(query_ids)):
                hits = np.flatnonzero(matched[q] >= least[q])
                if len(hits) > k:
                    # Documents are numbered in id order, so a stable sort breaks ties by id.
                    hits = hits[np.argsort(-scores[q, hits], kind="stable")[:k]]
                kept[q] += [(-scores[q, d], doc_ids[first + d]) for d in hits.tolist()]
        rows = [
            (query_ids[q], doc, -score)
            for q, found in enumerate(kept)
            for score, doc in sorted(found)[:k]
        ]
        columns = [list(c) for c in zip(*rows)] if rows else [[], [], []]
        return pa.table(columns, schema=schema)

    return compare


def _codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Distinct values in order and the position of each row's value among them."""
    encoded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    position = np.empty(len(order), dtype=np.int64)
    position[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)).to_pylist(), position[encoded.indices.to_numpy()]


def _documents_per_block(count: int, characters: int) -> int:
    """Documents of a block, so that neither their number nor their texts outgrow a task."""
    return max(1, min(DOCUMENT_BLOCK, count * TEXT_BLOCK // max(1, characters)))


def bm25_topk(
    queries: DataFrame,
    documents: DataFrame,
    k: int = 60,
    mode: str = "any",
    expand: bool = True,
    stems: DataFrame | None = None,
) -> DataFrame:
    """The k best documents (doc_id, text) of every query (query_id, text).

    Occurrences are cut down to the words of the queries first, and one row per
    document is shuffled that lists them. Their weights are worked out where the
    document then lies. Blocks of queries meet blocks of documents, again a row per
    document, and a block only returns its k best rows: a word that most documents
    hold makes no row per query and document. Long documents come in
    smaller blocks, as a task holds the words of a whole block.
    """
    text = expand_query(F.col("text")) if expand else F.col("text")
    wanted = (
        _terms(queries, ["query_id"], search_tokens(text), stems)
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).cast("double").alias("repeats"))
    )
    vocabulary = wanted.select("term").distinct()
    few = is_small(vocabulary)
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    sized = documents.select("doc_id", search_tokens(F.col("text")).alias("_tokens")).withColumn(
        "_length", F.size("_tokens")
    )
    corpus = sized.agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.col("_length").cast("double")).alias("_mean_length")
    )
    listed = (
        _terms(sized, ["doc_id", "_length"], F.col("_tokens"), stems)
        .join(vocabulary, "term", "left_semi")
        .groupBy("doc_id", "_length")
        .agg(F.collect_list("term").alias("_held"))
    )
    counted = (
        listed.select("doc_id", "_length", F.explode("_held").alias("term"))
        .groupBy("doc_id", "_length", "term")
        .agg(F.count(F.lit(1)).alias("_tf"))
    )
    # `corpus` is a single row. Counting over `_tf` keeps both uses of `counted` alike,
    # so that its shuffle is done once. There are no more frequencies than words.
    frequency = (
        counted.groupBy("term")
        .agg(F.count_if(F.col("_tf") > 0).alias("_df"))
        .crossJoin(F.broadcast(corpus))
    )
    frequency = F.broadcast(frequency) if few else frequency
    idf = F.greatest(
        F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(LEAST_IDF)
    )
    norm = K1 * (1 - B + B * F.col("_length") / F.col("_mean_length"))
    weight = idf * (F.col("_tf") * (K1 + 1)) / (F.col("_tf") + norm)
    weighted = (
        counted.join(frequency, "term")
        .groupBy("doc_id", "_length")
        .agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("held"))
        .select("doc_id", "held")
    )
    schema = (
        f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(documents.dtypes)['doc_id']}, "
        "score double"
    )
    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)
    count, characters = documents.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))
    ).first()
    best = block_map(
        wanted, weighted, "query_id", "doc_id", _keyword_block(k, mode == "all", arrow), schema,
        left_rows=QUERY_BLOCK, right_rows=_documents_per_block(count, characters),
        left_count=queries.count(), right_count=count,
    )
    return top_ranked(best, k, "doc_id")


def top_ranked(scores: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best rows per query with 0-based ranks; ties go to the smaller id.

    The limit is applied before the shuffle as well (window group limit).
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return (
        scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    )


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(row: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Positions of the k greatest scores, best first; ties go to the smaller id."""
    if len(row) > k:
        floor = np.partition(row, len(row) - k)[len(row) - k]
        picked = np.flatnonzero(row >= floor)
    else:
        picked = np.arange(len(row))
    return sorted(picked.tolist(), key=lambda i: (-row[i], ids[i]))[:k]


def _block_topk(k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        query_ids = queries.column("query_id").to_pylist()
        ids = np.array(vectors.column("id").to_pylist(), dtype=object)
        scores = np.round(
            _unit(_matrix(queries, "embedding")) @ _unit(_matrix(vectors, "embedding")).T,
            SCORE_DIGITS,
        )
        out_query, out_id, out_score = [], [], []
        for row, query_id in zip(scores, query_ids, strict=True):
            best = _best(row, ids, k)
            out_query += [query_id] * len(best)
            out_id += [ids[i] for i in best]
            out_score += [float(row[i]) for i in best]
        return pa.table([out_query, out_id, out_score], schema=schema)

    return compare


def _scan_topk(queries: pa.Table, k: int, schema: pa.Schema):
    """Best vectors of each query within one task, batch by batch, where the vectors lie."""
    query_ids = queries.column("query_id").to_pylist()
    matrix = _unit(_matrix(queries, "embedding"))

    def run(batches):
        best_ids: list[np.ndarray] = [np.empty(0, dtype=object)] * len(query_ids)
        best_scores: list[np.ndarray] = [np.empty(0)] * len(query_ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            scores = np.round(matrix @ _unit(_matrix(pa.Table.from_batches([batch]), "embedding")).T, SCORE_DIGITS)
            for q, row in enumerate(scores):
                all_scores = np.concatenate((best_scores[q], row))
                all_ids = np.concatenate((best_ids[q], ids))
                kept = _best(all_scores, all_ids, k)
                best_scores[q], best_ids[q] = all_scores[kept], all_ids[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v for v, s in zip(query_ids, best_scores, strict=True) for _ in s], schema.types[0]),
             pa.array([v for found in best_ids for v in found], schema.types[1]),
             pa.array([float(v) for found in best_scores for v in found], schema.types[2])], schema=schema)

    return run


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 60, sent_bytes: int = 16 << 20
) -> DataFrame:
    """Exact inner-product search: the k nearest vectors of every query.

    `queries`: query_id, embedding. `vectors`: id, embedding. Query vectors of up to
    `sent_bytes` go to every task, and the vectors are scanned where they lie; a task keeps
    k rows per query. More queries meet only clusters of vectors whose bound reaches their
    k best (`operators/nearest.py`). Either way the result is the same.
    """
    types = dict(queries.dtypes) | dict(vectors.dtypes)
    schema = f"query_id {types['query_id']}, id {types['id']}, score double"
    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)
    asked = queries.select("query_id", "embedding")
    size = asked.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    if 0 < size <= sent_bytes:
        found = _scan_topk(asked.toArrow(), k, arrow)
        return top_ranked(vectors.select("id", "embedding").mapInArrow(found, schema), k, "id")
    from tallyweave.operators.nearest import nearest

    return nearest(asked, vectors, k).hits


def fuse_ranks(
    vector_hits: DataFrame,
    keyword_hits: DataFrame,
    k: int = 60,
    vector_weight: float = 0.6,
    keyword_weight: float = 0.4,
) -> DataFrame:
    """Reciprocal rank fusion of two hit lists (query_id, id, rank); ranks from 0.

    Equal scores keep the vector order, then the keyword order.
    """

    def share(hits: DataFrame, weight: float, source: str) -> DataFrame:
        return hits.filter(F.col("id").isNotNull()).select(
            "query_id", "id",
            (F.lit(weight) / (F.col("rank") + (k + 1))).alias("_share"),
            (F.col("rank") if source == "vector" else F.lit(None).cast("int")).alias("_vector"),
            (F.col("rank") if source == "keyword" else F.lit(None).cast("int")).alias("_keyword"),
        )

    union = share(vector_hits, vector_weight, "vector").unionByName(
        share(keyword_hits, keyword_weight, "keyword")
    )
    fused = union.groupBy("query_id", "id").agg(
        F.round(F.sum("_share"), 12).alias("score"),
        F.min("_vector").alias("vector_rank"),
        F.min("_keyword").alias("keyword_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("vector_rank").asc_nulls_last(),
        F.col("keyword_rank").asc_nulls_last(), "id",
    )
    return fused.withColumn("final_rank", F.row_number().over(order) - 1)


def hybrid_topk(
    queries: DataFrame,
    documents: DataFrame,
    vectors: DataFrame,
    top_k: int = 10,
    candidates: int = 60,
    min_score: float | None = None,
    search_type: str = "hybrid",
) -> DataFrame:
    """Vector and keyword candidates fused per query; either side may be empty.

    `queries`: query_id, text, embedding. `documents`: doc_id, text.
    """
    empty = "query_id {0}, id {1}, rank int"
    spark = queries.sparkSession
    none = spark.createDataFrame(
        [], empty.format(dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"])
    )
    near = none if search_type == "keyword" else vector_topk(queries, vectors, candidates)
    words = (
        none
        if search_type == "vector"
        else bm25_topk(queries, documents, candidates).withColumnRenamed("doc_id", "id")
    )
    fused = fuse_ranks(near, words).filter(F.col("final_rank") < top_k)
    return fused if min_score is None else fused.filter(F.col("score") >= min_score)


def rerank(
    candidates: DataFrame,
    top_k: int = 10,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Order candidates (query_id, id, rank, query, text) by a scorer of (query, text).

    Without a scorer the given order stays, with falling scores.
    """
    score = (
        1.0 - F.col("rank") * 0.01
        if scorer is None
        else F.round(scorer(F.col("query"), F.col("text")), SCORE_DIGITS)
    )
    scored = candidates.withColumn("rerank_score", score)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank", "id")
    return scored.withColumn("final_rank", F.row_number().over(order) - 1).filter(
        F.col("final_rank") < top_k
    )


def rag_context(results: DataFrame, max_chars: int = 4000, least: int = 100) -> DataFrame:
    """One context text per query from its ranked results (query_id, rank, text).

    Blocks "[n] text" are joined by blank lines until the budget is full; the block
    that overflows is cut if more than `least` characters are left.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    block = F.concat(F.lit("["), F.col("_number"), F.lit("] "), F.col("text"))
    placed = (
        results.withColumn("_number", F.row_number().over(by_rank))
        .withColumn("_block", block)
        .withColumn(
            "_before",
            F.coalesce(
                F.sum(F.length("_block") + 2).over(
                    by_rank.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    left = F.lit(max_chars) - F.col("_before")
    kept = F.when(F.length("_block") <= left, F.col("_block")).when(
        left > least, F.concat(F.substr(F.col("_block"), F.lit(1), left.cast("int")), F.lit("..."))
    )
    return (
        placed.withColumn("_kept", kept)
        .groupBy("query_id")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("_kept").isNotNull(), F.struct("rank", "_kept")))
            ).alias("_blocks"),
            F.count(F.lit(1)).alias("total_chunks"),
        )
        .select(
            "query_id", F.array_join(F.col("_blocks._kept"), "\n\n").alias("context"),
            "total_chunks",
        )
    )
