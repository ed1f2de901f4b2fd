"""Chunks, keyword and vector search, fusion, context and prompts."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyweave.functions.text import WS, search_tokens
from tallyweave.operators import chunks, conversation, rollups, search, views
from tallyweave.operators import stored_index as stored
from tallyweave.operators.nearest import nearest
from tallyweave.operators.partitioning import small_side, spread
from tallyweave.operators.stemming import stem_table
from tallyweave.plans import model
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query
from tallyweave.session import cut_lineage
from tallyweave.streaming import jobs


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


_CHUNKS = f"""
    body AS (SELECT doc_id, {_strip('text')} AS t FROM documents),
    parts AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t,
                  '([.!?]){WS}+', '\\1' || chr(57344), 'g'), chr(57344)),
                  lambda s: {_strip('s')}), lambda s: s <> '') AS ss FROM body),
    packed AS (
        SELECT doc_id, list_reduce(
            list_transform(ss, lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
            lambda a, x: CASE
                WHEN length(a.cur) + length(x.cur) <= 512
                THEN {{'done': a.done, 'cur': a.cur || x.cur || ' '}}
                WHEN a.cur = '' THEN {{'done': a.done, 'cur': x.cur || ' '}}
                ELSE {{'done': list_append(a.done, {_strip('a.cur')}),
                      'cur': right({_strip('a.cur')}, 50) || ' ' || x.cur || ' '}} END,
            {{'done': []::VARCHAR[], 'cur': ''}}) AS r
        FROM parts WHERE length(t) > 512),
    texts AS (
        SELECT doc_id, [t] AS c FROM body WHERE t <> '' AND length(t) <= 512
        UNION ALL SELECT doc_id, CASE WHEN {_strip('r.cur')} = '' THEN r.done
            ELSE list_append(r.done, {_strip('r.cur')}) END FROM packed),
    chunk AS (SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index,
                     unnest(c) AS chunk_text FROM texts)"""


def pages_of(spark, sf):
    return spread(model.doc_pages(spark, sf))


@query("chunk_documents", sql(
    "SELECT *, CAST(length(chunk_text) AS INTEGER) AS chunk_size FROM chunk", extra=_CHUNKS))
def chunk_documents(spark, sf):
    return chunks.chunk_documents(pages_of(spark, sf)).select(
        "doc_id", "chunk_index", "chunk_text", "chunk_size"
    )


@query("searchable_chunks", sql("""
    SELECT c.doc_id, c.chunk_index, c.chunk_text, d.filename, d.company_key, p.page_no,
           p.page_type
    FROM chunk c JOIN doc d ON d.id = c.doc_id AND d.is_latest
    LEFT JOIN page p ON p.id = c.doc_id""", "doc", "page", extra=_CHUNKS))
def searchable_chunks(spark, sf):
    pages = pages_of(spark, sf)
    pieces = chunks.chunk_documents(pages).drop("page_no", "page_type")
    found = views.searchable_chunks(pieces, model.documents(spark, sf), pages)
    return found.select(
        "doc_id", "chunk_index", "chunk_text", "filename", "company_key", "page_no", "page_type"
    )


@query("pending_chunks", sql("""
    SELECT c.doc_id, count(*) AS chunks FROM chunk c JOIN doc d ON d.id = c.doc_id
    WHERE d.is_latest AND c.doc_id > 250 GROUP BY 1""", "doc", extra=_CHUNKS))
def pending_chunks(spark, sf):
    pages = pages_of(spark, sf)
    pending = views.pending_after(pages, model.documents(spark, sf), "doc_id", F.lit(250))
    return chunks.chunk_documents(pending).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks")
    )


def _fold(text: str) -> str:
    from tallyweave.functions.text import ACCENTED, UNACCENTED

    return f"translate(lower({text}), '{ACCENTED}', '{UNACCENTED}')"


def _tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex({_fold(text)}, '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


@query("keyword_index", f"""
    SELECT term, doc_id, count(*) AS tf
    FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY 1, 2""")
def keyword_index(spark, sf):
    return search.postings(texts_of(spark, sf))


@query("keyword_vocabulary", f"""
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
        SELECT term, doc_id, count(*) AS tf
        FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY 1, 2)
    GROUP BY 1""")
def keyword_vocabulary(spark, sf):
    return search.term_frequencies(search.postings(texts_of(spark, sf)))


def _expanded(text: str) -> str:
    """The text followed by the bare form and the parts of its dotted or hyphenated tokens."""
    coded = (
        f"list_filter(regexp_extract_all(lower({text}), '[A-Za-z0-9._-]+'), "
        "lambda t: regexp_matches(t, '[.-]'))"
    )
    extras = (
        f"flatten(list_transform({coded}, lambda t: list_filter(list_prepend("
        "regexp_replace(t, '[.-]', '', 'g'), string_split_regex(t, '[.-]+')), lambda p: p <> '')))"
    )
    return f"{text} || ' ' || array_to_string({extras}, ' ')"


def _bm25(queries: str, documents: str, having: str = "true") -> str:
    """Clauses up to `scores(query_id, doc_id, score)`."""
    return f"""
    q AS ({queries}), d AS ({documents}),
    qt AS (SELECT query_id, term, count(*) AS w FROM (
        SELECT query_id, unnest({_tokens('text')}) AS term FROM q) GROUP BY 1, 2),
    qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
    dt AS (SELECT doc_id, {_tokens('text')} AS ts FROM d),
    corpus AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM dt),
    tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (
        SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM dt) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    scores AS (
        SELECT qt.query_id, tf.doc_id, round(sum(qt.w
            * greatest(ln((c.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)), 1e-6)
            * (tf.tf * 2.2::DOUBLE)
            / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.l / c.mean))), 6) AS score
        FROM qt JOIN tf ON tf.term = qt.term JOIN df ON df.term = qt.term
        JOIN qn ON qn.query_id = qt.query_id CROSS JOIN corpus c
        GROUP BY qt.query_id, tf.doc_id, qn.n HAVING {having}),
    hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS rank FROM scores)"""


_EXPANDED_Q = f"SELECT item_id AS query_id, {_expanded('text')} AS text FROM benchmark"
_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
_DOCS = "SELECT doc_id, text FROM documents"


def texts_of(spark, sf):
    return spread(model.table(spark, sf, "documents").select("doc_id", "text"))


def bench_queries(spark, sf):
    return model.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", sql("SELECT query_id, doc_id, score, rank FROM hits WHERE rank < 60",
                        extra=_bm25(_BENCH_Q, _DOCS)))
def bm25_topk(spark, sf):
    return search.bm25_topk(
        bench_queries(spark, sf), texts_of(spark, sf), 60, expand=False
    )


@query("bm25_expanded", sql("SELECT query_id, doc_id, score, rank FROM hits WHERE rank < 60",
                            extra=_bm25(_EXPANDED_Q, _DOCS)))
def bm25_expanded(spark, sf):
    return search.bm25_topk(bench_queries(spark, sf), texts_of(spark, sf), 60)


def stored_index(spark, sf):
    """Three batches of the documents: a first build and two appends."""
    index = stored.KeywordIndex(spark, jobs.work_folder(spark))
    documents = texts_of(spark, sf)
    for batch in range(3):
        index.append(batch, documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == batch))
    return index


@query("stored_index_topk", sql("SELECT query_id, doc_id, score, rank FROM hits WHERE rank < 60",
                                extra=_bm25(_EXPANDED_Q, _DOCS)))
def stored_index_topk(spark, sf):
    return stored_index(spark, sf).search(bench_queries(spark, sf), 60)


@query("stored_index_terms", f"""
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
        SELECT term, doc_id, count(*) AS tf
        FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY 1, 2)
    GROUP BY 1""")
def stored_index_terms(spark, sf):
    return stored_index(spark, sf).terms()


@query("bm25_stemmed", None)
def bm25_stemmed(spark, sf):
    documents, queries = texts_of(spark, sf), bench_queries(spark, sf)
    words = search.vocabulary(documents.select("text").unionByName(queries.select("text")))
    return search.bm25_topk(queries, documents, 60, stems=stem_table(words))


@query("bm25_all_terms", sql("SELECT query_id, doc_id, score, rank FROM hits WHERE rank < 60",
                             extra=_bm25(_BENCH_Q, _DOCS, "count(*) = qn.n")))
def bm25_all_terms(spark, sf):
    return search.bm25_topk(
        bench_queries(spark, sf), texts_of(spark, sf), 60, mode="all", expand=False
    )


@query("keyword_item_hits", sql("""
    SELECT h.query_id, i.id AS item_id, h.score, h.rank, i.quantity, i.total_price, v.invoice_no,
           v.invoice_date
    FROM hits h JOIN items i ON i.id = h.doc_id
    LEFT JOIN hdr v ON v.id = i.invoice_id AND v.is_latest
    WHERE h.rank < 60""", "items", "hdr", extra=_bm25(
        "SELECT p_name || ' ' || p_type AS query_id, p_name || ' ' || p_type AS text FROM part "
        "GROUP BY 1",
        "SELECT id AS doc_id, item_name || ' ' || hs_code || ' ' || brand AS text FROM items",
        "count(*) = qn.n")))
def keyword_item_hits(spark, sf):
    from tallyweave.functions.text import item_search_text

    items = model.invoice_items(spark, sf)
    wanted = F.concat_ws(" ", "p_name", "p_type")
    queries = model.table(spark, sf, "part").select(
        wanted.alias("query_id"), wanted.alias("text")
    ).distinct()
    texts = items.select(
        F.col("id").alias("doc_id"),
        item_search_text(F.col("item_name"), F.col("hs_code"), F.col("brand"), F.lit("")).alias(
            "text"
        ),
    )
    # Hits are few rows per query. Written, they can be measured and may meet the items where these lie.
    hits = cut_lineage(search.bm25_topk(queries, texts, 60, mode="all", expand=False))
    joined = views.hits_with_items(
        small_side(hits.withColumnRenamed("doc_id", "item_id")),
        items.withColumnRenamed("id", "item_id"), model.invoice_headers(spark, sf),
    )
    return joined.select(
        "query_id", "item_id", "score", "rank", "quantity", "total_price", "invoice_no",
        "invoice_date",
    )


@query("keyword_chunk_hits", sql("""
    SELECT h.query_id, h.doc_id AS chunk_id, h.score, h.rank, d.text AS chunk_text, p.page_no,
           p.page_type
    FROM hits h JOIN d ON d.doc_id = h.doc_id LEFT JOIN page p ON p.id = h.doc_id
    WHERE h.rank < 20""", "page", extra=_bm25(
        _BENCH_Q, "SELECT doc_id || ':' || chunk_index AS doc_id, chunk_text AS text FROM chunk"
    )).replace("q AS (", _CHUNKS.strip() + ",\n    q AS (", 1).replace(
        "p.id = h.doc_id", "p.id = split_part(h.doc_id, ':', 1)::BIGINT"))
def keyword_chunk_hits(spark, sf):
    pages = pages_of(spark, sf)
    pieces = chunks.chunk_documents(pages).select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "page_id", "chunk_text"
    )
    texts = pieces.select(F.col("chunk_id").alias("doc_id"), F.col("chunk_text").alias("text"))
    hits = search.bm25_topk(bench_queries(spark, sf), texts, 20, expand=False)
    found = views.hits_with_chunks(hits.withColumnRenamed("doc_id", "chunk_id"), pieces, pages)
    return found.drop("page_id")


@query("vectors_with_entity", """
    SELECT vec_id AS id FROM embeddings WHERE vec_id IN (
        SELECT doc_id FROM documents WHERE lang <> 'de')""")
def vectors_with_entity(spark, sf):
    entities = views.latest(model.documents(spark, sf))
    return views.drop_orphan_vectors(vectors_of(spark, sf), entities).select("id")


@query("session_facts", """
    SELECT user_id AS session_id, event_id::VARCHAR AS key, event_type AS fact_type, value
    FROM events WHERE event_type = 'purchase'""")
def session_facts(spark, sf):
    facts = model.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("key"),
        F.col("event_type").alias("fact_type"), "value", F.col("ts").alias("updated_at"),
    )
    return conversation.session_facts(facts, fact_type="purchase").drop("updated_at")


def label_queries(spark, sf):
    """One query vector per label: the mean of its vectors."""
    vectors = model.table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]
        ).alias("embedding")
    )


def vectors_of(spark, sf):
    return model.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_NEAREST = """
    qv AS (SELECT label, pos, avg(x) AS x FROM (
        SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x
        FROM embeddings) GROUP BY 1, 2),
    qq AS (SELECT label AS query_id, list(x ORDER BY pos) AS e FROM qv GROUP BY 1),
    vv AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e
           FROM embeddings),
    sim AS (SELECT query_id, id, round(list_dot_product(qq.e, vv.e)
                / sqrt(list_dot_product(qq.e, qq.e)) / sqrt(list_dot_product(vv.e, vv.e)), 6)
                AS score FROM qq CROSS JOIN vv),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM sim)"""


@query("vector_topk", sql("SELECT query_id, id, score, rank FROM near WHERE rank < 60",
                          extra=_NEAREST))
def vector_topk(spark, sf):
    return search.vector_topk(label_queries(spark, sf), vectors_of(spark, sf), 60)


@query("vector_neighbours", """
    WITH vv AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    uu AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM vv),
    sim AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.e, b.e) / a.n / b.n, 6) AS score
            FROM uu a CROSS JOIN uu b),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM sim)
    SELECT query_id, id, score, rank FROM near WHERE rank < 10""")
def vector_neighbours(spark, sf):
    vectors = vectors_of(spark, sf)
    return nearest(vectors.withColumnRenamed("id", "query_id"), vectors, 10).hits


@query("vector_index", """
    SELECT 'chunks' AS index_name, vec_id AS id, len(embedding)::INTEGER AS dimension,
           round(sqrt(list_dot_product(embedding, embedding)), 3)::DOUBLE AS norm
    FROM embeddings""")
def vector_index(spark, sf):
    from tallyweave.functions.numbers import l2_norm

    doubled = vectors_of(spark, sf).withColumn(
        "embedding", F.transform("embedding", lambda x: x * F.lit(2.0))
    )
    index = chunks.vector_table(doubled, "chunks")
    return index.select(
        "index_name", "id", F.size("embedding").alias("dimension"),
        F.round(l2_norm(F.col("embedding")), 3).alias("norm"),
    )


@query("vector_append", """
    SELECT vec_id AS id FROM embeddings
    WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)""")
def vector_append(spark, sf):
    all_vectors = model.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return chunks.new_vectors(all_vectors, all_vectors.filter("label = 0")).select("id")


@query("index_statistics", sql("""
    SELECT 'chunks' AS index_name, count(*) AS entries, max(doc_id) AS last_id FROM chunk
    UNION ALL SELECT 'vectors', count(*), max(vec_id) FROM embeddings""", extra=_CHUNKS))
def index_statistics(spark, sf):
    pieces = chunks.chunk_documents(pages_of(spark, sf)).select(
        F.lit("chunks").alias("index_name"), F.col("doc_id").alias("id")
    )
    vectors = vectors_of(spark, sf).select(F.lit("vectors").alias("index_name"), "id")
    return rollups.index_statistics(pieces.unionByName(vectors))


def hybrid_queries(spark, sf):
    """Every benchmark text, with the vector of the same number as its embedding."""
    texts = model.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = model.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return texts.join(vectors, "query_id")


_FUSED = """,
    share AS (
        SELECT query_id, id, 0.6::DOUBLE / (61 + rank) AS s, rank AS v, NULL::INTEGER AS w
        FROM near WHERE rank < 60 AND query_id IN (SELECT query_id FROM q)
        UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (61 + rank), NULL, rank
        FROM hits WHERE rank < 60),
    fused AS (SELECT query_id, id, round(sum(s), 12) AS score, min(v) AS vector_rank,
                     min(w) AS keyword_rank FROM share GROUP BY 1, 2),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
                  vector_rank NULLS LAST, keyword_rank NULLS LAST, id) - 1 AS INTEGER)
                  AS final_rank FROM fused)"""
_PAIRED = _NEAREST[:_NEAREST.index("    qv AS")] + """
    qq AS (SELECT item_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
           FROM benchmark JOIN embeddings ON vec_id = item_id),""" + _NEAREST[_NEAREST.index("\n    vv AS"):]
_HYBRID_Q = "SELECT item_id AS query_id, text FROM benchmark"


@query("rrf_fusion", sql("""
    SELECT query_id, id, rnd(score * 1000) AS score_milli, vector_rank, keyword_rank, final_rank
    FROM final""", extra=_PAIRED + "," + _bm25(_HYBRID_Q, _DOCS) + _FUSED))
def rrf_fusion(spark, sf):
    queries = hybrid_queries(spark, sf)
    near = search.vector_topk(queries, vectors_of(spark, sf), 60)
    words = search.bm25_topk(
        queries, texts_of(spark, sf), 60, expand=False
    ).withColumnRenamed("doc_id", "id")
    return search.fuse_ranks(near, words).withColumn(
        "score_milli", model.rounded(F.col("score") * 1000)
    ).drop("score")


@query("hybrid_topk", sql("""
    SELECT query_id, id, final_rank FROM final WHERE final_rank < 10 AND score >= 0.006""",
    extra=_PAIRED + "," + _bm25(_EXPANDED_Q, _DOCS) + _FUSED))
def hybrid_topk(spark, sf):
    found = search.hybrid_topk(
        hybrid_queries(spark, sf), texts_of(spark, sf), vectors_of(spark, sf),
        top_k=10, min_score=0.006,
    )
    return found.select("query_id", "id", "final_rank")


def _candidates(spark, sf, k):
    documents = texts_of(spark, sf)
    queries = bench_queries(spark, sf)
    hits = search.bm25_topk(queries, documents, k, expand=False)
    texts = documents.select("doc_id", "text")
    return hits.join(texts, "doc_id").join(
        queries.withColumnRenamed("text", "query"), "query_id"
    ).withColumnRenamed("doc_id", "id")


def _overlap(query_text, text):
    """Share of the query's words that the text holds."""
    words = F.array_distinct(search_tokens(query_text))
    shared = F.array_intersect(words, search_tokens(text))
    return F.size(shared).cast("double") / F.size(words)


@query("rerank", sql(f"""
    SELECT query_id, doc_id AS id, rerank_score, final_rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY rerank_score DESC, rank, doc_id) - 1 AS INTEGER) AS final_rank
        FROM (SELECT h.query_id, h.doc_id, h.rank,
                round(len(list_intersect(list_distinct({_tokens('q.text')}),
                      {_tokens('d.text')}))::DOUBLE / len(list_distinct({_tokens('q.text')})), 6)
                      AS rerank_score
              FROM hits h JOIN q ON q.query_id = h.query_id JOIN d ON d.doc_id = h.doc_id
              WHERE h.rank < 30))
    WHERE final_rank < 10""", extra=_bm25(_BENCH_Q, _DOCS)))
def rerank(spark, sf):
    ranked = search.rerank(_candidates(spark, sf, 30), 10, _overlap)
    return ranked.select("query_id", "id", "rerank_score", "final_rank")


@query("rerank_fallback", sql("""
    SELECT query_id, doc_id AS id, rnd(1 - rank * 0.01::DOUBLE) AS rerank_score,
           rank AS final_rank FROM hits WHERE rank < 10""", extra=_bm25(_BENCH_Q, _DOCS)))
def rerank_fallback(spark, sf):
    ranked = search.rerank(_candidates(spark, sf, 30), 10)
    return ranked.select(
        "query_id", "id", model.rounded("rerank_score").alias("rerank_score"), "final_rank"
    )


@query("rag_context", sql("""
    SELECT query_id, md5(string_agg(kept, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
           count(*) AS total_chunks FROM (
        SELECT query_id, rank, CASE WHEN length(block) <= 4000 - used THEN block
            WHEN 4000 - used > 100 THEN substr(block, 1, (4000 - used)::INTEGER) || '...' END
            AS kept
        FROM (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
              FROM (SELECT h.query_id, h.rank, '[' || (h.rank + 1) || '] ' || d.text AS block
                    FROM hits h JOIN d ON d.doc_id = h.doc_id WHERE h.rank < 5)))
    GROUP BY 1""", extra=_bm25(_BENCH_Q, _DOCS)))
def rag_context(spark, sf):
    packed = search.rag_context(_candidates(spark, sf, 5).drop("query"))
    return packed.select("query_id", F.md5("context").alias("context_md5"), "total_chunks")


def hashing_embedder(dimension: int = 64):
    """A stand-in for a model: signed word hashes."""

    def make():
        def vectors(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), dtype=np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    code = zlib.crc32(word.encode())
                    out[i, code % dimension] += 1.0 if code & 65536 else -1.0
            return out

        return vectors

    return make


@query("embed_chunks", None)
def embed_chunks(spark, sf):
    from tallyweave.functions.text import embedding_text

    pieces = chunks.chunk_documents(pages_of(spark, sf)).withColumn(
        "embedding_text", embedding_text(F.col("chunk_text"), F.col("page_type"))
    )
    embedded = chunks.embed(pieces, "embedding_text", hashing_embedder(), 64)
    return embedded.select("doc_id", "chunk_index", "embedding")


@query("last_messages", sql("""
    SELECT session_id, turn, role, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn)
           AS INTEGER) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM msg)
    WHERE back <= 3""", "msg"))
def last_messages(spark, sf):
    return conversation.last_messages(model.chat_messages(spark, sf), 3).select(
        "session_id", "turn", "role", "position"
    )


@query("context_budget", sql("""
    SELECT session_id, turn, tokens_used::BIGINT AS tokens_used FROM (
        SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY turn DESC
                   ROWS UNBOUNDED PRECEDING) AS tokens_used FROM msg)
    WHERE tokens_used <= 150""", "msg"))
def context_budget(spark, sf):
    return conversation.context_messages(model.chat_messages(spark, sf), 150).select(
        "session_id", "turn", "tokens_used"
    )


@query("chat_prompts", sql("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) - 1 AS back
               FROM msg)
    SELECT session_id, md5(coalesce('Previous conversation:' || chr(10) || string_agg(
        CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content || chr(10), ''
        ORDER BY turn) FILTER (back BETWEEN 1 AND 6) || chr(10), '') || 'User: '
        || max(content) FILTER (back = 0) || chr(10) || chr(10) || 'Assistant:') AS prompt_md5
    FROM r GROUP BY 1""", "msg").replace("\n    WITH r AS", ", r AS", 1))
def chat_prompts(spark, sf):
    prompts = conversation.chat_prompts(model.chat_messages(spark, sf))
    return prompts.select("session_id", F.md5("prompt").alias("prompt_md5"))


@query("summary_inputs", sql("""
    SELECT session_id, md5(substr(string_agg(role || ': ' || substr(content, 1, 200), chr(10)
           ORDER BY turn), 1, 2000)) AS input_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM msg)
    WHERE back <= 50 GROUP BY 1""", "msg"))
def summary_inputs(spark, sf):
    found = conversation.summary_inputs(model.chat_messages(spark, sf))
    return found.select("session_id", F.md5("summary_input").alias("input_md5"))


@query("needs_summary", """
    SELECT user_id AS session_id, count(*) AS message_count,
           count(*) > 20 AND count(*) - max(user_id % 90) > 10 AS needs_summary
    FROM events GROUP BY 1""")
def needs_summary(spark, sf):
    messages = model.table(spark, sf, "events").select(F.col("user_id").alias("session_id"))
    sessions = messages.distinct().withColumn("summary_message_count", F.col("session_id") % 90)
    return conversation.needs_summary(sessions, messages)


@query("fact_upsert", """
    SELECT user_id AS session_id, event_type AS key, arg_max(value, struct_pack(ts, event_id))
           AS value, max(ts) AS updated_at, count(*) - 1 AS access_count
    FROM events GROUP BY 1, 2""")
def fact_upsert(spark, sf):
    facts = model.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), "value",
        F.col("ts").alias("updated_at"), "event_id",
    )
    return conversation.upsert_facts(facts, F.struct("updated_at", "event_id"))


@query("extract_facts", sql(f"""
    SELECT session_id, value, 'extracted_' || sha256(value) AS key FROM (
        SELECT session_id, {_strip("substr(line, 3)")} AS value FROM (
            SELECT session_id, {_strip('l')} AS line FROM (
                SELECT session_id, '- ' || unnest(string_split(content, chr(10))) AS l FROM msg
                WHERE NOT contains(upper(content), 'NONE')))
        WHERE starts_with(line, '- '))
    WHERE length(value) > 5""", "msg"))
def extract_facts(spark, sf):
    listed = F.array_join(
        F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n"
    )
    replies = (
        model.chat_messages(spark, sf)
        .withColumn("response", listed)
    )
    return conversation.extract_facts(replies).select("session_id", "value", "key")
