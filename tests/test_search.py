import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyweave.operators import chunks, conversation, search
from tallyweave.operators.stemming import stem, stem_table


def split_model(text, size, overlap):
    """Plain model of the chunker."""
    text = text.strip()
    if not text:
        return []
    if len(text) <= size:
        return [text]
    done, current = [], ""
    for sentence in [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]:
        if len(current) + len(sentence) <= size:
            current += sentence + " "
            continue
        if current:
            done.append(current.strip())
        tail = done[-1][-overlap:] + " " if overlap > 0 and done else ""
        current = tail + sentence + " "
    if current.strip():
        done.append(current.strip())
    return done


def test_chunks_equal_the_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), "doc_id", F.lit(1).alias("page_no"), F.lit("x").alias("page_type"), "text")
    extra = [(-1, -1, 1, "x", "  "), (-2, -2, 1, "x", "A" * 700 + ". B."), (-3, -3, 1, "x", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for size, overlap in ((512, 50), (120, 0)):
        got = {}
        for r in chunks.chunk_documents(docs, size, overlap).orderBy("chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.chunk_text)
        for r in docs.collect():
            assert got.get(r.doc_id, []) == split_model(r.text or "", size, overlap)


def bm25_model(queries, documents, k, match_all):
    tokens = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in documents.items()}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, text in queries.items():
        words = re.findall(r"[^\W_]+", text.lower())
        scores = {}
        for d, held in tokens.items():
            hits = set(words) & set(held)
            if not hits or (match_all and hits != set(words)):
                continue
            total = 0.0
            for w in words:
                tf = held.count(w)
                if not tf:
                    continue
                df = sum(w in t for t in tokens.values())
                idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held) / mean))
            scores[d] = round(total, 6)
        out[q] = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    return out


def test_bm25_equals_the_model(spark, monkeypatch):
    rng = random.Random(4)
    words = ["rod", "steel", "pipe", "valve", "the", "of", "brass", "10mm"]
    documents = {i: " ".join(["the"] + rng.choices(words, k=rng.randint(1, 12))) for i in range(200)}
    queries = {f"q{i}": " ".join(rng.choices(words, k=3)) for i in range(9)} | {"none": "zzz"}
    qdf = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    ddf = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 17)
    monkeypatch.setattr(search, "DENSE_CELLS", 20)
    for mode in ("any", "all"):
        want = bm25_model(queries, documents, 7, mode == "all")
        rows = search.bm25_topk(qdf, ddf, 7, mode=mode, expand=False).collect()
        for q in queries:
            mine = [(r.doc_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
            assert [d for d, _ in mine] == [d for d, _ in want[q]]
            assert np.allclose([s for _, s in mine], [s for _, s in want[q]])


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[7] = vectors[3]
    vectors[9] = 0
    queries = np.vstack([vectors[3], rng.normal(size=(3, 8))]).astype(np.float32)
    vdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    rows = search.vector_topk(qdf, vdf, 10).collect()
    blocks = search.vector_topk(qdf, vdf, 10, sent_bytes=0).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, blocks))
    norms = np.linalg.norm(vectors.astype(float), axis=1)
    unit = vectors.astype(float) / np.where(norms > 0, norms, 1)[:, None]
    for q, query in enumerate(queries.astype(float)):
        scores = np.round(unit @ (query / np.linalg.norm(query)), 6)
        want = sorted(range(300), key=lambda i: (-scores[i], i))[:10]
        mine = [r.id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert mine == want
    assert [r.id for r in rows if r.query_id == 0 and r.rank < 2] in ([3, 7], [7, 3])


def test_nearest_skips_clusters_and_equals_brute_force(spark, monkeypatch):
    from tallyweave.operators import nearest as m

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    vectors = (middles[np.arange(600) % 12] + 0.1 * rng.normal(size=(600, 16))).astype(np.float32)
    vectors[::9] = vectors[0]  # many ties
    vectors[5] = 0
    queries = np.vstack([vectors[:80], rng.normal(size=(5, 16)), np.zeros((1, 16))]).astype(np.float32)
    vdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    monkeypatch.setattr(m, "CELL_QUERIES", 7)
    monkeypatch.setattr(m, "CELL_VECTORS", 20)

    def unit(rows):
        norms = np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
        return np.divide(rows.astype(float), norms, out=np.zeros(rows.shape), where=norms > 0)

    scores = np.round(unit(queries) @ unit(vectors).T, 6)
    for k in (1, 10, 700):
        got = m.nearest(qdf, vdf, k, clusters=24)
        rows = got.hits.collect()
        for q in range(len(queries)):
            want = sorted(range(600), key=lambda i: (-scores[q, i], i))[:k]
            assert [r.id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == want
        visits = got.visits.count()
        assert got.visits.distinct().count() == visits
        assert k == 700 or visits < 0.4 * len(queries) * 24
    assert m.nearest(qdf, vdf.limit(0), 3).hits.count() == m.nearest(qdf.limit(0), vdf, 3).hits.count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank int")


def test_rank_fusion(spark):
    vector = hits(spark, [(1, 1, 0), (1, 2, 1)])
    keyword = hits(spark, [(1, 3, 0), (1, 1, 1)])
    got = search.fuse_ranks(vector, keyword).orderBy("final_rank").collect()
    assert [r.id for r in got] == [1, 2, 3]
    assert abs(got[0].score - (0.6 / 61 + 0.4 / 62)) < 1e-9
    empty = hits(spark, [])
    assert [r.id for r in search.fuse_ranks(empty, keyword).orderBy("final_rank").collect()] == [3, 1]
    assert search.fuse_ranks(empty, empty).count() == 0


def test_context_packing(spark):
    rows = [(1, 0, "a" * 50), (1, 1, "b" * 200), (1, 2, "c"), (2, 0, "x" * 80), (2, 1, "y" * 95)]
    df = spark.createDataFrame(rows, "query_id long, rank int, text string")
    got = {r.query_id: r for r in search.rag_context(df, max_chars=180, least=100).collect()}
    first = "[1] " + "a" * 50
    assert got[1].context == first + "\n\n" + ("[2] " + "b" * 200)[: 180 - 56] + "..."
    assert got[1].total_chunks == 3
    assert got[2].context == "[1] " + "x" * 80


def test_rerank(spark):
    df = spark.createDataFrame(
        [(1, 10, 0, "rod", "pipe"), (1, 11, 1, "rod", "rod"), (1, 12, 2, "rod", "x")],
        "query_id long, id long, rank int, query string, text string")
    plain = search.rerank(df, 2).orderBy("final_rank").collect()
    assert [(r.id, round(r.rerank_score, 2)) for r in plain] == [(10, 1.0), (11, 0.99)]
    scored = search.rerank(df, 2, lambda q, t: (q == t).cast("double")).orderBy("final_rank").collect()
    assert [r.id for r in scored] == [11, 10]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id long, t string")
    got = chunks.embed(df, "t", lambda: (lambda texts: np.array([[3.0, 4.0]] * len(texts))), 2).orderBy("id").collect()
    assert [[round(x, 4) for x in r.embedding] for r in got] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]


MESSAGES = "session_id long, turn int, role string, content string, token_count int"


def test_conversation_windows(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}", 10) for i in range(12)] + [(2, 0, "user", "hi", 99)]
    df = spark.createDataFrame(rows, MESSAGES)
    last = conversation.last_messages(df, 3).filter("session_id = 1").orderBy("position").collect()
    assert [(r.turn, r.position) for r in last] == [(9, 1), (10, 2), (11, 3)]
    for block in (1000, 2):
        monkeypatch.setattr(conversation, "BLOCK", block)
        fits = conversation.context_messages(df, 35).collect()
        assert sorted((r.session_id, r.turn) for r in fits) == [(1, 9), (1, 10), (1, 11)]
    prompt = {r.session_id: r.prompt for r in conversation.chat_prompts(
        df, spark.createDataFrame([(1, "CTX")], "session_id long, context string")).collect()}
    assert prompt[1].startswith("Use the following context to help answer the question:\n\nCTX\n\n---\n")
    assert "User: m5\n" in prompt[1] and "m4" not in prompt[1]
    assert prompt[1].endswith("User: m11\n\nAssistant:")
    assert prompt[2] == "User: hi\n\nAssistant:"


def test_facts(spark):
    df = spark.createDataFrame(
        [(1, "- short\n- Order total is 500\n text\n -  ACME is the seller "), (2, "None"), (3, "- tiny")],
        "session_id long, response string")
    got = conversation.extract_facts(df).collect()
    assert {(r.session_id, r.value) for r in got} == {(1, "Order total is 500"), (1, "ACME is the seller")}
    facts = spark.createDataFrame([(1, "k", "a", 1), (1, "k", "b", 2), (1, "j", "c", 1)],
                                  "session_id long, key string, value string, updated_at int")
    got = {r.key: (r.value, r.access_count) for r in conversation.upsert_facts(facts, F.col("updated_at")).collect()}
    assert got == {"k": ("b", 1), "j": ("c", 0)}


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file",
        "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "hopefulness": "hope",
        "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect",
        "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky",
        "generalizations": "gener", "by": "by",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "motoring pipes"), (2, "cable")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "motors pipe")], "query_id long, text string")
    words = search.vocabulary(docs.select("text").unionByName(queries.select("text")))
    got = search.bm25_topk(queries, docs, 5, mode="all", stems=stem_table(words)).collect()
    assert [r.doc_id for r in got] == [1]


def test_blocks_of_long_documents_are_bounded_by_their_text(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    long_texts = [(i, f"alpha {'gamma ' * 700}" + "beta " * (i % 7)) for i in range(40)] + [(40, None)]
    documents = spark.createDataFrame(long_texts, "doc_id long, text string")
    want = [tuple(r) for r in search.bm25_topk(queries, documents, 5).orderBy("rank").collect()]
    rows, plain = [], search.block_map

    def spied(*args, **options):
        rows.append(options["right_rows"])
        return plain(*args, **options)

    monkeypatch.setattr(search, "block_map", spied)
    search.bm25_topk(queries, documents, 5)
    assert rows[0] * 4_200 <= 10_000_000
    monkeypatch.setattr(search, "TEXT_BLOCK", 8_000, raising=False)
    assert [tuple(r) for r in search.bm25_topk(queries, documents, 5).orderBy("rank").collect()] == want
    assert rows[1] <= 2


def test_visits_come_in_small_batches(monkeypatch):
    import pyarrow as pa

    from tallyweave.operators import nearest as near

    rng = np.random.default_rng(5)
    vectors, centres = rng.normal(size=(500, 4)), rng.normal(size=(40, 4))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(vectors.tolist()), pa.array([-9.0] * 500)], ["query_id", "embedding", "floor"])

    def visited(floored):
        sizes = np.where(np.arange(40) % 8 == 0, 0, 3)
        got = [*near._visits(centres, np.full(40, 0.5), sizes, 10, floored)(iter([batch, batch.slice(0, 0)]))]
        assert all(len(v) == 4 for b in got for v in b.column("embedding").to_pylist()[:3])
        return max(b.num_rows for b in got), [
            t for b in got for t in zip(*(b.column(c).to_pylist() for c in ("query_id", "home", "cluster")))]

    whole = [visited(f)[1] for f in (False, True)]
    assert len(whole[0]) == 500 * 4 and len(whole[1]) == 500 * 31
    monkeypatch.setattr(near, "VISIT_QUERIES", 30, raising=False)
    monkeypatch.setattr(near, "VISIT_ROWS", 50, raising=False)
    for floored, rows in zip((False, True), whole):
        largest, parts = visited(floored)
        assert largest <= 50 and parts == rows
