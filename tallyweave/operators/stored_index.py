"""A keyword index that lasts: postings by term bucket, batch after batch, searched block by block.

Folder layout; every table has a folder per batch, and postings and terms one per bucket in it:

* ``postings``: one row per term and block of documents, with the document ids, counts and
  lengths as arrays, and the largest count and smallest length of the row beside them
* ``terms``: what the batch adds to the document and occurrence counts of each term
* ``corpus``: what the batch adds to the number and total length of documents
* ``commits``: a row per finished batch, written last; readers see committed batches only

A batch that was cut short is invisible, and writing it again replaces what is there. Block
bounds follow from the largest count and smallest length, so they stay right when later
batches change document frequencies and the mean length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tallyweave.functions.text import expand_query, search_tokens
from tallyweave.operators.partitioning import fan_out
from tallyweave.operators.search import DENSE_CELLS, K1, LEAST_IDF, QUERY_BLOCK, SCORE_DIGITS, B, top_ranked
from tallyweave.session import cut_lineage

#: Scores of hits and bounds of blocks are sums in another order; a block goes only below this.
MARGIN = 10.0 ** -SCORE_DIGITS
#: Writers per bucket, so that a bucket is never written by a single task.
WRITERS = 4
#: Documents whose postings are scored together against a block of queries.
CELL = 2_048
#: Up to this many words of queries are named in the scan; more are met by the joins alone.
LISTED = 4_096


@dataclass(frozen=True)
class KeywordIndex:
    """An index in the folder `path`, which all executors can reach.

    `buckets` is chosen once: term folders per batch. `block` is the number of documents that
    share a postings row on average, `id_type` the type of doc_id.
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    block: int = 128
    id_type: str = "bigint"

    # Writing

    def append(self, batch: int, documents: DataFrame) -> None:
        """Index the documents (doc_id, text) of one batch under its number.

        Ids must be new to the index. A committed batch is left as it is, so a replay of the
        same number does nothing; one that was cut short is written anew.
        """
        if batch in self.batches():
            return
        n = documents.count()
        blocks = max(1, math.ceil(n / self.block))
        # Texts are dealt by block once; all counting of words stays inside those parts.
        placed = fan_out(documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast(
            "int").alias("block")), "block")
        sized = placed.select("block", "doc_id", search_tokens(F.col("text")).alias("tokens")).withColumn(
            "length", F.size("tokens"))
        # An outer explode, as in `search.postings`: the text is split once.
        counted = sized.select("block", "doc_id", "length", F.explode_outer("tokens").alias("term")).where(
            F.col("term").isNotNull()).groupBy("block", "term", "doc_id", "length").agg(
            F.count("*").cast("int").alias("tf"))
        rows = counted.groupBy("block", "term").agg(
            F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"),
            F.sum("tf").alias("occurrences"), F.array_sort(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("hits"))
        slots = self.buckets * WRITERS
        dealt = rows.withColumn("bucket", self._bucket(F.col("term"))).repartition(
            slots, "bucket", F.pmod(F.xxhash64("term"), F.lit(WRITERS)))
        self._write(dealt.sortWithinPartitions("bucket", "term", "block"), "postings", batch, ["bucket"])
        added = self._read("postings", [batch]).groupBy("bucket", "term").agg(
            F.sum("n").alias("df"), F.sum("occurrences").alias("cf"))
        self._write(added.sortWithinPartitions("bucket", "term"), "terms", batch, ["bucket"])
        # Every word of a document is an occurrence of a term.
        corpus = self._read("terms", [batch]).agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.sum("cf"), F.lit(0)).alias("words"))
        self._write(corpus, "corpus", batch)
        self._write(self.spark.createDataFrame([(batch,)], "number int"), "commits", batch)

    def rebuild(self, documents: DataFrame, target: str) -> KeywordIndex:
        """A new index over all documents as a single batch, in another folder."""
        fresh = replace(self, path=target)
        fresh.append(0, documents)
        return fresh

    # Reading

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(r["number"] for r in self.spark.read.schema("number int, batch int").parquet(str(folder)).select(
            "number").collect())

    def terms(self) -> DataFrame:
        """(term, df, cf) over all committed batches."""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def postings(self) -> DataFrame:
        """(term, doc_id, tf) of all committed batches."""
        return self._read("postings").select("term", F.explode("hits").alias("h")).select(
            "term", "h.doc_id", F.col("h.tf").cast("long").alias("tf"))

    def search(self, queries: DataFrame, k: int = 60, mode: str = "any", expand: bool = True) -> DataFrame:
        """The k best documents of each query (query_id, text), as `search.bm25_topk` gives them.

        Only buckets of the queries' terms are read. Headers of postings give each query an
        upper bound per block. The most promising blocks are scored first; the k-th score they
        reach decides which of the others are scored at all. A block with a bound below it
        cannot hold a hit, so the result is that of a full scan.
        """
        plan = self.plan_blocks(queries, mode, expand, k)
        first = plan.blocks.where(F.col("before") < k)
        started = cut_lineage(top_ranked(plan.score(first), k, "doc_id"))
        floor = started.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        later = plan.blocks.where(F.col("before") >= k).join(floor, "query_id", "left").where(
            F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN))
        both = started.drop("rank").unionByName(plan.score(later))
        return top_ranked(both, k, "doc_id").select("query_id", "doc_id", "score", "rank")

    def plan_blocks(self, queries: DataFrame, mode: str = "any", expand: bool = True, k: int = 60) -> BlockPlan:
        """Bounds of all blocks that hold a term of a query; see `search`."""
        text = expand_query(F.col("text")) if expand else F.col("text")
        wanted = queries.select("query_id", F.explode(search_tokens(text)).alias("term")).groupBy("query_id", "term").agg(
            F.count("*").cast("double").alias("repeats"))
        asked = wanted.groupBy("query_id").agg(F.count("*").alias("asked"))
        live = self.batches()
        wanted = cut_lineage(wanted.withColumn("bucket", self._bucket(F.col("term"))))
        # The number of buckets bounds this list, whatever the number of queries.
        used = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        own = F.col("bucket").isin(used)
        words = [r["term"] for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
        if len(words) <= LISTED:
            own = own & F.col("term").isin(words)
        corpus = self._read("corpus", live).agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        total, mean = float(corpus["n"] or 0), float(corpus["words"] or 0) / max(1.0, float(corpus["n"] or 0))
        df = self._read("terms", live).where(own).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        known = cut_lineage(wanted.join(df, ["bucket", "term"]).select(
            "query_id", "bucket", "term", (idf * F.col("repeats")).alias("idf")))
        rows = self._read("postings", live).where(own)

        def weight(tf: Column, length: Column) -> Column:
            return F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))

        heads = rows.select("bucket", "term", "batch", "block", "n", "max_tf", "min_length")
        bounds = known.join(heads, ["bucket", "term"]).groupBy("query_id", "batch", "block").agg(
            F.sum(weight(F.col("max_tf"), F.col("min_length"))).alias("bound"), F.max("n").alias("least"),
            F.count("*").alias("found"))
        if mode == "all":
            bounds = bounds.join(asked, "query_id").where("found = asked").drop("asked")
        # Documents that blocks with higher bounds are sure to give.
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "batch", "block").rowsBetween(
            Window.unboundedPreceding, -1)
        blocks = cut_lineage(bounds.withColumn("before", F.coalesce(F.sum("least").over(order), F.lit(0))))

        parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
        cell = F.floor(F.col("block") / max(1, CELL // self.block)).cast("int").alias("cell")
        schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {self.id_type}, score double"
        arrow = to_arrow_schema(self.spark.createDataFrame([], schema).schema)
        texts = known.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms")).join(asked, "query_id")
        sought = known.select(part, "bucket", "term").distinct()

        def score(chosen: DataFrame) -> DataFrame:
            left = chosen.select("query_id", "batch", "block", cell).groupBy("query_id", "batch", "cell").agg(
                F.collect_list("block").alias("blocks")).join(texts, "query_id").withColumn("part", part)
            visited = chosen.select(part, "batch", "block").distinct()
            # Read anew: a frame that also lies under `chosen` would make its columns ambiguous.
            right = self._read("postings", live).where(own).select("bucket", "term", "batch", "block", "hits", cell).join(
                sought, ["bucket", "term"]).join(visited, ["part", "batch", "block"]).select(
                "part", "batch", "cell", "block", "term", "hits")
            # Shared out here, with a given number: adaptive execution would merge the cells again.
            keys = ["part", "batch", "cell"]
            return fan_out(left, *keys).groupBy(*keys).cogroup(fan_out(right, *keys).groupBy(*keys)).applyInArrow(
                _score_cell(k, mode == "all", mean or 1.0, arrow), schema)

        return BlockPlan(blocks, score)

    # Tables

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, table: str, batch: int, by: list[str] | None = None) -> None:
        df.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.path}/{table}/batch={batch}")

    def _read(self, table: str, batches: list[int] | None = None) -> DataFrame:
        live = self.batches() if batches is None else batches
        schema = _TABLES[table].format(id=self.id_type)
        if not live:
            return self.spark.createDataFrame([], schema)
        # Committed folders are named, so files of a batch cut short are not even listed.
        folders = [f"{self.path}/{table}/batch={b}" for b in live]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders)


_TABLES = {
    "postings": "bucket int, term string, block int, n int, max_tf int, min_length int, occurrences long, "
                "hits array<struct<doc_id: {id}, tf: int, length: int>>, batch int",
    "terms": "bucket int, term string, df long, cf long, batch int",
    "corpus": "n long, words long, batch int",
}


@dataclass(frozen=True)
class BlockPlan:
    """`blocks`: (query_id, batch, block, bound, least, found, before).

    `score` gives the k best documents of each query in each cell of the chosen blocks.
    """

    blocks: DataFrame
    score: object


def _score_cell(k: int, match_all: bool, mean: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best documents of each query in the blocks it chose in a cell, as matrix products."""

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        lists, blocks = queries.column("terms").combine_chunks(), queries.column("blocks").combine_chunks()
        vocabulary = pc.unique(lists.flatten().field("term"))
        asked = np.zeros((queries.num_rows, len(vocabulary)))
        asked[pc.list_parent_indices(lists).to_numpy(),
              pc.index_in(lists.flatten().field("term"), value_set=vocabulary).to_numpy()] = lists.flatten().field("idf").to_numpy()
        least = queries.column("asked").to_numpy()[:, None]
        # Words only of queries that chose nothing here.
        rows = rows.append_column("at", pc.index_in(rows.column("term"), value_set=vocabulary))
        rows = rows.filter(pc.is_valid(rows.column("at")))
        if not rows.num_rows:
            return schema.empty_table()
        hits = rows.column("hits").combine_chunks()
        row, flat = pc.list_parent_indices(hits).to_numpy(), hits.flatten()
        terms = rows.column("at").to_numpy()[row]
        tf, length = flat.field("tf").to_numpy(), flat.field("length").to_numpy()
        weights = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        # Numbers of documents in id order, so that a stable sort breaks ties by id; null comes first.
        ids = flat.field("doc_id").dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
        position = np.empty(len(order), dtype=np.int64)
        position[order] = np.arange(len(order))
        documents = position[ids.indices.to_numpy()]
        places, place = np.unique(rows.column("block").to_numpy(), return_inverse=True)
        lies_in = np.empty(len(order), dtype=np.int64)
        lies_in[documents] = place[row]
        chosen = np.zeros((queries.num_rows, len(places)), dtype=bool)
        wanted = blocks.flatten().to_numpy()
        held_at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        found = places[held_at] == wanted
        chosen[pc.list_parent_indices(blocks).to_numpy()[found], held_at[found]] = True
        by_document = np.argsort(documents, kind="stable")
        documents, terms, weights = documents[by_document], terms[by_document], weights[by_document]
        best: list[list[tuple]] = [[] for _ in range(queries.num_rows)]
        width = len(vocabulary)
        height = max(1, DENSE_CELLS // width)
        holds = (asked != 0).astype(np.float32)
        for first in range(0, len(order), height):
            low, high = np.searchsorted(documents, [first, first + height])
            many = min(height, len(order) - first)
            at = (documents[low:high] - first) * width + terms[low:high]
            held = np.bincount(at, weights[low:high], many * width).reshape(many, width)
            times = np.bincount(at, minlength=many * width).reshape(many, width).astype(np.float32)
            scores = np.round(asked @ held.T, SCORE_DIGITS)
            matched = holds @ times.T
            fits = (matched == least if match_all else matched > 0) & chosen[:, lies_in[first:first + many]]
            for q in range(queries.num_rows):
                some = np.flatnonzero(fits[q])
                some = some[np.argsort(-scores[q, some], kind="stable")[:k]]
                best[q] += zip((-scores[q, some]).tolist(), (some + first).tolist())
        kept = [(q, d, -score) for q, pairs in enumerate(best) for score, d in sorted(pairs)[:k]]
        if not kept:
            return schema.empty_table()
        at, numbers, scores = zip(*kept)
        return pa.table([queries.column("query_id").take(pa.array(at)).combine_chunks(),
                         ids.dictionary.take(pa.array(order[list(numbers)])), pa.array(scores, pa.float64())], schema=schema)

    return compare
