"""What several operators of this package share: words, byte-bounded slices, written tables.

Conventions of the package
--------------------------
* A document is the pair (doc_id, text). Rows that repeat the pair are copies of one
  document: the work is done once and every such row gets the same answer.
* Null text is an empty text unless a docstring says otherwise; null ids order last.
* Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import ensure_checkpoint_dir

#: Text is handled in slices of about this many bytes, so that memory does not follow
#: the size of an Arrow batch. A longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_key(text: Column) -> Column:
    """64-bit fingerprint of a text, to tell rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(batches: Iterable[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `limit` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_array(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of `texts` one after another, and where each text's words begin (n + 1)."""
    texts = pc.fill_null(flat_array(texts), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    begins = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)))
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
        words, begins = words.filter(pa.array(full)), kept[begins]
    return words, begins


def string_hash(strings: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of a (small, distinct) string array, equal on every machine."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s, salt) for s in strings.cast(pa.binary()).to_pylist()),
                       np.uint64, len(strings))


def word_hashes(texts: pa.Array, lower: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and where each text's words begin."""
    words, begins = word_lists(texts, lower)
    coded = words.dictionary_encode()
    if not len(words):
        return np.empty(0, np.uint64), begins
    return string_hash(coded.dictionary, salt)[np.asarray(coded.indices)], begins


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of the `width` words that start at each position (positions run to the end)."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, np.uint64(salt * 2 + 1))
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def owners(begins: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] numbers) for all i, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)
