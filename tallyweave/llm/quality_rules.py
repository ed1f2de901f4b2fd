"""Quality rules: per-document rules, and host verdicts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import owners, slices, stash, string_hash, window_hashes, word_lists

METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[begins])


def _repeat_words(words: pa.Array, begins: np.ndarray) -> np.ndarray:
    """Words per text that stand in a window found twice or more in that text."""
    if len(words) < WINDOW:
        return np.zeros(len(begins) - 1, np.int64)
    coded = words.dictionary_encode()
    hashes = string_hash(coded.dictionary)[np.asarray(coded.indices)]
    owner = owners(begins)
    at = np.flatnonzero(owner[:-(WINDOW - 1)] == owner[WINDOW - 1:])
    keys = window_hashes(hashes, WINDOW)[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(begins) - 1, np.int64)
    found = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, at[found], 1)
    np.add.at(steps, at[found] + WINDOW, -1)
    return _sums(np.cumsum(steps[:-1]) > 0, begins)


def _line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line, per text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    full = np.asarray(pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]"))
    codes = np.asarray(lines.dictionary_encode().indices).astype(np.int64)[full]
    owner = owner[full]
    distinct = np.unique(owner * (len(lines) + 1) + codes) // (len(lines) + 1)
    n = np.bincount(owner, minlength=len(lists))
    return n, n - np.bincount(distinct, minlength=len(lists))


def text_metrics(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts, "")
    words, begins = word_lists(texts)
    table = np.zeros(256, bool)
    table[list(SYMBOLS.encode())] = True
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    raw = np.frombuffer(pc.binary_join(pa.array([texts.cast(pa.binary()).to_pylist()]), b"")[0].as_py(), np.uint8)
    n_lines, n_dup = _line_counts(texts)
    return {
        "n_words": np.diff(begins),
        "word_chars": _sums(np.asarray(pc.utf8_length(words)), begins),
        "n_symbols": _sums(table[raw], np.concatenate(([0], np.cumsum(sizes)))),
        "n_lines": n_lines, "n_dup_lines": n_dup,
        "n_repeat_words": _repeat_words(words, begins)}


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source") -> DataFrame:
    """(id, host) and the counts of METRICS per row, in one narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = text_metrics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("host"), *(pa.array(found[m].astype(np.int64)) for m in METRICS)],
                ["id", "host", *METRICS])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"),
                         F.col(text_col).cast("string").alias("text"))
    kinds = dict(narrow.dtypes)
    schema = ", ".join([f"id {kinds['id']}", f"host {kinds['host']}", *(f"{m} long" for m in METRICS)])
    return narrow.mapInArrow(run, schema)


def rule_failures() -> dict[str, Column]:
    """The rules of one document; 1 where it fails."""
    return {
        "short": F.col("n_words") < 20,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30}


def host_rates(metrics: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(host, n_docs, rate_<rule>...): failure rates shrunk by an empirical beta prior.

    Per rule, mean and spread of the hosts' rates give the prior Beta(a, b) by moments
    (spread less what sampling alone would show; a + b kept within 1 and 1000). A host with
    n documents and f failures gets (f + a) / (n + a + b). Null hosts are left out. The
    counts per host are combinable sums, so a hot host costs one row per task; the driver
    sees a handful of sums per rule.
    """
    rules = rules or rule_failures()
    hosts = metrics.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules.items()))
    sums = hosts.agg(
        F.count("*").alias("k"), F.sum("n_docs").alias("n"),
        *(F.sum(f"f_{r}").alias(f"s_{r}") for r in rules),
        *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in rules)).first()
    columns = []
    for rule in rules:
        n = float(sums["n"] or 1)
        mean = min(max((sums[f"s_{rule}"] or 0) / n, 1e-9), 1 - 1e-9)
        noise = mean * (1 - mean)
        spread = (sums[f"q_{rule}"] or 0.0) / n - mean * mean - noise * (sums["k"] or 0) / n
        strength = min(max(noise / max(spread, 1e-12) - 1, 1.0), 1000.0)
        columns.append(((F.col(f"f_{rule}") + mean * strength) / (F.col("n_docs") + strength)).alias(f"rate_{rule}"))
    return hosts.select("host", "n_docs", *columns)


def judge_quality(docs: DataFrame, max_rate: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, host, METRICS, base_failed, host_failed, kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
    host_failed: for some rule the host's shrunken failure rate exceeds `max_rate`.
    A document is kept when neither holds. A null text has no words and fails; a null host
    never fails; repeated rows are judged each. Host verdicts are joined back without a hint,
    so many hosts mean a shuffle join whose hot host adaptive execution may split.
    """
    metrics = stash(quality_metrics(docs, id_col, text_col, host_col))
    rules = rule_failures()
    rates = host_rates(metrics, rules)
    bad = rates.where(F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > max_rate).select(
        F.col("host").alias("bad_host"))
    joined = metrics.join(bad, F.col("host") == F.col("bad_host"), "left")
    failed = rules["short"] | rules["repeats"]
    return joined.select("id", "host", *METRICS, failed.alias("base_failed"),
                         F.col("bad_host").isNotNull().alias("host_failed"),
                         (~failed & F.col("bad_host").isNull()).alias("kept"))


def quality_query(docs: DataFrame) -> DataFrame:
    out = judge_quality(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "host_failed")
