"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.llm.common import mix, owners, ranges, slices, stash, text_key, word_lists
from tallyweave.llm.language_id import held_out

#: Labelled documents of each label that the model is fitted on, at most: those with the
#: least hash of their id. All other steps cover every document.
SAMPLE = 6000
#: Known words of one sampled document that the fit counts, at most: longer ones give whole
#: sentences up to here, those with the least hash of their number. With SAMPLE this bounds
#: what the driver gets; scores are of all sentences.
FIT_WORDS = 2000
#: Words that the model weighs, at most: those whose presence tells the labels apart best.
VOCABULARY = 2048
#: Lengths of word beginnings that count as features beside the words themselves.
PREFIXES = (4, 5, 6, 7)
_MIN_SENTENCES = 3
_ENDS = r"[.!?\n]+"


def _sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), _ENDS)
    begins = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)))
    return lists.flatten(), begins


def _plain(word: str) -> str:
    """Lower case, without what is no letter or digit at either end."""
    if word.isalnum():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def __post_init__(self) -> None:
        self.table = {w: k for k, w in enumerate(self.weights)}
        self.values = np.array(list(self.weights.values()), float)


def _features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings of PREFIXES letters, marked by ``^``."""
    plain = _plain(word)
    return [plain, *("^" + plain[:n] for n in PREFIXES if len(plain) >= n)] if plain else []


def _coded(words: pa.Array, table: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Position of the word, and number in `table`, of every feature that `table` knows."""
    coded = words.dictionary_encode()
    found = [[table[f] for f in _features(w) if f in table] for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((k for row in found for k in row), np.int64, int(sizes.sum()))
    codes = np.asarray(coded.indices).astype(np.int64)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    counts = sizes[codes]
    return np.repeat(np.arange(len(codes)), counts), flat[ranges((np.cumsum(sizes) - sizes)[codes], counts)]


def sentence_scores(texts: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All sentences, where each text's begin, and each sentence's probability."""
    sentences, begins = _sentences(texts)
    words, word_begins = word_lists(sentences)
    at, which = _coded(words, model.table)
    z = model.bias + np.bincount(owners(word_begins)[at], model.values[which], len(sentences))
    return sentences, begins, 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(y, share, text) of at most `size` documents of each label, chosen by hash of the id.

    A label is the greatest of its id's; share is how many labelled ids one of the sample
    stands for. The ids (2 * size at most) are broadcast, so texts are filtered where they lie.
    An id stands for one document, the text with the least fingerprint, however often it comes.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).where("y in (0, 1)").collect()}
    sample = None
    for y, n in sorted(counts.items()):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumn(
            "share", F.lit(n / min(n, size)))
        sample = part if sample is None else sample.unionByName(part)
    if sample is None:
        return docs.select(F.lit(0).alias("y"), F.lit(1.0).alias("share"), "text").limit(0)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "share").agg(
        F.min_by("text", text_key(F.col("text"))).alias("text"))
    return found.select("y", "share", "text")


def _vocabulary(sample: DataFrame, size: int) -> list[str]:
    """Words that sentences of one label hold markedly more often than the others'.

    Distinct sentences are counted, so that copies of a document are no added evidence; a
    sentence that stands in a clean document is clean.
    """
    found = sample.select("y", F.explode(F.split(F.coalesce("text", F.lit("")), _ENDS, -1)).alias("text")).where(
        F.length(F.trim("text")) > 0).groupBy("text").agg(F.min("y").alias("y"))
    found = stash(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, begins = word_lists(part.column("text"))
            names: dict[str, int] = {}
            for word in words.dictionary_encode().dictionary.to_pylist():
                for feature in _features(word):
                    names.setdefault(feature, len(names))
            if not names:
                continue
            at, codes = _coded(words, names)
            pairs = np.unique(owners(begins)[at] * len(names) + codes)
            y = np.asarray(part.column("y"))[pairs // len(names)]
            n = np.bincount(pairs % len(names), minlength=len(names))
            p = np.bincount(pairs % len(names), y, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(n), pa.array(p.astype(np.int64))], ["word", "n", "p"])

    totals = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        return []
    counts = found.select("y", "text").mapInArrow(run, "word string, n long, p long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p")).where(F.col("n") >= _MIN_SENTENCES)
    rate = F.col("n") / (good + bad)
    z = (F.col("p") / bad - (F.col("n") - F.col("p")) / good) / F.sqrt(
        rate * (1 - rate) * (1 / good + 1 / bad) + 1e-12)
    top = counts.withColumn("z", z).where(F.abs("z") >= 4).orderBy(F.desc(F.abs("z")), "word").limit(size)
    return [r["word"] for r in top.select("word").collect()]


def _fitted(doc: np.ndarray, sentence: np.ndarray, limit: int) -> np.ndarray:
    """Which known words count: whole sentences of each document, by hash, up to `limit` words
    (one sentence at least, of which the first `limit` words)."""
    if not len(doc):
        return np.empty(0, bool)
    order = np.lexsort((np.arange(len(doc)), mix(sentence.astype(np.uint64)), doc))
    d, s = doc[order], sentence[order]
    first = np.concatenate(([True], d[1:] != d[:-1]))
    new = first | np.concatenate(([True], s[1:] != s[:-1]))
    place = np.arange(len(d)) - np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(d))
    run = np.repeat(np.arange(len(begins)), ends - begins)
    whole = (place[ends - 1] < limit)[run] | first[begins][run] & (place < limit)
    kept = np.empty(len(d), bool)
    kept[order] = whole
    return kept


def _bags(sample: DataFrame, words: list[str], limit: int = FIT_WORDS) -> pa.Table:
    """Per document: y, share, the number of its sentences, and (sentence, word) of known words,
    at most `limit` of them; sentences beyond count as not there."""
    table = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sentences, begins = _sentences(part.column("text"))
            found, word_begins = word_lists(sentences)
            at, which = _coded(found, table)
            sentence = owners(word_begins)[at]
            doc = np.searchsorted(begins, sentence, side="right") - 1
            kept = _fitted(doc, sentence - begins[doc], limit)
            left_out = np.setdiff1d(sentence, sentence[kept])
            n = np.diff(begins) - np.bincount(np.searchsorted(begins, left_out, side="right") - 1, minlength=len(begins) - 1)
            sentence, which, doc = sentence[kept], which[kept], doc[kept]
            edges = pa.array(np.searchsorted(doc, np.arange(len(begins))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                part.column("y"), part.column("share"), pa.array(n),
                pa.ListArray.from_arrays(edges, pa.array((sentence - begins[doc]).astype(np.int32))),
                pa.ListArray.from_arrays(edges, pa.array(which.astype(np.int32)))],
                ["y", "share", "n", "sentence", "word"])

    return sample.mapInArrow(run, "y int, share double, n long, sentence array<int>, word array<int>").toArrow()


def _fit(bags: pa.Table, n_words: int, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that make noisy-or over sentences follow the labels (Adam steps)."""
    bags = bags.combine_chunks()
    y, share = np.asarray(bags["y"]).astype(float), np.asarray(bags["share"])
    total = np.asarray(bags["n"])
    counts = np.asarray(pc.list_value_length(bags["word"]))
    doc = np.repeat(np.arange(len(y)), counts)
    word = np.asarray(pc.list_flatten(bags["word"]))
    key = doc * (int(total.max()) + 1) + np.asarray(pc.list_flatten(bags["sentence"]))
    spots, instance = np.unique(key, return_inverse=True)
    owner = spots // (int(total.max()) + 1)
    empty = total - np.bincount(owner, minlength=len(y))
    scale = share / share.sum()
    params = np.zeros(n_words + 1)
    params[-1] = -6.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, bias = params[:-1], params[-1]
        z = np.clip(bias + np.bincount(instance, weights[word], len(spots)), -40, 40)
        p, p_empty = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        clean = np.bincount(owner, np.logaddexp(0, z), len(y)) + empty * np.logaddexp(0, bias)
        clear = np.exp(-clean)
        pull = np.where(y > 0, -clear / np.maximum(1 - clear, 1e-9), 1.0) * scale
        slope = pull[owner] * p
        gradient = np.append(np.bincount(word, slope[instance], n_words) + ridge * weights,
                             slope.sum() + (pull * empty * p_empty).sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        params = params - 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return params[:-1], float(params[-1])


def train(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Fit on a bounded sample of the documents whose id `labels` (doc_id, toxic) holds.

    Without documents of both labels, or words that tell them apart, every text scores 0.
    """
    sample = stash(labelled_sample(docs, labels, sample_size))
    words = _vocabulary(sample, vocabulary)
    if not words:
        return Model()
    weights, bias = _fit(_bags(sample, words), len(words))
    return Model(dict(zip(words, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score, n_offending (sentences of 0.5 or more) and worst_sentence (its
    number from 0); columns of these names are replaced. Null text is one empty sentence."""
    kept = [c for c in docs.columns if c not in ("score", "n_offending", "worst_sentence")]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(plain.schema.fields)).add("score", "double").add("n_offending", "long").add("worst_sentence", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            _, begins, p = sentence_scores(part.column(text_col), model)
            starts = begins[:-1]
            total = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-15)), starts))
            number = np.arange(len(p)) - np.repeat(starts, np.diff(begins))
            best = np.repeat(np.maximum.reduceat(p, starts), np.diff(begins))
            worst = np.minimum.reduceat(np.where(p == best, number, np.iinfo(np.int64).max), starts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.clip(total, 0, 1)), pa.array(np.add.reduceat((p >= 0.5).astype(np.int64), starts)),
                 pa.array(worst)], [*kept, "score", "n_offending", "worst_sentence"])

    return plain.mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(id, sentence_no, sentence, score) of every sentence that scores at least `least`."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sentences, begins, p = sentence_scores(part.column("text"), model)
            at = np.flatnonzero(p >= least)
            owner = owners(begins)[at]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner)), pa.array(at - begins[owner]),
                 sentences.take(pa.array(at)), pa.array(p[at])], ["id", "sentence_no", "sentence", "score"])

    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, sentence_no long, sentence string, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels not held out (remainder 1 of 3); score every document."""
    seen = labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic")
    model = train(docs.select("doc_id", "text"), seen)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_offending", "worst_sentence")
