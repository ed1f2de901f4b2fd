"""Language ID by rank-order profiles: out-of-place distance of frequent letter n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyweave.llm.common import slices, stash

#: Ranks kept of a language and of a document.
PROFILE = 300
#: Languages whose profiles a task holds at a time, and those a matrix of ranks covers.
LANGUAGES, MATRIX = 1000, 100
UNKNOWN = "und"
#: A text is foreign below MARGIN times the score that all but a share LOW of the labelled
#: documents reach. Their beginnings of so many characters show what short texts score; these
#: scatter, so under SHORT n-grams (a power of two) all but a share LOW_SHORT must reach it.
LOW, LOW_SHORT, SHORT = 0.01, 0.001, 64
MARGIN, BEGINNINGS = 0.75, (2, 4, 8, 16, 32, 64, 128)
#: Score steps of the histograms that the quantiles come from.
_STEPS = 1000
_FLUSH = 2_000_000
_LEVELS = 8
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    return _letters


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters as 16-bit codes with 32 for all else, a 32 before and after every
    text, and where each text begins. Letters beyond 16 bits share the code 0xFFFF."""
    lowered = [(t or "").lower() for t in texts]
    begins = np.cumsum([0] + [len(t) + 1 for t in lowered])
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, where = np.unique(points[far], return_inverse=True)
        letter = letter.copy()
        letter[far] = np.fromiter((chr(int(p)).isalpha() for p in kinds), bool, len(kinds))[where]
    return np.where(letter, np.minimum(points, 0xFFFF), 32).astype(np.int64), begins


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of two and three symbols, and where each begins. A blank stands
    only at the edge of a gram, where it marks the edge of a word."""
    pairs = codes[:-1] << 16 | codes[1:]
    two = np.flatnonzero(pairs != (32 << 16 | 32))
    three = np.flatnonzero(codes[1:-1] != 32)
    return (np.concatenate((pairs[two], pairs[three] << 16 | codes[three + 2])),
            np.concatenate((two, three)))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) partial counts of every n-gram of every row of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                    ["lang", "gram", "n"])
            held.clear()

        for part in slices(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams = np.sort(_grams(_symbols(texts)[0])[0])
                if not len(grams):
                    continue
                first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                new = grams[first], np.diff(np.concatenate((first, [len(grams)]))).astype(np.int64)
                if lang in held:
                    new = _merged(np.concatenate((held[lang][0], new[0])), np.concatenate((held[lang][1], new[1])))
                held[lang] = new
            if sum(len(k) for k, _ in held.values()) > _FLUSH:
                yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "lang string, gram long, n long")


def _totals(train: DataFrame) -> DataFrame:
    counts = gram_counts(train.where("lang is not null and text is not null").select("lang", "text"))
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _most_frequent(totals: DataFrame, size: int, *part: str) -> DataFrame:
    """(part, lang, rank, gram), written: the `size` most frequent n-grams, ranks from 0."""
    order = Window.partitionBy(*part, "lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return stash(ranked.select(*part, "lang", "rank", "gram"))


def profile_table(train: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram): the `size` most frequent n-grams of each language, ties by code.

    Counts cover every row of `train` (lang, text); rows without a lang or text are passed
    over. Any number of languages may come.
    """
    return _most_frequent(_totals(train), size)


def profile_blocks(table: DataFrame, languages: int = LANGUAGES) -> Iterator[dict[str, list[int]]]:
    """The profiles of a profile table in blocks of languages, by name."""
    rest = table
    while True:
        names = [r[0] for r in rest.select("lang").distinct().orderBy("lang").limit(languages).collect()]
        if not names:
            return
        found: dict[str, list[int]] = {lang: [] for lang in names}
        for row in sorted(rest.where(F.col("lang") <= names[-1]).select("lang", "rank", "gram").collect()):
            found[row["lang"]].append(row["gram"])
        yield found
        if len(names) < languages:
            return
        rest = table.where(F.col("lang") > names[-1])


def language_profiles(train: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The profiles of a label set known to be small, most frequent n-gram first."""
    return {lang: grams for block in profile_blocks(profile_table(train, size)) for lang, grams in block.items()}


class _Scorer:
    """Distances of texts to all profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs = sorted(profiles)
        self.size = size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language and score of each text, and how many n-grams the score rests on."""
        n = len(texts)
        names, scores, used = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
        codes, begins = _symbols(texts)
        grams, at = _grams(codes)
        if not len(grams) or not self.langs:
            return names, scores, used
        owner = np.searchsorted(begins, at, side="right") - 1
        order = np.sort(owner << 48 | grams)
        first = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        counts = np.diff(np.concatenate((first, [len(order)])))
        keys = order[first]
        owner, grams = keys >> 48, keys & ((1 << 48) - 1)
        by = np.lexsort((grams, -counts, owner))
        owner, grams = owner[by], grams[by]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(owner)]))))
        top = rank < self.size
        owner, grams, rank = owner[top], grams[top], rank[top]
        spot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        spot = np.where(self.grams[spot] == grams, spot, len(self.grams))
        place = self.ranks[spot]
        cost = np.where(place < 0, self.size, np.abs(place - rank[:, None]))
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        distance = np.add.reduceat(cost, starts, axis=0)
        best = distance.argmin(axis=1)
        used[owner[starts]] = np.diff(np.concatenate((starts, [len(owner)])))
        worst = used[owner[starts]] * self.size
        value = 1 - distance[np.arange(len(starts)), best] / worst
        scores[owner[starts]] = value
        for doc, lang in zip(owner[starts], best, strict=True):
            names[doc] = self.langs[lang]
        return names, scores, used


_JUDGED = "struct<lang: array<string>, score: array<double>, level: array<long>, known: array<boolean>>"


def _judge(profiles: dict[str, list[int]], least: dict[str, dict[int, float]], size: int,
           text_col: str, cuts: tuple, spot: str, before: bool, kept: list[str]):
    """The task that judges texts, each cut to all of `cuts`, by one block of languages. What
    an earlier block found (`before`) stays where this one is not better."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(profiles)
        scorers = [_Scorer({k: profiles[k] for k in names[i:i + MATRIX]}, size)
                   for i in range(0, max(1, len(names)), MATRIX)]
        for part in slices(batches, text_col):
            n, width = part.num_rows, len(cuts)
            langs = np.full((n, width), UNKNOWN, object)
            scores, levels, known = np.zeros((n, width)), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
            if before:
                old = part.column(spot)
                langs = np.array(old.field("lang").flatten().to_pylist(), object).reshape(n, width)
                scores, levels, known = (
                    np.array(old.field(f).flatten().to_numpy(zero_copy_only=False)).reshape(n, width)
                    for f in ("score", "level", "known"))
            texts = part.column(text_col).to_pylist()
            for k, cut in enumerate(cuts):
                cut_texts = texts if cut is None else [t and t[:cut] for t in texts]
                for j, scorer in enumerate(scorers):
                    new_langs, new_scores, used = scorer.judged(cut_texts)
                    levels[:, k] = _level(used)
                    first = not before and not j
                    for i in np.flatnonzero((used > 0) & (first | (new_scores > scores[:, k]))).tolist():
                        langs[i, k], scores[i, k] = new_langs[i], new_scores[i]
                        known[i, k] = scores[i, k] >= least.get(new_langs[i], {}).get(int(levels[i, k]), 0.0)
            at = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            lists = [pa.ListArray.from_arrays(at, pa.array(v.reshape(-1), t)) for v, t in (
                (langs, pa.string()), (scores, pa.float64()), (levels, pa.int64()), (known, pa.bool_()))]
            found = pa.StructArray.from_arrays(lists, ["lang", "score", "level", "known"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], [*kept, spot])

    return run


def _judged(docs: DataFrame, profiles: dict[str, list[int]] | DataFrame, size: int, text_col: str,
            cuts: tuple = (None,), least: DataFrame | None = None) -> tuple[DataFrame, str]:
    """`docs` with one more column, named second: per cut the best language, its score, the
    level of n-grams and whether the score reaches `least` (lang, level, least).

    Languages come in blocks of LANGUAGES; between blocks what was found is written, so tasks
    and driver hold one block and the last one costs no more than an only one.
    """
    spot = "_judged"
    while spot.lower() in {c.lower() for c in docs.columns}:
        spot += "_"
    schema = StructType(list(docs.schema.fields)).add(spot, _parse_datatype_string(_JUDGED))
    out, before = docs, False
    for block in [profiles] if isinstance(profiles, dict) else profile_blocks(profiles):
        floors: dict[str, dict[int, float]] = {}
        if least is not None:
            for row in least.where(F.col("lang").between(min(block), max(block))).collect():
                floors.setdefault(row["lang"], {})[row["level"]] = row["least"]
        out = (stash(out) if before else out).mapInArrow(
            _judge(block, floors, size, text_col, cuts, spot, before, docs.columns), schema)
        before = True
    if not before:
        out = docs.mapInArrow(_judge({}, {}, size, text_col, cuts, spot, False, docs.columns), schema)
    return out, spot


def predict_language(docs: DataFrame, profiles: dict[str, list[int]] | DataFrame, size: int = PROFILE,
                     text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with two columns `names` (replaced if there); only the text is looked at.

    `profiles` is a dict, or a profile table of any number of languages. The score is 1 less
    the out-of-place distance over the largest one possible. Texts that are null or hold no
    letter, and all texts if nothing was learned, get `und` and 0. Ties go to the first
    language by name. Whole texts are read.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    out, spot = _judged(docs.select(*kept), profiles, size, text_col)
    return out.select(*kept, F.col(spot)["lang"][0].alias(names[0]), F.col(spot)["score"][0].alias(names[1]))


def held_out(doc_id, parts: int, part: int):
    """True for ids whose crc32 (as text) falls in `part` of `parts`; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from the documents not held out (remainder 2 of 4) and predict all of them."""
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select("lang", "text")
    out = predict_language(docs.select("doc_id", "text"), profile_table(train))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def _level(used: np.ndarray) -> np.ndarray:
    """Doublings of the number of n-grams; a full profile and more is one level."""
    return np.floor(np.log2(np.maximum(1, np.minimum(used, 1 << _LEVELS)))).astype(np.int64)


def least_scores(labelled: DataFrame, halves: list[DataFrame], min_score: float = 0.1) -> DataFrame:
    """(lang, level, least): per language and level of n-grams the score under which a text is
    foreign, never under `min_score`.

    Each row of `labelled` (lang, half, text) is scored by the profiles of the other half, so
    that no text is measured by itself. Rows found to be of their own language count, and so do
    their beginnings, which stand for short texts. A level never asks for more than the whole
    documents of its language reach. A language that gives nothing to measure has `min_score`.
    """
    whole, found = -1, []
    for half, table in enumerate(halves):
        judged, spot = _judged(labelled.where(F.col("half") != half), table, PROFILE, "text", (None, *BEGINNINGS))
        best = F.col(spot)
        found.append(judged.select(
            "lang", F.posexplode(F.arrays_zip(best["lang"].alias("lang"), best["score"].alias("score"),
                                              best["level"].alias("level")))))
    own = found[0].unionByName(found[1]).where(F.col("col.lang") == F.col("lang"))
    steps = own.select(
        "lang", F.floor(F.col("col.score") * _STEPS).alias("step"),
        F.explode(F.when(F.col("pos") == 0, F.array("col.level", F.lit(whole).cast("long")))
                  .otherwise(F.array("col.level"))).alias("level"),
    ).groupBy("lang", "level", "step").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("lang", "level")
    reached = steps.withColumn("below", F.sum("n").over(each.orderBy("step"))).withColumn(
        "all", F.sum("n").over(each)).where(F.col("below") > F.col("all") * F.when(
            F.col("level").between(0, int(np.log2(SHORT)) - 1), LOW_SHORT).otherwise(LOW))
    least = reached.groupBy("lang", "level").agg((MARGIN * F.min("step") / _STEPS).alias("least"))
    all_of = least.where(F.col("level") == whole).select("lang", F.col("least").alias("whole"))
    levels = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_LEVELS).cast("long"))).alias("level")
    every = halves[0].select("lang").unionByName(halves[1].select("lang")).distinct().select("lang", levels)
    return stash(
        every.join(least.where(F.col("level") != whole).join(all_of, "lang"), ["lang", "level"], "left")
        .select("lang", "level", F.greatest(F.lit(min_score), F.least("least", "whole")).alias("least")))


def drop_foreign(docs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """The documents whose language is known: `und` and scores under the language's go.

    Profiles and the least score of each language (`least_scores`, never under `min_score`) are
    learned from all labelled rows of `docs` itself. A language whose labelled texts are all
    alike gives nothing to measure and asks for `min_score` alone. Where no row is labelled
    nothing can be told apart, and only texts without a letter go. Columns stay as they are.
    """
    labelled = docs.where("lang is not null and text is not null").select(
        "lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    halved = _totals(labelled.select(F.concat(F.col("half").cast("string"), F.col("lang")).alias("lang"), "text"))
    plain = stash(halved).select(F.substring("lang", 1, 1).alias("part"), F.expr("substr(lang, 2)").alias("lang"),
                                 "gram", "n")
    both = plain.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.lit("all"))
    tables = _most_frequent(plain.unionByName(both), PROFILE, "part")
    profiles = tables.where("part = 'all'")
    if profiles.isEmpty():
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    least = least_scores(labelled, [tables.where(F.col("part") == h) for h in "01"], min_score)
    out, spot = _judged(docs, profiles, PROFILE, "text", least=least)
    known = (F.col(spot)["lang"][0] != UNKNOWN) & F.col(spot)["known"][0] & (F.col(spot)["score"][0] >= min_score)
    return out.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])
