"""Personal data: labelers vote on spans, EM weighs them, a classifier decides. Columns only.

Four kinds of spans are looked for. The base rule of each kind always counts. Stretches that
look alike but break the rule (two numbers run together, an address written with "(at)", a
number without its plus sign) are candidates: regular expressions, gazetteers and context
labelers vote on every candidate and every base span; the votes are counted over the whole
corpus; expectation-maximisation turns the counts into reliabilities and beliefs; and a
logistic classifier fitted on those beliefs judges the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stash

#: Order of the kinds in every result.
KINDS = ["email", "ip", "card", "phone"]

# The base rules. Possessive, and begun only where a run of letters or digits
# begins (or the last match ended), so that a text without blanks costs linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Stretches that may be personal though they break the base rule of their kind.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:@| ?[(\[](?:at|AT)[)\]] ?)[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
          r"|(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])"
            r"|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"\+?(?<![0-9])[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])"
             r"|(?<![0-9])(?:\+|00)[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Candidates are cut out in this order, so that each stretch is one of a single kind.
_ORDER = ["email", "ip", "phone", "card"]
#: Stands for a character that a span has taken; fits no pattern.
_TAKEN = ""
#: Code points of context that labelers see.
_BEFORE, _AFTER = 32, 8
#: Positions are summed in blocks of 2^7 matches.
_BLOCK_BITS = 7

# Gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|[a-z]{2}"
ISSUERS = "4|5[1-5]|2[2-7]|34|37|6011|64[4-9]|65|30[0-5]|36|38|39|35"
CALLING_CODES = ("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|"
                 "26[0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-6]|88[0-6]|96[0-8]|97[0-9]|99[2-8]")
CUES = {
    "email": "e-?mail|mail|contact|write to|reach|schreib|courriel|correo",
    "ip": r"\bip\b|address|host|server|client|from|login|adresse|direcci",
    "card": "card|credit|visa|master|amex|carte|karte|tarjeta|payment|cc",
    "phone": r"phone|tel|call|mobile|fax|cell|whatsapp|ruf|móvil|teléfono",
}
ANTI_CUES = (r"token|hash|sha|md5|uuid|key|version|\bv\b|release|isbn|issn|doi|sku|order|invoice|section|chapter|"
             r"build|password|[=#§]\s*[\x22\x27]?$")


# Expressions are written as SQL text: some thousand nodes are parsed at once instead of being
# put together call by call.
def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is evaluated a single time."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _re(pattern: str) -> str:
    return f"r'{pattern}'"


def _prefix_sums(sizes: str) -> str:
    """Running sums of an int array; block by block, as one lambda per element would be quadratic."""
    width = 1 << _BLOCK_BITS
    blocks = (f"transform(sequence(0, shiftright(size(x), {_BLOCK_BITS})), b -> "
              f"aggregate(slice(x, b * {width} + 1, {width}), 0, (a, v) -> a + v))")
    heads = _let("s", blocks, "transform(s, (v, b) -> aggregate(slice(s, 1, b), 0, (a, v) -> a + v))")
    own = f"slice(x, shiftleft(shiftright(i, {_BLOCK_BITS}), {_BLOCK_BITS}) + 1, (i & {width - 1}) + 1)"
    ends = f"transform(x, (v, i) -> get(h, shiftright(i, {_BLOCK_BITS})) + aggregate({own}, 0, (a, v) -> a + v))"
    return _let("x", sizes, _let("h", heads, ends))


def _scan(text: str, pattern: str, valid: str) -> str:
    """struct(spans, masked): valid matches with places and context, and the text without them.

    Places are code points, the end is exclusive. They come from the lengths of the matches and
    of the gaps between them, as regular expressions give no places. `valid` tests `hit`.
    """
    sizes = "transform(hits, (hit, i) -> length(get(gaps, i)) + length(hit))"
    spans = _let("ends", _prefix_sums(sizes), (
        "transform(hits, (hit, i) -> named_struct('start', get(ends, i) - length(hit), 'end', get(ends, i), "
        f"'valid', {valid}, 'hit', hit, 'before', right(get(gaps, i), {_BEFORE}), 'after', left(get(gaps, i + 1), {_AFTER})))"))
    masked = (f"array_join(transform(gaps, (g, i) -> concat(g, CASE WHEN i >= size(s) THEN '' WHEN get(s, i).valid "
              f"THEN repeat('{_TAKEN}', length(get(s, i).hit)) ELSE get(s, i).hit END)), '')")
    both = _let("s", spans, f"named_struct('spans', filter(s, y -> y.valid), 'masked', {masked})")
    return _let("hits", f"regexp_extract_all({text}, {_re(pattern)}, 0)",
                _let("gaps", f"split({text}, {_re(pattern)}, -1)", both))


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def _luhn(hit: str) -> str:
    value = _let("v", "cast(substr(d, length(d) - i + 1, 1) AS int)",
                 "if(i % 2 = 1, v, 2 * v - if(v > 4, 9, 0))")
    total = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + {value}) % 10 = 0"
    return _let("d", _digits(hit), f"if(length(d) BETWEEN 13 AND 19, {total}, false)")


VALID = {"email": "true", "ip": f"rlike(hit, {_re(IP_OK)})", "card": _luhn("hit"),
         "phone": f"length({_digits('hit')}) BETWEEN 9 AND 15"}


def _like(text: str, pattern: str) -> str:
    return f"rlike({text}, {_re(pattern)})"


def _vote(yes: str, no: str = "true") -> str:
    """1 for, 0 against, -1 abstains; without `no` whatever is not for is against."""
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN 0 ELSE -1 END"


@dataclass(frozen=True)
class Labeler:
    """A voter: its vote by kind (SQL over the span `c`: hit, before, after, base), and how
    often it is expected to say yes to true and to other spans."""

    name: str
    vote: dict[str, str]
    true_yes: float
    false_yes: float


_EDGE = r"[A-Za-z0-9_\x22\x27=/"
LABELERS = [
    Labeler("pattern", dict.fromkeys(KINDS, _vote("c.base", "false")), 0.95, 0.2),
    Labeler("checksum", {
        "email": _vote(_like("c.hit", r"[A-Za-z0-9-]+[.)\] ]+[A-Za-z]{2,}$")),
        "ip": _vote(f"contains(c.hit, ':') OR {_like('translate(c.hit, ' + repr('[]') + ', ' + repr('') + ')', IP_OK)}"),
        "card": _vote(_luhn("c.hit")),
        "phone": _vote(f"length({_digits('c.hit')}) BETWEEN 9 AND 15")}, 0.98, 0.1),
    Labeler("shape", {
        "email": _vote(_like("c.hit", r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")),
        "ip": _vote(f"NOT {_like('c.hit', r'^(?:0[0-9]|[0-9][.][0-9][.][0-9][.])')}"),
        "card": _vote(_like("c.hit", r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$")),
        "phone": _vote(_like("c.hit", r"^(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}$"))}, 0.9, 0.4),
    Labeler("gazetteer", {
        "email": _vote(_like("lower(c.hit)", rf"[.)\] ](?:{DOMAINS})$")),
        "ip": _vote(f"NOT {_like('c.hit', r'^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]')}"),
        "card": _vote(_like(_digits("c.hit"), f"^(?:{ISSUERS})")),
        "phone": _vote(_like("c.hit", rf"^(?:\+|00)(?:{CALLING_CODES})"), _like("c.hit", r"^(?:\+|00)"))}, 0.9, 0.3),
    Labeler("cue", {k: _vote(f"{_like('lower(c.before)', CUES[k])} AND NOT {_like('lower(c.before)', ANTI_CUES)}",
                             _like("lower(c.before)", ANTI_CUES)) for k in KINDS}, 0.9, 0.2),
    Labeler("edges", dict.fromkeys(KINDS, _vote(f"NOT {_like('c.before', _EDGE + '#:]$')} AND NOT {_like('c.after', '^' + _EDGE + ']')}")),
            0.9, 0.4),
]

#: What the classifier sees of a span besides the votes: 0 or 1 each.
FEATURES = [_like("c.hit", "[ ().-]"), "length(c.hit) > 20", _like("c.before", r"[.,;:!?|]\s*$"),
            "length(c.before) = 0", _like("c.after", r"^[.,;:!?|\s]|^$")]


def _voted(kind: str, base: str, more: list[str]) -> str:
    """array<struct(kind, start, end, base, hit, votes, features)>: base spans, and others at other places."""
    def tagged(spans: str, rank: int) -> str:
        return (f"transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'rank', {rank}, 'hit', x.hit, "
                "'before', x.before, 'after', x.after))")

    ordered = f"array_sort(concat({', '.join([tagged(base, 0), *(tagged(m, 1) for m in more)])}))"
    fresh = _let("o", ordered, "filter(o, (x, i) -> coalesce(x.start <> get(o, i - 1).start OR x.end <> get(o, i - 1).end, true))")
    seen = "named_struct('hit', x.hit, 'before', x.before, 'after', x.after, 'base', x.rank = 0)"
    votes, features = ", ".join(v.vote[kind] for v in LABELERS), ", ".join(f"cast({f} AS int)" for f in FEATURES)
    row = _let("c", seen, (f"named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'base', c.base, "
                           f"'hit', c.hit, 'votes', array({votes}), 'features', array({features}))"))
    return f"transform({fresh}, x -> {row})"


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): base spans and candidates of every row, with the votes on them.

    Candidates are sought in what accepted spans leave, in the order email, ip, phone, card:
    first by the base rules again (which now meet no neighbour that ran into the span), then
    by the loose patterns. One narrow pass; texts without digits, "@" or "(at)" end at once.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("rest"))
    rows = rows.withColumn("rest", F.expr(f"CASE WHEN {_like('rest', r'[0-9@]|[(' + chr(92) + r'[](?:at|AT)[)' + chr(92) + ']]')} THEN rest END"))
    rows = rows.select("*", *(F.expr(_scan("rest", BASE[k], VALID[k]) + ".spans").alias(f"base_{k}") for k in KINDS))
    for name, patterns, valid in (("again", BASE, VALID), ("loose", LOOSE, dict.fromkeys(KINDS, "true"))):
        for kind in _ORDER:
            rows = rows.withColumn("found", F.expr(_scan("rest", patterns[kind], valid[kind])))
            rows = rows.withColumns({f"{name}_{kind}": F.col("found.spans"), "rest": F.col("found.masked")})
    voted = [_voted(k, f"base_{k}", [f"again_{k}", f"loose_{k}"]) for k in KINDS]
    return rows.select("id", F.expr(f"coalesce(concat({', '.join(voted)}), array())").alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """By kind: reliability of each labeler as (yes to true, yes to false), share of true spans,
    and the weights of the classifier (intercept, votes for, votes against, features)."""

    reliability: dict[int, np.ndarray]
    share: dict[int, float]
    weights: dict[int, np.ndarray]


def vote_counts(found: DataFrame) -> list[tuple[int, list[int], list[int], int]]:
    """(kind, votes, features, spans) over all rows: combinable counts. The driver gets at most
    4 * 3^6 * 2^5 rows, a bound of labelers and features and not of the corpus."""
    spans = found.select(F.explode("spans").alias("s"))
    counts = spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"),
                           F.col("s.features").alias("features")).agg(F.count("*").alias("n"))
    return sorted((r["kind"], list(r["votes"]), list(r["features"]), r["n"]) for r in counts.collect())


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 50, prior: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (belief of each pattern, reliabilities (labeler, false/true), share).

    `votes` holds 1, 0 or -1 for each pattern and labeler, `n` how many spans have the pattern.
    Abstentions say nothing. Priors of the labelers weigh as `prior` of their votes and ten
    more, so that a corpus of only true spans does not turn the two classes around.
    """
    start = np.array([[v.false_yes, v.true_yes] for v in LABELERS])
    yes, no, share = (votes == 1).astype(float), (votes == 0).astype(float), 0.5
    rates, belief = start, np.full(len(n), 0.5)
    weight = 10 + prior * ((yes + no) * n[:, None]).sum(axis=0)
    for _ in range(rounds):
        log = yes @ np.log(rates) + no @ np.log(1 - rates) + np.log([1 - share, share])
        belief = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        share = float((n @ belief + 5 + prior * n.sum() / 2) / (n.sum() * (1 + prior) + 10))
        rates = np.stack([(m @ yes + weight * start[:, c]) / (m @ (yes + no) + weight)
                          for c, m in enumerate((n * (1 - belief), n * belief))], axis=1)
    return belief, rates, share


def _inputs(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Columns of the classifier. The base rule's own vote is left out: it would be the answer."""
    seen = votes[:, 1:]
    return np.concatenate([np.ones((len(votes), 1)), seen == 1, seen == 0, features], axis=1).astype(float)


def _logistic(x: np.ndarray, belief: np.ndarray, n: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights that fit beliefs of counted rows, by Newton steps; the ridge follows the counts."""
    w, total = np.zeros(x.shape[1]), n.sum()
    target = np.clip(belief, 1e-3, 1 - 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (target - p)) - ridge * total * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * total * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
    return w


def fit(counts: list[tuple[int, list[int], list[int], int]]) -> SpanModel:
    """Reliabilities by EM and the classifier, per kind, from the counts of `vote_counts`."""
    model = SpanModel({}, {}, {})
    for kind in sorted({c[0] for c in counts}):
        own = [c for c in counts if c[0] == kind]
        votes, features = np.array([c[1] for c in own]), np.array([c[2] for c in own])
        n = np.array([c[3] for c in own], float)
        belief, model.reliability[kind], model.share[kind] = estimate(votes, n)
        model.weights[kind] = _logistic(_inputs(votes, features), belief, n)
    return model


def _probability(model: SpanModel, s: Column) -> Column:
    out = F.lit(0.0)
    for kind, w in model.weights.items():
        votes = [F.get(s["votes"], F.lit(i)) for i in range(1, len(LABELERS))]
        parts = [F.when(v == 1, float(w[1 + i])).when(v == 0, float(w[len(LABELERS) + i])).otherwise(0.0)
                 for i, v in enumerate(votes)]
        parts += [F.get(s["features"], F.lit(i)) * float(x) for i, x in enumerate(w[2 * len(LABELERS) - 1:])]
        logit = sum(parts, F.lit(float(w[0])))
        out = F.when(s["kind"] == kind, 1 / (1 + F.exp(-logit))).otherwise(out)
    return out


def find_personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, spans array<struct(kind, start, end, base, text, probability)>.

    Spans stand in the order of KINDS, then by place (code points, end exclusive). A span of
    the base rule (base true) is always there, whatever its probability; a candidate is there
    if the classifier gives it at least `threshold`. Null and empty texts have no spans, null
    ids stay, repeated rows are answered each, other columns are not looked at. Spans of
    different kinds may overlap where both are base spans.

    The text is read once, in a narrow pass whose output (spans only) is written; counting
    the votes and judging the spans read that. Nothing is joined or grouped by document.
    """
    found = stash(candidate_spans(docs, id_col, text_col))
    model = fit(vote_counts(found))

    def judged(s: Column) -> Column:
        return F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"),
                        s["end"].alias("end"), s["base"].alias("base"), s["hit"].alias("text"),
                        _probability(model, s).alias("probability"))

    spans = F.filter(F.transform("spans", judged), lambda s: s["base"] | (s["probability"] >= threshold))
    return found.select("id", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_query(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS),
                        F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
