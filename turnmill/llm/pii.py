"""Personal data by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.scratch import materialise
from turnmill.llm.spans import SPAN, listed, match_spans, overlaps

# The base patterns.  Possessive repeats, and starts held to the
# beginning of a run (or the end of the last match), find the same matches in
# time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A card's base match is a whole run of digits, so only whole runs of 13 to 19 are matched: a text may hold very many shorter ones.
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Texts without these characters have no match, so that most aren't walked by the pattern.
SIGNS = {EMAIL: ("@",), IP: (".",), PHONE: ("+",)}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Wider candidates, whose spans only the trained classifier adds.
WIDER = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?=[(0-9])(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?=\p{Lu})(?<![\p{L}\p{N}])(?!(?:Mr|Mrs|Ms|Dr|Prof|Dear|Herr|Frau|Madame|Monsieur|Contact|From)\x20)\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++(?![\p{L}\p{N}])",
    "address": r"(?=[0-9])(?<![\p{L}\p{N}.,-])[0-9]{1,5}\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){1,2}(?![\p{L}\p{N}])",
}
SIGNS[WIDER["email"]] = ("at)", "at]")
_ORDER = (*KINDS, "ssn", "name", "address")

# Gazetteers and cue words of the labelers.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu"
GIVEN_NAMES = """
Adam Alan Alice Amir Amy Ana Anders Andrea Andrew Anita Anna Anne Antonio Barbara Beatriz Ben Boris Brian Carla Carlos Carmen Caroline Charles Chen Chloe
Chris Christine Claire Clara Daniel David Diana Diego Dmitri Edward Elena Elizabeth Emily Emma Erik Eva Fatima Felix Fiona Francesca Frank Gabriel George
Grace Hanna Hans Hassan Helen Henry Hiroshi Ibrahim Ingrid Irene Isabel Ivan Jack James Jan Jane Javier Jean Jennifer Jessica Joan John Jorge Jose Joseph
Juan Julia Karen Karl Kate Katherine Kenji Kevin Klaus Laura Lena Leo Linda Louis Lucas Lucia Luis Magda Marco Maria Marie Mark Martin Mary Matthew Mei
Michael Miguel Mohammed Monika Nadia Nancy Natalia Nicole Nina Noah Olga Oliver Olivia Omar Oscar Pablo Patricia Paul Pedro Peter Philip Pierre Priya Rachel
Raj Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Simon Sofia Stefan Stephen Susan Teresa Thomas Tom Tomas Ursula Vera Victor Walter Wei William Yuki Yusuf
""".split()
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way|Square|Place|Terrace|Platz|Weg|Gasse|Allee|Rue|Calle|Plaza"
CUES = {
    "email": "mail|contact|write|correo|adresse", "ip": "ip|host|server|address|client", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|telefon", "ssn": "ssn|social|security",
    "name": "name|mr|mrs|ms|dr|dear|contact|regards|signed|sincerely|by|from|with|herr|frau|madame|monsieur|señor|señora", "address": "address|lives|live|at|street|home|office|ship|deliver|visit|adresse|wohnt|calle",
}
NUMBER_CUES = "version|isbn|issn|order|invoice|page|section|chapter|figure|table"
OTHER_USE = {"name": "the|a|an|this|these|under|our|every|in|of", "address": "version|section|chapter|page|the|has|have|of|about|over"}  # words that come before no person's name, no address
CONTEXT = 40  # code points before a span in which cue words count

SHAPES = 64  # hash buckets of the span's shape, and of the word before it
ROUNDS = 8  # of expectation-maximisation
SMOOTHING = 4.0  # pseudo-counts of a classifier feature
LABELERS = ("shape", "gazetteer", "context", "boundary", "number")


def base_spans(text: Column) -> Column:
    """Spans of the base patterns that meet their conditions, by kind, then start."""
    digits = lambda s: F.length(F.regexp_replace(s.value, "[^0-9]", ""))
    tests = {
        "email": (EMAIL, lambda s: F.lit(True)),
        "ip": (IP, lambda s: s.value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": (CARD, lambda s: digits(s).between(13, 19) & F.call_function("luhn_check", F.regexp_replace(s.value, "[^0-9]", ""))),
        "phone": (PHONE, lambda s: digits(s).between(9, 15)),
    }
    return F.concat(*(_kind(F.filter(_matches(text, p), ok), kind) for kind, (p, ok) in tests.items()))


def _matches(text: Column, pattern: str) -> Column:
    signs = SIGNS.get(pattern)
    if not signs:
        return match_spans(text, pattern)
    there = functools.reduce(lambda a, b: a | b, (text.contains(s) for s in signs))
    return F.when(there, match_spans(text, pattern)).otherwise(F.array().cast(f"array<{SPAN}>"))


def wider_spans(text: Column) -> Column:
    return F.concat(*(_kind(_matches(text, p), kind) for kind, p in WIDER.items()))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(_ORDER.index(kind)).alias("order"), s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind"), s.value.alias("value")))


def _of_kind(kind: Column, by: dict[str, Column]) -> Column:
    out = None
    for name, value in by.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(F.lit(None))


def _vote(yes: Column, no: Column) -> Column:
    """1, 0, or null where the labeler abstains."""
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), 0)


def label(span: Column, text: Column, strict: bool) -> Column:
    """The span with its labelers' votes and its classifier features, without its value."""
    value, kind = span.value, span.kind
    left = F.lower(F.substring(text, F.greatest(span.start - CONTEXT + 1, F.lit(1)), F.least(span.start, F.lit(CONTEXT))))
    beside = F.concat(F.right(left, F.lit(1)), F.substring(text, span.end + 1, F.lit(1)))
    cue = _of_kind(kind, {k: left.rlike(rf"(?<![a-z])(?:{words})(?![a-z])") for k, words in CUES.items()})
    known = _of_kind(kind, {
        "email": F.lower(value).rlike(rf"(?:\.|dot[\])]\x20?)(?:{DOMAINS})$"), "ip": ~value.rlike(r"^(?:0|127|255)\.|^(\d+)(?:\.\1){3}$"),
        "card": value.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "phone": ~value.rlike(r"^\+?\(?0|([0-9])\1{6}"), "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "name": F.substring_index(value, " ", 1).isin(GIVEN_NAMES), "address": value.rlike(rf"\x20(?:{STREETS})$"),
    })
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{L}+", "a")
    near = F.when(F.length(left) == 0, 0).when(F.right(left, F.lit(1)).rlike("[a-z]"), 1).when(F.right(left, F.lit(1)).rlike(r"\s"), 2).otherwise(3)
    other = _of_kind(kind, {k: left.rlike(rf"(?<![a-z])(?:{OTHER_USE.get(k, NUMBER_CUES)})[\s:#.]*$") for k in _ORDER})
    votes = F.array(
        F.when(F.lit(strict), 1), _vote(known, ~known), _vote(cue, F.lit(False)),
        _vote(~beside.rlike("[a-z0-9]"), beside.rlike("[0-9]")), _vote(F.lit(False), other),
    )
    word = F.regexp_extract(left, r"([\p{L}\p{N}]++)[^\p{L}\p{N}]*$", 1)
    bucket = lambda c: F.pmod(F.hash(c), F.lit(SHAPES))
    return F.struct(span.order, span.start, span.end, kind, votes.alias("votes"), bucket(shape).alias("shape"), near.alias("near"), bucket(word).alias("before"))


class Reliabilities:
    """Prior, and for each labeler the shares of its votes (1, 0, abstained) on true and on false candidates.

    That a cue is missing says something, too, so abstaining is a vote like the
    others; only the first labeler, which abstains on all wider candidates, is
    left out where it does.
    """

    def __init__(self, prior: float, on_true: list[tuple], on_false: list[tuple]):
        self.prior, self.on_true, self.on_false = prior, on_true, on_false

    def posterior(self, votes: Column) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for i, (t, f) in enumerate(zip(self.on_true, self.on_false, strict=True)):
            yes, no, none = (math.log(a / b) for a, b in zip(t, f, strict=True))
            odds = odds + F.when(votes[i] == 1, yes).when(votes[i] == 0, no).otherwise(none if i else 0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation over counted vote patterns (columns ``votes``, ``n``).

    The patterns are a table of a bounded number of rows (a kind, 3 ** labelers
    votes and the buckets of the features), and each round brings one row of sums to the driver.
    """
    labelers = range(len(LABELERS))
    found = Reliabilities(0.5, [(0.42, 0.18, 0.4)] * len(LABELERS), [(0.18, 0.42, 0.4)] * len(LABELERS))
    for _ in range(rounds):
        p, n = found.posterior(F.col("votes")), F.col("n")
        sums = [F.sum(p * n), F.sum(n)]
        for i in labelers:
            vote = F.col("votes")[i]
            sums += [F.sum(F.when(is_, weight * n)) for weight in (p, 1 - p) for is_ in (vote == 1, vote == 0, vote.isNull())]
        row = [float(x or 0) for x in patterns.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        shares = lambda x: tuple((v + 1) / (sum(x) + 3) for v in x)  # noqa: E731  smoothed, so never 0 or 1
        each = [row[2 + 6 * i : 8 + 6 * i] for i in labelers]
        found = Reliabilities((row[0] + 1) / (row[1] + 2), [shares(e[:3]) for e in each], [shares(e[3:]) for e in each])
    return found


def train_classifier(patterns: DataFrame, found: Reliabilities) -> tuple[float, dict[str, float]]:
    """Log-odds of the classifier's features, from counts weighted by the posteriors."""
    p, n = found.posterior(F.col("votes")), F.col("n")
    features = F.array(F.concat(F.lit("kind="), "kind"), F.concat(F.lit("shape="), "kind", F.lit(":"), F.col("shape").cast("string")), F.concat(F.lit("near="), "kind", F.lit(":"), F.col("near").cast("string")),
                       F.concat(F.lit("before="), "kind", F.lit(":"), F.col("before").cast("string")),
                       *(F.concat(F.lit(f"{name}="), F.coalesce(F.col("votes")[i].cast("string"), F.lit("-"))) for i, name in enumerate(LABELERS)))
    counted = patterns.select(F.explode(features).alias("feature"), (p * n).alias("yes"), ((1 - p) * n).alias("no"))
    rows = counted.groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # a bounded set of features
    total = patterns.agg(F.sum(p * n), F.sum((1 - p) * n)).first()
    share = ((total[0] or 0) + 1) / ((total[0] or 0) + (total[1] or 0) + 2)
    prior = math.log(share / (1 - share))
    # counts are smoothed towards the prior, so a rare feature says little
    return prior, {r.feature: math.log((r.yes + SMOOTHING * share) / (r.no + SMOOTHING * (1 - share))) - prior for r in rows}


def _score(span: Column, prior: float, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(prior)
    table = F.create_map(*(F.lit(x) for k in sorted(weights) for x in (k, weights[k])))
    weight = lambda *key: F.coalesce(F.element_at(table, F.concat(*key)), F.lit(0.0))
    score = F.lit(prior) + weight(F.lit("kind="), span.kind) + weight(F.lit("shape="), span.kind, F.lit(":"), span["shape"].cast("string"))
    score = score + weight(F.lit("near="), span.kind, F.lit(":"), span["near"].cast("string")) + weight(F.lit("before="), span.kind, F.lit(":"), span["before"].cast("string"))
    for i, name in enumerate(LABELERS):
        score = score + weight(F.lit(f"{name}="), F.coalesce(span.votes[i].cast("string"), F.lit("-")))
    return score


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Base spans always stay.  Labelers (strict shape, gazetteer, context cues,
    boundaries, cues of another use) vote on them and on wider candidates
    (disguised e-mail addresses, local phone numbers, social security numbers,
    personal names, street addresses);
    expectation-maximisation over all candidates of the corpus estimates how far
    each labeler can be trusted, and a log-linear span classifier trained on the
    resulting posteriors decides which wider candidates are added (those that
    meet no base span).

    Returns id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans),
    ``base_sha256`` and ``spans``, both by kind, then start.  A null text is
    empty; repeated rows are judged alike; without candidates nothing is
    trained or added; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("id", "text", base_spans(F.col("text")).alias("base"), wider_spans(F.col("text")).alias("wider"))
    found = found.select(
        "id",
        F.transform("base", lambda s: label(s, F.col("text"), True)).alias("base"),
        F.transform(F.filter("wider", lambda s: ~overlaps(s, F.col("base"))), lambda s: label(s, F.col("text"), False)).alias("wider"),
    )
    table = materialise(found, "pii")

    spans = table.select(F.explode(F.concat("base", "wider")).alias("s")).select("s.kind", "s.votes", "s.shape", "s.near", "s.before")
    patterns = materialise(spans.groupBy("kind", "votes", "shape", "near", "before").agg(F.count(F.lit(1)).alias("n")), "patterns")
    prior, weights = train_classifier(patterns, estimate(patterns))
    added = F.filter("wider", lambda s: _score(s, prior, weights) > 0) if weights else F.filter("wider", lambda s: F.lit(False))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    by_kind = F.array_sort(F.concat("base", added))
    return table.select(F.col("id").alias(id_col), *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(by_kind).alias("spans"))
