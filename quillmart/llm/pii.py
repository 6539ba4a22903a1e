"""Personal data by weak supervision.

Candidate spans are the strict patterns' matches and those of wider patterns:
spelt-out addresses, hexadecimal IP addresses, numbers without a country code.
Five labelers vote on each candidate for, against or not at all: its layout, its
check figures, gazetteers, the words around it, and its edges. No labeler knows which
pattern a candidate is from, so a wide candidate is judged as a strict one. The votes are
counted by combination; expectation-maximisation over these counts (243 for each
kind at most, whatever the input) estimates how reliable each labeler is and how
likely each combination is personal data. A logistic classifier of span features,
trained on those likelihoods, decides which wide candidates are added. Spans of
the strict patterns always stay. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, materialize
from .spans import digits, found_matches, located, with_digests

KINDS = ["email", "ip", "card", "phone"]
#: The strict patterns. Possessive forms match what the plain ones do and need no backtracking:
#: a match starts where its first run does, or where the match before ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns: spelt-out addresses (the at or the dots in brackets or as words), eight-part addresses, numbers without a country code.
_AT = r"(?: ?[(\[{] ?(?i:at) ?[)\]}] ?| (?i:at) )"
_DOT = r"(?:\.| ?[(\[{] ?(?i:dot) ?[)\]}] ?| (?i:dot) )"
_NAME = r"[A-Za-z0-9-]{1,63}+"
WIDE = {
    "email_wide": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+{_AT}{_NAME}(?:{_DOT}{_NAME}){{1,8}}+",
    "ip_wide": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone_wide": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
NEEDS = {"email": "@", "phone": "+"}
LABELERS = ["layout", "check", "gazetteer", "context", "edge"]
#: Added if the classifier gives at least this probability.
THRESHOLD = 0.9
EM_ROUNDS = 60

# The gazetteers and context words of the labelers.
DOMAIN_ENDS = ["com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "eu", "us"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91"]
CARD_STARTS = ["4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38"]
NEAR = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|addr|login|from",
    "card": "card|visa|master|amex|credit|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|sms",
}
AGAINST = "version|release|isbn|issn|invoice|order|serial|part no|chapter|section|figure|page"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.try_to_number(F.substring(F.reverse(number), i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        return total + F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def octets_fit(match: Column) -> Column:
    """Whether each dotted part is at most 255, with any number of leading zeros."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def is_base(kind: Column, match: Column) -> Column:
    n = F.length(digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets_fit(match))
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(match))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def candidates(matches: DataFrame) -> DataFrame:
    """Matches of possible personal data: ROW, kind, start, end, is_base, the labelers' votes (1, 0, -1) and span features."""
    strict = F.col("kind").isin(KINDS)
    n = F.length(digits(F.col("match")))
    rows = matches.withColumns({"is_base": is_base(F.col("kind"), F.col("match")), "strict": strict, "kind": F.regexp_replace("kind", "_wide$", ""), "n": n})
    # Card-like and address-like matches outside of any plausible length are no candidates.
    rows = rows.filter("is_base OR NOT strict OR (kind = 'card' AND n BETWEEN 12 AND 19) OR (kind = 'phone' AND n BETWEEN 7 AND 15)")
    kind, match, before = F.col("kind"), F.col("match"), F.lower("before")
    number = digits(match)
    end = F.lower(F.regexp_extract(match, r"([A-Za-z0-9]+)$", 1))
    starts = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.startswith(number, x))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    bracket = match.rlike(r"[(\[{]")
    # An @ or a bracket is no prose; a plain " at " may be.
    layout = (
        F.when(kind == "email", vote(match.contains("@") | bracket | match.rlike("(?i) dot "), F.lit(False)))
        .when(kind == "card", vote(match.rlike(r"^[0-9]+$|^[0-9]{4}([ -][0-9]{1,4}){2,4}$"), match.rlike(r"[0-9][ -][0-9][ -][0-9]([ -]|$)")))
        .when(kind == "phone", vote(bracket | match.rlike(r"^\+|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$"), match.rlike(r"^[0-9]+ [0-9]+ [0-9]+$")))
        .otherwise(F.lit(1))
    )
    check = (
        F.when(kind == "card", vote(luhn(number), ~luhn(number)))
        .when(kind == "ip", vote(F.col("is_base") | match.contains(":"), F.lit(False)))
        .when(kind == "phone", vote(n.between(9, 15), ~n.between(7, 15)))
        .otherwise(vote(end.rlike("^[a-z]{2,24}$"), ~end.rlike("^[a-z]{2,24}$")))
    )
    gazetteer = (
        F.when(kind == "email", vote(end.isin(DOMAIN_ENDS), ~end.isin(DOMAIN_ENDS)))
        .when(kind == "card", vote(starts(CARD_STARTS), ~starts(CARD_STARTS)))
        .when(kind == "phone", vote(F.startswith(match, F.lit("+")) & starts(CALLING_CODES) | match.rlike(r"^\(?0?[1-9][0-9]"), F.lit(False)))
        .otherwise(vote(F.lit(False), F.startswith(match, F.lit("0."))))
    )
    near = F.lit(False)
    for k, words in NEAR.items():
        near = near | ((kind == k) & before.rlike(words))
    apart = ~before.rlike("[a-z0-9]$") & ~F.lower("after").rlike("^[a-z0-9]")
    return rows.select(
        ROW, "kind", "start", "end", "is_base",
        layout.alias("layout"), check.alias("check"), gazetteer.alias("gazetteer"), vote(near, before.rlike(AGAINST)).alias("context"), vote(apart, ~apart).alias("edge"),
        F.least(F.floor(n / 4), F.lit(5)).cast("int").alias("f_digits"),
    )


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Likelihood that a span with these votes is personal data, by expectation-maximisation over (votes, count)."""
    total = sum(n for _, n in patterns)
    # Start from the majority of the votes; labelers are taken as better than chance.
    like = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in patterns}
    for _ in range(rounds):
        mass = sum(n * like[v] for v, n in patterns)
        prior = min(0.99, max(0.01, mass / max(total, 1)))
        tables = []
        for j in range(len(LABELERS)):
            yes, no = {-1: 0.2, 0: 1.0, 1: 2.0}, {-1: 2.0, 0: 1.0, 1: 0.2}
            for v, n in patterns:
                yes[v[j]] += n * like[v]
                no[v[j]] += n * (1 - like[v])
            tables.append(({k: x / sum(yes.values()) for k, x in yes.items()}, {k: x / sum(no.values()) for k, x in no.items()}))
        new = {}
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(yes[v[j]] / no[v[j]]) for j, (yes, no) in enumerate(tables))
            new[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        settled = all(abs(new[v] - like[v]) < 1e-9 for v in new)
        like = new
        if settled:
            break
    return like


def train(rows: list[tuple[dict[str, float], float, int]], steps: int = 400) -> dict[str, float]:
    """Weights of a logistic classifier from (features, likelihood, count), by gradient ascent with a ridge."""
    names = sorted({k for x, _, _ in rows for k in x})
    w = dict.fromkeys(names, 0.0)
    total = max(1, sum(n for _, _, n in rows))
    for _ in range(steps):
        grad = dict.fromkeys(names, 0.0)
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                grad[k] += n * (y - p) * v
        for k in names:
            w[k] += 1.0 * (grad[k] / total - 0.001 * w[k])
    return w


def span_features(r) -> dict[str, float]:
    return {f"{r['kind']}": 1.0} | {f"{r['kind']} {x} {r[x]}": 1.0 for x in [*LABELERS, "f_digits"]}


def apart_from_base(rows: DataFrame) -> DataFrame:
    """The base candidates, and of the others those that touch no base span: a piece of what is found already teaches nothing."""
    along = W.partitionBy(ROW).orderBy("start", F.desc("is_base"), "end")
    base_end, base_start = F.when(F.col("is_base"), F.col("end")), F.when(F.col("is_base"), F.col("start"))
    placed = rows.withColumns(
        {"reach": F.max(base_end).over(along.rowsBetween(W.unboundedPreceding, 0)), "next": F.min(base_start).over(along.rowsBetween(0, W.unboundedFollowing))}
    )
    return placed.filter(F.col("is_base") | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))).drop("reach", "next")


def added(rows: DataFrame) -> DataFrame:
    """The candidates that are not base and that the classifier takes."""
    features = [*LABELERS, "f_digits"]
    # Bounded: 4 kinds, 3 votes of 5 labelers, 6 feature values.
    table = rows.groupBy("kind", *features).agg(F.count("*").alias("n")).collect()
    likely: dict[tuple, float] = {}
    for k in KINDS:
        votes: dict[tuple, int] = {}
        for r in table:
            if r["kind"] == k:
                v = tuple(r[x] for x in LABELERS)
                votes[v] = votes.get(v, 0) + r["n"]
        if votes:
            likely |= {(k, *v): p for v, p in estimate(sorted(votes.items())).items()}
    weights = train([(span_features(r), likely[(r["kind"], *(r[x] for x in LABELERS))], r["n"]) for r in table])
    score = F.lit(0.0)
    if weights:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        score = sum((F.coalesce(F.try_element_at(known, F.concat_ws(" ", "kind", F.lit(x), F.col(x))), F.lit(0.0)) for x in features), F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(0.0)))
    scored = rows.withColumn("p", 1 / (1 + F.exp(-score)))
    return scored.filter(~F.col("is_base") & (F.col("p") >= THRESHOLD))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text).

    Counts and base_sha256 are of the strict patterns' spans, spans has the added
    ones too. Null texts count as empty; texts without spans have counts of zero,
    the digest of nothing and an empty string. Repeated rows are each reported. An
    empty table gives no rows. Without candidates nothing is trained or added.
    """
    found = found_matches(docs, BASE | WIDE, NEEDS)
    rows = materialize(apart_from_base(candidates(located(found))))
    base = rows.filter("is_base").select(ROW, "kind", "start", "end", "is_base")
    spans = base.unionByName(added(rows).select(ROW, "kind", "start", "end", "is_base"))
    return with_digests(found, spans, KINDS)
