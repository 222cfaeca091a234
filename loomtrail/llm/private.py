"""Personal data in texts by labelers that vote, of which nobody knows how far to trust them.

Patterns find candidates. Labelers vote for or against each: patterns say whether it is well formed, lists whether its
parts exist, and the words and characters around it whether it is meant so. Expectation maximisation over the counted
votes tells how reliable each labeler is and how likely each combination of votes means personal data. A naive Bayes
classifier of features of the span and its surroundings, trained on these likelihoods, has the last word.

All is done with built-in expressions, row by row, but for two groupings of a bounded number of groups: combinations of
votes, and buckets of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

# fixed values: the patterns, as leftmost matches that don't overlap. Loops don't give back what they took, which changes no
# match and keeps time in proportion to the text. A run that can't begin a match is tried once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
#: Kinds, in the order in which spans at one place stand.
KINDS = ("email", "ip", "card", "phone", "iban", "name", "secret", "ssn")
_BASE = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))

#: What lists say exists: ends of hosts, dial codes, beginnings of cards, countries of accounts, given names, titles.
HOST_ENDS = tuple("com org net edu gov info io de fr es it uk us eu ch at nl be se example".split())
DIAL_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split())
CARDS = ("4", "5[1-5]", "2[2-7]", "3[47]", "6011", "65")
COUNTRIES = tuple("AT BE CH CZ DE DK ES FI FR GB HU IE IT LU NL NO PL PT SE".split())
GIVEN = tuple(
    "James Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua George Kevin Edward Brian Ronald Mary Patricia "
    "Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Michelle Laura Hans Klaus Jürgen Wolfgang Ursula Monika Sabine "
    "Pierre Philippe Isabelle Nathalie Carlos Javier Carmen Dolores".split()
)
TITLES = tuple("Mr Mrs Ms Dr Herr Frau Monsieur Madame Señor Señora".split())
#: Words before a candidate that speak for it or against it.
CUES = {
    "email": "mail|contact|reach|write|address|correo|courriel", "ip": r"\bip\b|server|host|login|logged|address", "card": "card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|\btel\b|mobile|cell|fax|contact|whatsapp", "iban": r"iban|account|\bbank\b|konto|compte|cuenta", "name": r"name|dear|author|signed|contact|hello|\bby\b",
    "secret": r"login|credential|\bkey\b|auth", "ssn": r"\bssn\b|social|security|insurance",
}
DOUBTS = r"version|release|order|isbn|issn|invoice|figure|section|chapter|page|total|price|ticket|serial|article no"

_SECRET = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)"
_AT, _DOT = r"\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?", r"\x20?(?:\.|[\[({]\x20?(?i:dot)\x20?[\])}])\x20?"
# what the method looks for beside the fixed patterns, in order of preference
_LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "secret": rf"(?<![A-Za-z0-9]){_SECRET}\x20?[=:]\x20?[^\s,;\"']{{6,200}}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?<![0-9+)][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{L}}{{1,30}}|(?:{'|'.join(GIVEN)})\x20\p{{Lu}}\p{{L}}{{1,30}})(?![\p{{L}}])",
}

#: Buckets of features; how often expectation and maximisation take turns; units of a likelihood in sums.
BUCKETS, ROUNDS, UNITS = 4096, 60, 1_000_000
#: Of the labelers: what each votes, for (+), against (-) or nothing (0).
LABELERS = ("well formed", "listed", "context", "edges", "digits")
#: Length of the pieces in which running sums are made.
_CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _short_sums(steps: Column) -> Column:
    """The running sums of a short array; each step copies those before it."""
    none = F.array().cast("array<int>")
    return F.aggregate(steps, none, lambda acc, step: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + step)))


def running(steps: Column) -> Column:
    """The running sums of an array of numbers: those within short pieces, and those of the pieces' own sums."""

    def joined(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0), lambda acc, step: acc + step))
        before = F.concat(F.array(F.lit(0)), _short_sums(totals))
        return F.flatten(F.zip_with(pieces, F.slice(before, F.lit(1), F.size(pieces)), lambda piece, offset: F.transform(_short_sums(piece), lambda x: x + offset)))

    def cut_up(all_steps: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), F.lit(_CHUNK))
        return bound(F.transform(begins, lambda at: F.slice(all_steps, at, F.lit(_CHUNK))), joined)

    return bound(steps, cut_up)


def placed(text: Column, said: Column, pattern: str) -> Column:
    """The matches ``said`` of ``pattern`` in ``text`` with where they are: array of (said, before, after, start, stop), in
    code points. ``before`` and ``after`` are the text up to the neighbouring matches."""
    gaps = F.split(text, pattern, -1)
    befores, afters = F.slice(gaps, F.lit(1), F.size(said)), F.slice(gaps, F.lit(2), F.size(said))
    steps = F.zip_with(befores, F.concat(F.array(F.lit("")), F.slice(said, F.lit(1), F.size(said) - 1)), lambda gap, match: F.length(gap) + F.length(match))
    zipped = F.arrays_zip(said.alias("said"), befores.alias("before"), afters.alias("after"), running(steps).alias("start"))
    whole = F.transform(zipped, lambda m: F.struct(m["said"].alias("said"), F.substring(m["before"], -48, 48).alias("before"), F.substring(m["after"], 1, 24).alias("after"), m["start"].alias("start"), (m["start"] + F.length(m["said"])).alias("stop")))
    kind = "array<struct<said:string,before:string,after:string,start:int,stop:int>>"
    return F.when(F.size(said) > 0, whole).otherwise(F.array().cast(kind)).cast(kind)


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a run of 12 to 19 digits has the sum that cards have."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, at: F.when(at % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _well_formed(kind: str, said: Column) -> Column:
    """Whether a match of a kind's pattern holds."""
    if kind == "ip":
        return said.rlike(_IP_PARTS)
    if kind == "card":
        return luhn(_digits(said))
    if kind == "phone":
        return F.length(_digits(said)).between(9, 15)
    if kind == "secret":
        return said.rlike("[0-9]") & said.rlike("[A-Za-z]")
    return F.lit(True)


def _listed(kind: str, said: Column) -> Column:
    """What lists say of the parts of a match: 1, 0 or -1."""
    if kind == "email":
        return F.when(F.lower(said).rlike(rf"[.\x20\])}}](?:{'|'.join(HOST_ENDS)})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(said.rlike(r"^(?:0|127|255|2[3-5][0-9])\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(said).rlike(f"^(?:{'|'.join(CARDS)})"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(said.startswith("+") & ~_digits(said).rlike(f"^(?:{'|'.join(DIAL_CODES)})"), -1).otherwise(1)
    if kind == "iban":
        return F.when(F.substring(said, 1, 2).isin(*COUNTRIES), 1).otherwise(-1)
    if kind == "name":
        return F.when(said.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN)})\x20"), 1).otherwise(0)
    if kind == "ssn":
        return F.when(said.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1)
    return F.lit(1)


def _candidate(kind: str, match: Column, fixed: bool) -> Column:
    """A match as (kind, start, stop, base, loose, votes, features)."""
    said, before, after = match["said"], F.lower(match["before"]), F.lower(match["after"])
    good = _well_formed(kind, said)
    sign = lambda yes: F.when(yes, "+").otherwise("-")
    listed = F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), _listed(kind, said) + 2)
    context = F.when(before.rlike(DOUBTS), "-").when(before.rlike(CUES[kind]), "+").otherwise("0")
    edges = sign(~(match["before"].rlike(r"[\p{L}\p{Nd}_@/]$") | match["after"].rlike(r"^(?:[\p{L}\p{Nd}_@/]|\.[0-9])")))
    various = F.size(F.array_distinct(F.split(F.substring(_digits(said), 1, 64), "")))
    digits = F.lit("0") if kind in ("email", "name", "secret") else sign(various >= 4)
    head = F.substring(said, 1, 64)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    about = (
        F.lit(""), shape, F.length(said).cast("string"), F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1), F.regexp_extract(after, r"^[^\p{L}]*(\p{L}+)", 1),
        F.substring(before, -1, 1), F.substring(after, 1, 1),
    )
    features = F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind} {n}"), value), F.lit(BUCKETS)).cast("int") for n, value in enumerate(about)])
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), match["start"].alias("start"), match["stop"].alias("stop"), (good if fixed else F.lit(False)).alias("base"),
        F.lit(not fixed).alias("loose"), F.concat(sign(good), listed, context, edges, digits).alias("votes"), features.alias("features"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the candidates in each text. Matches of the fixed patterns that can't hold by their length are left out."""
    text, none = F.col("text"), F.array().cast("array<string>")
    loose = "|".join(f"(?:{p})" for p in _LOOSE.values())
    may = {"email": text.contains("@"), "phone": text.contains("+")}
    digit = text.rlike("[0-9]")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    said = [F.when(may.get(kind, digit), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"said_{kind}") for kind, pattern in _BASE]
    rows = rows.select("*", *said, F.regexp_extract_all(text, F.lit(loose), F.lit(0)).alias("said_loose"))
    rows = rows.select("doc_id", *[placed(text, F.col(f"said_{kind}"), pattern).alias(kind) for kind, pattern in (*_BASE, ("loose", loose))])

    def of(matches: str, kind: str, fixed: bool, chosen: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(matches, lambda m: chosen(m["said"])), lambda m: _candidate(kind, m, fixed))

    plausible = lambda kind: (lambda said: F.length(_digits(said)) >= 9) if kind == "card" else (lambda said: F.lit(True))
    # a match of the alternatives is of the kind that it looks like
    is_of = lambda kind: lambda said: _kind_of(said) == kind
    parts = [of(kind, kind, True, plausible(kind)) for kind, _ in _BASE] + [of("loose", kind, False, is_of(kind)) for kind in _LOOSE]
    return rows.select("doc_id", F.concat(*parts).alias("found"))


def _kind_of(said: Column) -> Column:
    return (
        F.when(said.rlike(rf"^{_SECRET}\x20?[=:]|^(?:AKIA|ghp_|sk-)"), "secret").when(said.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(said.rlike(r"^[(0-9)\x20.-]+$"), "phone")
        .when(said.rlike(r"[\[({]\x20?(?i:at)\x20?[\])}]"), "email").when(said.rlike("^[A-Z]{2}[0-9]{2}"), "iban").otherwise("name")
    )


def reliabilities(votes: Iterable[tuple[int, str, int]], rounds: int = ROUNDS) -> tuple[dict[tuple[int, str], float], list[list[dict[str, float]]]]:
    """Expectation maximisation over (kind, votes, how often): how likely each combination means personal data, and for each
    labeler what share of its votes is +, 0 and - where that is false, and where it is true.

    Labelers are taken to err independently, and to be right more often than not at first; each vote has one count more.
    """
    votes = sorted(votes)
    if not votes:
        return {}, []
    width = len(votes[0][1])
    shares = [[{"+": 0.15, "0": 0.25, "-": 0.6}, {"+": 0.6, "0": 0.25, "-": 0.15}] for _ in range(width)]
    prior = {kind: 0.5 for kind, _, _ in votes}
    likely: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for kind, said, _n in votes:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(shares[k][1][v] / shares[k][0][v]) for k, v in enumerate(said))
            likely[kind, said] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        for kind in prior:
            own = [(likely[k, said], n) for k, said, n in votes if k == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for k in range(width):
            for true in (0, 1):
                counts = {"+": 1.0, "0": 1.0, "-": 1.0}
                for kind, said, n in votes:
                    p = likely[kind, said]
                    counts[said[k]] += n * (p if true else 1 - p)
                total = sum(counts.values())
                shares[k][true] = {v: c / total for v, c in counts.items()}
    return likely, shares


def classifier(found: DataFrame) -> Callable[[Column], Column]:
    """The naive Bayes classifier for ``found`` (candidates): from an array of buckets to the log odds of personal data."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    # as many groups at most as there are combinations of votes and kinds
    votes = [(r["kind"], r["votes"], r["n"]) for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    likely, _ = reliabilities(votes)
    units = F.lit(0)
    if likely:
        known = F.create_map(*[F.lit(x) for (kind, said), p in sorted(likely.items()) for x in (f"{kind}{said}", round(p * UNITS))])
        units = F.element_at(known, F.concat("kind", "votes"))
    sums = each.select(F.explode("features").alias("bucket"), units.cast("long").alias("units")).groupBy("bucket").agg(F.sum("units").alias("units"), F.count("*").alias("n")).collect()
    true = sum(likely[kind, said] * n for kind, said, n in votes)
    total = sum(n for _, _, n in votes)
    bias = math.log((true + 0.5) / (total - true + 0.5))
    weights = [0.0] * BUCKETS
    for r in sums:
        yes = r["units"] / UNITS
        # a bucket's odds against those of all candidates
        weights[r["bucket"]] = math.log((yes + 0.5) / (r["n"] - yes + 0.5)) - bias
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    return lambda features: F.aggregate(features, F.lit(bias), lambda acc, b: acc + F.element_at(table, b + 1))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    The fixed patterns' matches that hold are the base and always stay: mail addresses, addresses of four parts up to
    255, cards of 12 to 19 digits with the right sum, phone numbers of 9 to 15 digits with ``+``. The method adds what the
    classifier takes for personal data: addresses written with (at) and (dot), numbers without ``+``, accounts, names,
    secrets. ``base_sha256`` is of ``kind:start:end`` of the base by start, then kind, joined by commas; ``spans`` is that
    string for all. Positions are code points. ``found`` has the spans as (kind, start, stop, base).

    A null or empty text has no spans and the digest of an empty string. Rows that repeat are read each; null ids stay;
    an empty table gives no rows; other columns are not read. The time for a text grows with its length and its matches.
    """
    found = cut(candidates(docs, id_col, text_col))
    odds = classifier(found)
    kept = F.filter("found", lambda c: c["base"] | (c["loose"] & (odds(c["features"]) >= 0)))
    spans = F.sort_array(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["base"].alias("base"))))
    rows = found.select("doc_id", spans.alias("spans"))
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    rows = rows.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    return rows.select(
        "doc_id", *[number(kind) for kind, _ in _BASE],
        F.sha2(F.array_join(F.transform("base", said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.array_distinct(F.transform("spans", said)), ",").alias("spans"),
        F.transform("spans", lambda s: F.struct(F.element_at(name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"))).alias("found"),
    )
