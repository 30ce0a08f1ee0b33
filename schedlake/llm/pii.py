"""Personal data: regex, gazetteer and context labelers vote on spans, EM weighs them, a classifier decides.

Spans are found with SQL functions only. The votes of all spans are counted by pattern, of which there are few whatever
the number of documents; expectation-maximisation and the classifier run on those counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from schedlake.llm.shared import bind, written

KINDS = ["email", "ip", "card", "phone"]
#: Characters of the text before a span that the context labelers see.
CONTEXT = 30
#: A span that only the method proposes is added from this probability on.
ACCEPT = 0.9
ROUNDS = 50

# Leftmost, non-overlapping matches. Guards such as (?<![0-9]) and the possessive ++ leave the matches as they are and
# keep the search linear on long runs; \G is the end of the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Spans that may be personal data but that no base pattern takes.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,3}(?![0-9A-Za-z.-])",
}
#: What a text must hold to be searched at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DIGIT = r"[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Gazetteers: top-level domains and country calling codes in wide use.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|nl|eu|us|ca|ch|at|be|pl|pt|se|example"
CALLING = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-9]|38[0-9]|42[0-3]"
CUES = {
    "email": r"e-?mail|contact|write|reach|courriel|correo|schreib",
    "ip": r"\bip\b|address|host|server|login|from|adresse",
    "card": r"card|visa|credit|payment|paid|carte|tarjeta|karte",
    "phone": r"phone|\btel|call|fax|mobile|reach|contact|numéro|teléfono|telefon",
}
AGAINST = r"version|isbn|order|invoice|build|section|page|figure|serial|part no|\bv\.?$|rfc"
VOTES = ["form", "gazetteer", "cue", "against", "edge"]


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value, before, after`` of each match in code points; ``before`` and ``after`` are neighbouring text.

    The text is cut at its matches; places are running sums over the lengths of cuts and matches.
    """
    def placed(x: Column) -> Column:
        first = F.struct(F.length(x["gaps"][0]).alias("start"), F.array().cast(
            "array<struct<start:int,end:int,value:string,before:string,after:string>>").alias("out"))

        def step(a: Column, i: Column) -> Column:
            value, before, after = x["found"][i], x["gaps"][i], x["gaps"][i + 1]
            end = a["start"] + F.length(value)
            span = F.struct(a["start"].alias("start"), end.alias("end"), value.alias("value"),
                            F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, 1).alias("after"))
            return F.struct((end + F.length(after)).alias("start"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), first, step, lambda a: a["out"])

    def of(found: Column) -> Column:
        return F.when(F.size(found) > 0, bind(
            F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check; linear in its length."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: bind(
        d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda n: F.when(n > 9, n - 9).otherwise(n)))
    return F.aggregate(F.filter(each, F.isnotnull), F.lit(0), lambda a, n: a + n) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return bind(digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0).cast("tinyint")


def votes(kind: str, base: bool, m: Column) -> Column:
    """One vote of each labeler: 1 for personal data, -1 against, 0 for none."""
    value, before = m["value"], F.lower(m["before"])
    known = {
        "email": F.lower(value).rlike(rf"(?:\.|\(dot\)|\[dot\]) ?(?:{DOMAINS})$"),
        "ip": value.rlike(r"^(?!0|10\.|127\.|255\.)[0-9]{1,3}\."),
        "card": value.rlike("^[3-6]"),
        "phone": value.rlike(rf"^\+(?:{CALLING})") if base else F.lit(False),
    }[kind]
    unknown = ~known if base else F.lit(False)
    torn = m["after"].rlike("[A-Za-z0-9]") | m["before"].rlike("[A-Za-z0-9]$")
    return F.struct(
        F.lit(1 if base else 0).cast("tinyint").alias("form"), _vote(known, unknown).alias("gazetteer"),
        _vote(before.rlike(CUES[kind])).alias("cue"), _vote(F.lit(False), before.rlike(AGAINST)).alias("against"),
        _vote(~torn, torn).alias("edge"), (F.length(digits(value)) >= 9).cast("tinyint").alias("long"))


def candidates(text: Column) -> Column:
    """All spans that some labeler may take, as ``kind, base, start, end, votes``; an empty array for null."""
    def spans(kind: str, pattern: str, base: bool, needed: Column) -> Column:
        none = F.array().cast("array<struct<kind:int,base:boolean,start:int,end:int,v:struct<form:tinyint,"
                              "gazetteer:tinyint,cue:tinyint,against:tinyint,edge:tinyint,long:tinyint>>>")
        found = matches(text, pattern)
        kept = F.filter(found, lambda m: valid(kind, m["value"])) if base else found
        return F.coalesce(F.when(needed, F.transform(kept, lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), m["start"].alias("start"),
            m["end"].alias("end"), votes(kind, base, m).alias("v")))), none)

    digit = text.rlike(DIGIT)
    need = {k: digit if n is None else F.contains(text, F.lit(n)) for k, n in NEEDS.items()}
    need["ip"], need["phone"] = need["ip"] & digit, need["phone"] & digit
    loose = {"email": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), "phone": digit}
    return F.concat(*[spans(k, p, True, need[k]) for k, p in PATTERNS.items()],
                    *[spans(k, p, False, loose[k]) for k, p in LOOSE.items()])


def vote_patterns(found: DataFrame) -> list[tuple[tuple, int]]:
    """``(kind, base, votes...)`` and how often; at most 4 · 2 · 3⁵ · 2 of them."""
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", *[f"s.v.{v}" for v in [*VOTES, "long"]]).count()
    return sorted((tuple(r[:-1]), r[-1]) for r in each.collect())


def reliabilities(patterns: Iterable[tuple[tuple, int]], rounds: int = ROUNDS) -> list[float]:
    """The probability that the spans of each pattern are personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth; each has a probability for each vote given the truth, smoothed
    by one count, and the share of true spans is estimated with them. The start is the majority of the votes.
    """
    rows = list(patterns)
    tallies = [sum(p[2:2 + len(VOTES)]) for p, _ in rows]
    truth = [0.9 if t > 0 else 0.1 if t < 0 else 0.5 for t in tallies]
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        share = (sum(n * t for (_, n), t in zip(rows, truth)) + 1) / (total + 2)
        odds = [math.log(share / (1 - share))] * len(rows)
        for j in range(len(VOTES)):
            chance = {}
            for vote in (-1, 0, 1):
                yes = 1 + sum(n * t for (p, n), t in zip(rows, truth) if p[2 + j] == vote)
                no = 1 + sum(n * (1 - t) for (p, n), t in zip(rows, truth) if p[2 + j] == vote)
                chance[vote] = (yes, no)
            all_yes, all_no = (sum(c[k] for c in chance.values()) for k in (0, 1))
            odds = [o + math.log(chance[p[2 + j]][0] / all_yes) - math.log(chance[p[2 + j]][1] / all_no)
                    for o, (p, _) in zip(odds, rows)]
        truth = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return truth


def features(p: tuple) -> list[float]:
    kind, base, *rest = p
    v = dict(zip([*VOTES, "long"], rest))
    return [1.0, *[float(kind == k) for k in range(1, len(KINDS))], float(v["form"]), float(v["gazetteer"] > 0),
            float(v["gazetteer"] < 0), float(v["cue"]), float(v["against"]), float(v["edge"] > 0), float(v["long"])]


def classifier(patterns: list[tuple[tuple, int]], truth: list[float], steps: int = 500, penalty: float = 0.01) -> list[float]:
    """Weights of a logistic regression on the estimated truth, over the counted patterns."""
    rows = [(features(p), n, t) for (p, n), t in zip(patterns, truth)]
    total = sum(n for _, n, _ in rows)
    weights = [0.0] * len(features((0, True, 0, 0, 0, 0, 0, 0)))
    for _ in range(steps if total else 0):
        gradient = [penalty * w for w in weights]
        for x, n, t in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            for k, b in enumerate(x):
                gradient[k] += n / total * (p - t) * b
        weights = [w - 2.0 * g for w, g in zip(weights, gradient)]
    return weights


def accepted(spans: Column, patterns: list[tuple[tuple, int]], weights: list[float], accept: float = ACCEPT) -> Column:
    """Base spans, and the other spans that the classifier takes and that touch no base span; by kind, then start."""
    good = [p for p, _ in patterns if not p[1] and 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(
        a * b for a, b in zip(weights, features(p))))))) >= accept]
    base = F.filter(spans, lambda s: s["base"])
    if not good:
        added = F.filter(spans, lambda s: F.lit(False))
    else:
        def taken(s: Column) -> Column:
            return reduce(Column.__or__, [(s["kind"] == p[0]) & reduce(Column.__and__, [
                s["v"][name] == value for name, value in zip([*VOTES, "long"], p[2:])]) for p in good])
        added = F.filter(spans, lambda s: ~s["base"] & taken(s) & ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.sort_array(F.transform(F.concat(base, added), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))


def find(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``row`` (the whole row of docs as a struct) and ``spans``: ``kind, start, end, base`` sorted by kind and start.

    ``kind`` is an index into ``KINDS``, places are code points, the end is exclusive. Null and empty texts have no
    spans; rows that repeat are searched each; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = written(docs.select(F.struct("*").alias("row"), candidates(whole).alias("spans")), "candidate-spans")
    patterns = vote_patterns(found)
    weights = classifier(patterns, reliabilities(patterns))
    return found.select("row", accepted(F.col("spans"), patterns, weights, accept).alias("spans"))


def find_in(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``doc_id, spans``, as ``find``, without writing the texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = written(docs.select(F.col(doc_id).alias("doc_id"), candidates(whole).alias("spans")), "candidate-spans")
    patterns = vote_patterns(found)
    weights = classifier(patterns, reliabilities(patterns))
    return found.select("doc_id", accepted(F.col("spans"), patterns, weights, accept).alias("spans"))


def number_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind. The lambda takes the span alone: Spark hands a second parameter the span's place."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def written_out(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``[KIND]``; a span that begins inside another one is covered by it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_place = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        end = -s["e"]
        piece = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
                       ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.concat(a["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(by_place, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
