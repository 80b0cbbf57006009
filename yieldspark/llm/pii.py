"""Personal data by weak supervision, in column expressions only (operator 4).

Base spans follow fixed patterns and checks.  Looser patterns propose further
candidates: obfuscated addresses, numbers in national form, card numbers with
a wrong check digit, addresses of version 6.  Labelers vote on every
candidate: the strict pattern, a gazetteer, the words before it, its format,
and its check digit where the kind has one.
Expectation-maximisation over the table of vote patterns (its size doesn't
depend on the data) estimates how reliable each labeler is and how likely each
pattern is personal data; these likelihoods train the final classifier of
spans, a logistic regression over votes, kind, form and neighbouring
characters.  Base spans stay; other candidates are added where the classifier
says so and no base span overlaps them.

Positions come from splitting a text at its matches: the lengths of the pieces
and of the matches add up to code points.  The patterns match what the
contract's do, but start only where a match can start and give nothing back,
so long runs take linear time and no deep recursion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{{1,63}}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Cheap conditions without which a pattern can't match.
_HAS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_HAS_LOOSE = {
    "email": lambda t: F.contains(t, F.lit("(at)")) | F.contains(t, F.lit("[at]")),
    "ip": lambda t: F.contains(t, F.lit(":")) & t.rlike(r"(?:[0-9A-Fa-f]{1,4}+:){7}"),
    "card": lambda t: t.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Words before a span that speak for a kind, and against any; top-level names; leading digits of card issuers.
CUES = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|client|adresse",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|telefon|appel|llame",
}
AGAINST = "version|isbn|order|serial|ticket|invoice|figure|section|build|sku|doi"
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|us|eu|it|nl|ch|at|ca|au|jp|cn|br|mx|in"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
LABELERS = ("pattern", "gazetteer", "context", "format", "check")
#: Characters before a span that the context labeler reads; rounds of EM and of the classifier; its bar.
BEFORE, ROUNDS, STEPS, ACCEPT = 32, 30, 300, 0.5

_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_CANDIDATE = "array<struct<start:int,kind:int,end:int,form:int,pattern:int,gazetteer:int,context:int,format:int,check:int,left:int,right:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``(start, end, value, before, after)``, in code points; ``before`` is at most what lies after the last match.

    A start is the sum of the lengths before it: whole runs of about the
    square root of the number of matches, then the rest one by one.
    """
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.slice(pieces, 2, F.size(pieces)))

    def spans(parts: Column, sizes: Column, run: Column) -> Column:
        k = F.size(sizes) - 1

        def span(bases: Column):
            def make(x: Column, i: Column) -> Column:
                r = F.floor(i / run).cast("int")
                start = F.element_at(bases, r + 1) + _total(F.slice(sizes, r * run + 1, i - r * run)) + F.length(x["0"])
                return _let(
                    start,
                    lambda s: F.struct(
                        s.alias("start"), (s + F.length(x["1"])).alias("end"), x["1"].alias("value"),
                        F.right(x["0"], F.lit(BEFORE)).alias("before"), F.left(x["2"], F.lit(1)).alias("after"),
                    ),
                )

            return make

        bases = F.transform(F.sequence(F.lit(0), F.floor(k / run).cast("int")), lambda r: _total(F.slice(sizes, F.lit(1), r * run)))
        return _let(bases, lambda b: F.transform(F.slice(parts, F.lit(1), k), span(b)))

    size = lambda x: F.length(x["0"]) + F.coalesce(F.length(x["1"]), F.lit(0))
    root = lambda sizes: F.ceil(F.sqrt(F.size(sizes))).cast("int")
    return _let(parts, lambda p: _let(F.transform(p, size), lambda z: _let(root(z), lambda r: spans(p, z, r)))).cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, loose: bool) -> Column:
    pattern = LOOSE[kind] if loose else {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    found = matches(text, pattern)
    found = found if loose else F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.when((_HAS_LOOSE if loose else _HAS)[kind](text), found).otherwise(F.array().cast(_SPAN))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, -1 for no, else 0; without ``no`` all that isn't yes is no."""
    if no is None:
        return F.when(yes, 1).otherwise(-1)
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _gazetteer(kind: str, v: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(v).rlike(rf"(?:\.|\(dot\)\x20?|\[dot\]\x20?)(?:{TOP_LEVEL})$"))
    if kind == "ip":
        return _vote(~v.rlike(r"^(?:0+|255)\.|^[0:]+$"))
    if kind == "card":
        return _vote(_digits(v).rlike(rf"^(?:{ISSUERS})"))
    return _vote(~_digits(v).rlike(r"^0{3}|^1{10}|(?:0{7}|9{7})$"))


def _format(kind: str, v: Column) -> Column:
    if kind == "email":
        return _vote(F.length(v) <= 254, v.rlike(r"\.\.|^\."))
    if kind == "ip":
        return _vote(~v.rlike(r"(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(v.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$"))
    return _vote(v.rlike(r"[\x20.()-]"), v.rlike(r"[\x20.()-]{4}"))


def _check(kind: str, v: Column) -> Column:
    """The check digit speaks for a card or against it; other kinds have none."""
    return _vote(luhn(_digits(v))) if kind == "card" else F.lit(0)


def _class(c: Column) -> Column:
    """0 end of text or space, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _candidate(kind: str, form: int):
    def make(x: Column) -> Column:
        before = F.lower(x["before"])
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), F.lit(form).alias("form"),
            F.lit(1 if form == 0 else 0).alias("pattern"), _gazetteer(kind, x["value"]).alias("gazetteer"),
            _vote(before.rlike(rf"\b(?:{CUES[kind]})"), before.rlike(rf"\b(?:{AGAINST})\P{{L}}*$")).alias("context"),
            _format(kind, x["value"]).alias("format"),
            _check(kind, x["value"]).alias("check"),
            _class(F.right(x["before"], F.lit(1))).alias("left"),
            _class(x["after"]).alias("right"),
        )

    return make


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes: the base spans (form 0) and loose ones that overlap none of them (form 1)."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[F.transform(_spans(text, k, False), _candidate(k, 0)).cast(_CANDIDATE) for k in KINDS])
    loose = F.concat(*[F.transform(_spans(text, k, True), _candidate(k, 1)).cast(_CANDIDATE) for k in KINDS])
    return F.struct(F.array_sort(base).alias("base"), F.array_sort(loose).alias("loose"))


def _apart(found: Column) -> Column:
    return F.filter(found["loose"], lambda x: ~F.exists(found["base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


@dataclass
class SpanModel:
    """What EM and the classifier learned; ``weights`` by (feature, value)."""

    reliability: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    intercept: float = 0.0

    def probability(self, x: Column) -> Column:
        score = F.lit(self.intercept)
        for name in sorted({n for n, _ in self.weights}):
            values = [(v, w) for (n, v), w in sorted(self.weights.items()) if n == name]
            term = F.when(F.lit(False), F.lit(0.0))
            for v, w in values:
                term = term.when(x[name] == v, F.lit(w))
            score = score + term.otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


FEATURES = ("kind", "form", *LABELERS, "left", "right")


def fit(found: DataFrame, column: str = "found") -> SpanModel:
    """EM and classifier over the counts of candidate patterns.

    The driver gets one row for each combination of kind, form, votes and
    neighbours that occurs: their number is bounded by the vote alphabet.
    """
    x = F.explode(F.concat(F.col(column)["base"], _apart(F.col(column)))).alias("x")
    rows = found.select(x).groupBy(*[F.col(f"x.{c}").alias(c) for c in FEATURES]).agg(F.count("*").alias("n")).collect()
    if not rows:
        return SpanModel()
    n = np.array([r["n"] for r in rows], float)
    votes = {name: np.array([r[name] for r in rows]) for name in LABELERS}
    p = 1 / (1 + np.exp(-1.5 * sum(votes.values())))
    reliability: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(ROUNDS):
        prior = (p @ n + 2) / (n.sum() + 4)
        odds = np.full(len(rows), math.log(prior / (1 - prior)))
        for name, v in votes.items():
            # Pseudo-counts: a labeler is taken to be right more often than not.
            counts = {u: ((p * n)[v == u].sum() + (3 if u > 0 else 1), ((1 - p) * n)[v == u].sum() + (3 if u < 0 else 1)) for u in (-1, 0, 1)}
            yes, no = (sum(c[i] for c in counts.values()) for i in (0, 1))
            reliability[name] = {u: (c[0] / yes, c[1] / no) for u, c in counts.items()}
            for u, (a, b) in reliability[name].items():
                odds[v == u] += math.log(a / b)
        p = 1 / (1 + np.exp(-odds))
    names = sorted({(f, int(r[f])) for r in rows for f in FEATURES})
    place = {k: i for i, k in enumerate(names)}
    at = np.array([[place[f, int(r[f])] for f in FEATURES] for r in rows])
    w, bias, share = np.zeros(len(names)), 0.0, n / n.sum()
    for _ in range(STEPS):
        error = share * (1 / (1 + np.exp(-(w[at].sum(axis=1) + bias))) - p)
        w -= 0.5 * (np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(names)) + 1e-4 * w)
        bias -= 0.5 * error.sum()
    return SpanModel(reliability, {k: float(x) for k, x in zip(names, w, strict=True)}, float(bias))


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def accepted(found: Column, model: SpanModel) -> Column:
    """Base spans and the loose ones that the classifier takes, by start and kind."""
    extra = F.filter(_apart(found), lambda x: model.probability(x) >= ACCEPT)
    return F.array_sort(F.concat(found["base"], extra))


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row.

    A null text is empty: no spans, the digest of nothing.  Null and repeated
    ids are kept row by row; other columns are ignored; an empty table gives
    no rows.  The texts are read once; the candidates are written.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(rows.select("doc_id", candidates(F.col("text")).alias("found")), "pii-candidates")
    base, model = F.col("found")["base"], fit(found)
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(accepted(F.col("found"), model)).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    All columns stay; ``n_chars`` follows the new text if there is one.
    """
    text = next(c for c in docs.columns if c.lower() == "text")
    name, spans = fresh(docs.columns, "__found"), fresh(docs.columns, "__spans")
    found = docs.withColumn(name, candidates(docs[text].cast("string")))
    model = fit(found.select(name), name)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t, ends = F.col(text), F.transform(F.col(spans), lambda x: x["end"])

    def piece(x: Column, i: Column) -> Column:
        at = F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        return F.when(x["start"] >= at, F.concat(F.substring(t, at + 1, x["start"] - at), F.element_at(marks, x["kind"] + 1))).otherwise("")

    whole = F.concat(F.concat_ws("", F.transform(F.col(spans), piece)), F.substring(t, F.array_max(ends) + 1, F.length(t)))
    out = found.withColumn(spans, accepted(F.col(name), model)).withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t))
    chars = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    if chars is not None:
        out = out.withColumn(chars, F.when(F.size(spans) > 0, F.length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
