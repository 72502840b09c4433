"""Personal data: weak labelers vote on spans, EM weighs them, a classifier decides.

All work over rows is SQL: regular expressions find candidate spans, labelers (strict
form, gazetteer, context, what it is glued to, structure) vote yes, no or nothing on
each.  The gazetteer looks the span itself up: top-level domains, issuer and calling
codes, reserved networks; the context labeler reads cue words before the span.  The
votes of all candidates are counted by pattern, with the shape of the span (length,
separators, place in its line), so the table has at most ``len(KINDS) * 3 ** LABELERS *
SHAPES`` rows whatever the input.  Expectation-maximisation over it estimates each
labeler's reliability, and its posteriors train a logistic classifier on votes and
shapes whose weights go back into SQL.  Spans that meet the fixed definitions are
always kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import keep

KINDS = ("email", "ip", "card", "phone")
#: Labelers, features of a span's shape, and how many shapes there are.
LABELERS, FEATURES, SHAPES = 5, 4, 12

#: The fixed definitions.  A leading ``(?<!x)|\G`` only forbids starts in the middle of
#: a run, which a leftmost search never takes, and keeps the search linear.  A card is
#: a whole run of 14 to 19 digits with single separators; longer runs fail by
#: definition, so the repetition is bounded.  Possessive repetition of a group keeps the
#: search off the stack.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+(?:\.[0-9]+){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, tried beside the definitions.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z.])(?<![0-9][ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9A-Za-z]|[ -][0-9])",
}
#: Cue words (fixed lists) looked for in the characters before a span.
_CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|mailto)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b",
}
_NOT_CUES = r"(?i)(?:version|ver\.|release|isbn|section|fig\.|key ?=|token ?=|hash|sha1|serial|order no)\W{0,3}$"
#: Gazetteers (fixed lists): generic top-level domains, beginnings of card numbers by
#: issuer, country calling codes, networks that are no one's address.
_TOP_DOMAINS = "com org net edu gov mil int info biz name pro museum aero coop jobs mobi travel asia cat tel io app dev online site xyz"
_COUNTRIES = "at au be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr mx nl no nz pl pt ro ru se sg tr tw ua uk us za"
_ISSUERS = r"(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|35(?:2[89]|[3-8])|6(?:011|4[4-9]|5))"
_CALLING = r"(?:1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))"
_RESERVED = r"(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-4])\."
_CONTEXT = 24
_BLOCK = 128


def _running(lens: Column) -> Column:
    """Sums of the elements before each one; the work is linear but for blocks of ``_BLOCK``."""
    none = F.array().cast("array<int>")

    def prefix(values: Column, first: Column) -> Column:
        zero = F.struct(first.cast("int").alias("at"), none.alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, zero, step, lambda a: a["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / _BLOCK).cast("int"))
    part = lambda i: F.slice(lens, i * _BLOCK + 1, F.lit(_BLOCK))
    sums = F.transform(blocks, lambda i: F.aggregate(part(i), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, prefix(sums, F.lit(0)), lambda i, s: prefix(part(i), s)))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (s, m): where each match of ``pattern`` starts (code points from 0), and its text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lens = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, m: F.length(a) + F.length(m))
    ends = F.zip_with(_running(lens), lens, lambda a, n: a + n)
    return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), m.alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(a: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _holds(kind: str, m: Column) -> Column:
    """Whether a match of the definition's pattern meets the rest of the definition."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _structure(kind: str, m: Column) -> Column:
    """Vote of the checksum or structure labeler."""
    if kind == "email":
        return F.when(m.rlike(r"^[.]|[.]@|[.][.]|@-|-[.]|-$"), -1).when(m.rlike(r"^[^@]{1,64}@[^@]+$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), 0).when(m.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1)
    if kind == "card":
        return F.when(_luhn(m), 1).otherwise(-1)
    return F.when(F.length(_digits(m)).between(10, 15), 1).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    """Vote of the gazetteer: whether the span itself is listed."""
    if kind == "email":
        known = "|".join(f"{_TOP_DOMAINS} {_COUNTRIES}".split())
        return F.when(m.rlike(rf"(?i)(?:\.|dot ?[\])]) ?(?:{known})$"), 1).when(m.rlike(r"(?i)\.(?:png|jpg|gif|svg|js|css|py|txt|html|local|invalid|example)$|@[0-9.]+$"), -1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(rf"^{_RESERVED}"), -1).otherwise(0)
    if kind == "card":
        return F.when(_digits(m).rlike(rf"^{_ISSUERS}"), 1).otherwise(-1)
    return F.when(m.rlike(r"^\+"), F.when(_digits(m).rlike(rf"^{_CALLING}"), 1).otherwise(-1)).when(_digits(m).rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)


def _votes(kind: str, text: Column, x: Column, base: Column) -> list[Column]:
    """The labelers' votes on a span, then its shape: two length bins, mixed separators, start of a line."""
    m = x["m"]
    before = F.substring(text, F.greatest(x["s"] - _CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(_CONTEXT)))
    after = F.substring(text, x["s"] + F.length(m) + 1, F.lit(1))
    strict = F.when(base, 1).otherwise(0)
    cue = F.when(before.rlike(_CUES[kind]), 1).when(before.rlike(_NOT_CUES), -1).otherwise(0)
    glued = before.rlike(r"""[A-Za-z0-9=/_"']$""") | after.rlike(r"""[A-Za-z0-9=/_"']""")
    size, first = F.length(m), (x["s"] == 0) | before.rlike(r"\n$")
    mixed = (m.contains(" ").cast("int") + m.contains("-").cast("int") + m.contains(".").cast("int")) > 1
    shape = [(size >= 13).cast("int"), (size >= 18).cast("int"), mixed.cast("int"), first.cast("int")]
    return [strict, _gazetteer(kind, m), cue, F.when(glued, -1).otherwise(1), _structure(kind, m), *shape]


def _span(kind: str, loose: bool, text: Column) -> Callable[[Column], Column]:
    """What becomes of a match: its place and the labelers' votes."""

    def made(x: Column) -> Column:
        base = F.lit(False) if loose else _holds(kind, x["m"])
        votes = _votes(kind, text, x, base)
        return F.struct(
            x["s"].cast("int").alias("s"),
            F.lit(KINDS.index(kind)).alias("k"),
            (x["s"] + F.length(x["m"])).cast("int").alias("e"),
            base.alias("base"),
            *[v.cast("int").alias(f"v{n + 1}") for n, v in enumerate(votes)],
        )

    return made


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, c): per row, its candidate spans (s, k, e, base, v1..v9), ordered by start, then kind."""
    text = F.col("t")
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    digit = text.rlike("[0-9]")
    gate = {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": digit & text.contains("+")}
    loose_gate = {"email": text.rlike(r"[\[(] ?at ?[\])]"), "phone": digit, "card": digit}
    votes = ",".join(f"v{n + 1}:int" for n in range(LABELERS + FEATURES))
    none = F.array().cast(f"array<struct<s:int,k:int,e:int,base:boolean,{votes}>>")
    found = []
    for loose, forms in ((False, _BASE), (True, _LOOSE)):
        for kind, pattern in forms.items():
            ask = (loose_gate if loose else gate)[kind] & text.rlike(pattern)

            found.append(F.when(ask, F.transform(_spans(text, pattern), _span(kind, loose, text))).otherwise(none))
    return rows.select("i", F.array_sort(F.concat(*found)).alias("c"))


def learn(patterns: list[tuple], rounds: int = 50) -> list[float]:
    """Weights of the span classifier (bias, then a weight per labeler's vote and per feature).

    ``patterns`` are (votes, features, count).  EM of the two-class model with labelers
    independent given the class: a labeler votes yes, nothing or no with probabilities
    of its own per class.  Then logistic regression on votes and features, each pattern
    weighing its count and labelled by its posterior.
    """
    if not patterns:
        return [-1.0] + [0.0] * (LABELERS + FEATURES)
    table = np.array(patterns, float)
    votes, counts = table[:, :LABELERS], table[:, -1]
    said = [votes == v for v in (-1, 0, 1)]
    post = 1 / (1 + np.exp(-votes.sum(axis=1)))  # start: majority
    for _ in range(rounds):
        prior = ((counts * post).sum() + 1) / (counts.sum() + 2)
        z = math.log(prior / (1 - prior)) + np.zeros(len(votes))
        yes, no = (np.array([(x * w[:, None]).sum(axis=0) + 1 for x in said]) for w in (counts * post, counts * (1 - post)))
        yes[2] += 2.0  # labelers are better than chance
        no[0] += 2.0
        odds = np.log(yes / yes.sum(axis=0)) - np.log(no / no.sum(axis=0))
        for x, v in zip(said, odds):
            z += (x * v).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    x = np.hstack([np.ones((len(table), 1)), table[:, :-1]])
    w = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= ((counts / counts.sum() * (p - post)) @ x + 1e-3 * w)
    return w.tolist()


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, spans): every row's spans (s, k, e, base) by start, then kind; k indexes ``KINDS``.

    Positions are code points from 0, the end exclusive.  Spans that the
    classifier adds overlap no other span.  Null and empty texts have no spans;
    very long texts are searched whole; repeated rows and null ids are kept one
    to one; an empty table gives an empty result; other columns are ignored.
    """
    rows = keep(candidates(docs, id_col, text_col), "pii-candidates")
    every = rows.where(F.size("c") > 0).select(F.explode("c").alias("c")).select("c.*")
    names = [f"v{n + 1}" for n in range(LABELERS + FEATURES)]
    counted = every.groupBy("k", *names).agg(F.count("*").alias("n")).collect()
    weights = [learn(sorted(tuple(r[n] for n in names) + (r["n"],) for r in counted if r["k"] == k)) for k in range(len(KINDS))]

    def score(x: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, w in enumerate(weights):
            out = F.when(x["k"] == k, sum((x[n] * F.lit(a) for n, a in zip(names, w[1:])), F.lit(w[0]))).otherwise(out)
        return out

    cut = math.log(threshold / (1 - threshold))
    base = F.filter("c", lambda x: x["base"])
    free = lambda x, others: ~F.exists(others, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    more = F.filter(F.filter("c", lambda x: ~x["base"] & (score(x) >= cut)), lambda x: free(x, base))
    # of overlapping additions the first by start stays
    kept = F.aggregate(more, F.slice(more, 1, 0), lambda a, x: F.when(free(x, a), F.concat(a, F.array(x))).otherwise(a))
    some = F.exists("c", lambda x: ~x["base"])
    spans = F.when(some, F.array_sort(F.concat(base, kept))).otherwise(F.col("c"))
    return rows.select(F.col("i").alias(id_col), spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.concat_ws(",", said)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row, from ``find``."""
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.filter("spans", lambda x: x["base"] & (x["k"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    found = find(docs, id_col=id_col, text_col=text_col)
    return found.select(id_col, *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
