"""PII: patterns propose spans, checksums confirm them, nearby words adjust the score.  DataFrame functions only.

A kind's matches are the leftmost, non-overlapping ones of its pattern.  Spark
gives matches and the pieces between them; positions are running sums of their
lengths, taken in two levels so a text with n matches costs n * 128 steps.
Patterns use possessive repeats and may only start where a run starts, so a long
run of one class of characters is scanned once and the regex engine never
recurses.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import kern

_STEP = 128
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words that speak for a kind when they stand within CONTEXT characters before a span (fixed values).
CONTEXT = 40
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|mobile|cell|call|fax|telefon|portable|teléfono|téléphone",
    "iban": "iban|account|konto|compte|cuenta|bank",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10, the remainder by 97 is 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """pattern: Java regular expression; gate: a cheap test of the text; valid: test of a match; score before context; added: not one of the base kinds."""

    name: str
    pattern: str
    gate: str
    valid: Callable[[Column], Column]
    score: float
    added: bool = False


_L = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_L})|\G){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", "[0-9]", lambda m: luhn(_digits(m)), 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", lambda m: F.length(_digits(m)).between(8, 15), 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "[0-9]", lambda m: mod97(F.regexp_replace(m, " ", "")), 0.9, True),
    # without a country code only words before it make a number a phone number
    Kind("phone", r"(?<![0-9+().-])(?<![0-9+)][\x20])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]", lambda m: F.lit(True), 0.3, True),
)
#: Spans below it are dropped; base kinds start above it, whatever their context.
THRESHOLD = 0.5
_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"


def _find(text: Column, kind: Kind) -> Column:
    """The spans of one kind, in order."""

    def spans(m: Column, pieces: Column) -> Column:
        n = F.size(m)

        def total(part: Column) -> Column:
            return F.aggregate(part, F.lit(0).cast("long"), lambda a, s: a + s["a"] + s["b"])

        def place(st: Column) -> Column:
            def levels(base: Column) -> Column:
                def one(s: Column, i: Column) -> Column:
                    lo = F.floor(i / _STEP).cast("int")
                    start = F.get(base, lo) + total(F.slice(st, lo * _STEP + 1, i % _STEP)) + s["a"]
                    near = s["before"].rlike(rf"(?iu)\b(?:{CONTEXT_WORDS[kind.name]})\b")
                    return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + s["b"]).alias("end"), F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, 0.3).otherwise(0.0)).alias("score"), s["m"].alias("m"))

                return F.transform(st, one)

            steps = F.aggregate(
                F.sequence(F.lit(0), F.floor((n - 1) / _STEP).cast("int")), F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(st, c * _STEP + 1, F.lit(_STEP)))))
            )
            return _let(steps, levels)

        st = F.zip_with(
            F.slice(pieces, F.lit(1), n), m, lambda p, x: F.struct(F.length(p).cast("long").alias("a"), F.length(x).cast("long").alias("b"), F.right(p, F.lit(CONTEXT)).alias("before"), x.alias("m"))
        )
        return F.when(n > 0, _let(st, place))

    def valid(found: Column) -> Column:
        good = F.filter(found, lambda s: kind.valid(s["m"]) & (s["score"] >= THRESHOLD))
        return F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    pat = F.lit(kind.pattern)
    both = F.struct(F.regexp_extract_all(text, pat, F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    found = _let(both, lambda s: valid(spans(s["m"], s["p"])))
    return F.coalesce(F.when(text.rlike(kind.gate), found), F.array().cast(_TYPE))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _found(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs with the spans of each kind in columns of fresh names, and the base spans and all spans as columns over them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = [kern.fresh(docs.columns, f"_k{i}") for i in range(len(KINDS))]
    d = docs.select(*kern.cols(docs.columns), *[_find(text, k).alias(h) for h, k in zip(held, KINDS)])
    base = F.concat(*[F.col(h) for h, k in zip(held, KINDS) if not k.added])
    parts = []
    for name in dict.fromkeys(k.name for k in KINDS):
        own = [F.col(h) for h, k in zip(held, KINDS) if k.name == name and not k.added]
        more = [F.col(h) for h, k in zip(held, KINDS) if k.name == name and k.added]
        if own and more:
            more = [_apart(x, own[0]) for x in more]
        parts.append(F.array_sort(F.concat(*own, *more), lambda a, b: (a["start"] - b["start"]).cast("int")) if more and own else (own + more)[0])
    return d, base, F.concat(*parts)


def detect(docs: DataFrame) -> DataFrame:
    """docs with base (spans of the base kinds) and spans (all; by kind, then start): arrays of kind, start, end (code points, end exclusive), score.

    Null or empty text has no spans.  Added spans that overlap a base span of the same
    kind are left out.  Rows repeat as they come; an empty table gives an empty table.
    Columns of docs named base or spans are replaced, all others stay.
    """
    names = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    d, base, spans = _found(docs.select(*kern.cols(names)))
    return d.select(*kern.cols(names), base.alias("base"), spans.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text."""
    d = detect(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return d.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _running_end(s: Column) -> Column:
    """The largest end of the spans before each one, 0 for the first and one more for all; in two levels, as positions are."""
    most = lambda part, at: F.aggregate(part, at, lambda a, p: F.greatest(a, p["end"]))
    chunks = F.sequence(F.lit(0), F.floor(F.size(s) / _STEP).cast("int"))
    level = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.concat(acc, F.array(most(F.slice(s, c * _STEP + 1, F.lit(_STEP)), F.element_at(acc, -1)))))

    def one(level: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: most(F.slice(s, i - i % _STEP + 1, i % _STEP), F.get(level, F.floor(i / _STEP).cast("int"))))

    return _let(level, one)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets and n_chars, if there, set to the new length.

    Spans may overlap or lie inside others, in any number: no character of a span stays.  Null
    and empty texts and texts without spans stay as they are; all other columns stay, whatever
    their names.  Rows repeat as they come; an empty table gives an empty table.
    """
    names = docs.columns
    d, _, spans = _found(docs)
    held, new = kern.fresh(d.columns, "_spans"), kern.fresh(d.columns, "_new")
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"])).otherwise(b["end"] - a["end"]).cast("int"))
    d = d.withColumn(held, by_start)

    def rebuild(s: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            def cut(x: Column, i: Column) -> Column:
                past = F.get(ends, i)
                piece = F.substr(F.col("text"), (past + 1).cast("int"), F.greatest(F.lit(0), x["start"] - past).cast("int"))
                return F.concat(piece, F.when(x["end"] > past, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit("")))

            return F.concat(F.array_join(F.transform(s, cut), ""), F.substr(F.col("text"), (F.element_at(ends, -1) + 1).cast("int")))

        return _let(_running_end(s), with_ends)

    some = F.size(held) > 0
    d = d.withColumn(new, F.when(some, _let(F.col(held), rebuild)).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)

    def out(c: str) -> Column:
        if c == "text":
            return F.col(new).alias("text")
        return F.when(some, F.length(new)).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c == "n_chars" else kern.cols([c])[0]

    return d.select(*[out(c) for c in names])
