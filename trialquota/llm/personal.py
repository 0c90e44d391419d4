"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

All patterns run inside the JVM and are written so that no text, however long,
makes them rescan: a run is consumed whole (possessive), and a match begins
where a run begins or where the match before ended.  A span's place is the
length of the text between the matches before it, in code points.

Score: a prior per kind, plus a bonus when a checksum or range confirms the
span and one when a context word of its kind stands nearby.  Base kinds (email,
ip, card, phone) stay whatever their score; added kinds (iban, ssn) need
``MIN_SCORE``.

Defined cases: a null or empty text has no spans; texts are searched whole;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT = 40
MIN_SCORE = 0.5
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def any_of(*words: str) -> str:
    return r"(?i)(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def ip_in_range(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


def card_number(value: Column) -> Column:
    number = digits(value)
    return F.length(number).between(13, 19) & F.call_function("luhn_check", number)


def phone_length(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def mod_97(value: Column) -> Column:
    """ISO 7064: the number with its first four characters moved to the end leaves 1."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, character: Column) -> Column:
        code = F.ascii(character)
        digit = code < 58
        return F.when(digit, rest * 10 + (code - 48)).otherwise(rest * 100 + (code - 55)) % 97

    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), step) == 1


def always(value: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap necessary condition on the text.
    guard: str
    valid: Callable[[Column], Column]
    prior: float
    confirmed: float
    context: str
    base: bool = True


NAME = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", always, 0.7, 0.0,
         any_of("e-?mail", "mail", "contact", "write", "correo", "courriel", "kontakt")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"t RLIKE '[0-9][.][0-9]'", ip_in_range, 0.3, 0.3,
         any_of("ip", "host", "server", "address", "login", "adresse", "servidor")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"t RLIKE '[0-9](?:[ -]?[0-9]){12}'", card_number, 0.2, 0.5,
         any_of("card", "visa", "credit", "payment", "carte", "karte", "tarjeta")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains(t, '+')", phone_length, 0.5, 0.1,
         any_of("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", r"t RLIKE '[A-Z]{2}[0-9]{2}'", mod_97, 0.2, 0.5,
         any_of("iban", "account", "bank", "konto", "compte", "cuenta"), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"t RLIKE '[0-9]-[0-9]{2}-[0-9]'", always, 0.3, 0.0,
         any_of("ssn", "social security"), False),
)
CONTEXT_BONUS = 0.2


def kind_spans(kind: Kind) -> Column:
    """Spans of one kind in the column ``t``, valid ones only."""
    text, pattern = F.col("t"), F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    steps = F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"))
    )
    placed = "array<struct<value:string,start:int,end:int>>"
    seed = F.struct(F.lit(0).alias("at"), F.array().cast(placed).alias("spans"))

    def place(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + F.length(step["value"])
        span = F.struct(step["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(steps, seed, place, lambda done: done["spans"])

    def scored(span: Column) -> Column:
        begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, begin + 1, span["start"] - begin)
        after = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
        near = F.rlike(F.concat(before, F.lit(" \n "), after), F.lit(kind.context))
        score = F.lit(kind.prior + kind.confirmed) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), score.alias("score"))

    found = F.transform(F.filter(spans, lambda s: kind.valid(s["value"])), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    return F.when(F.expr(kind.guard), found).otherwise(F.array()).cast(SPAN)


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans per kind): arrays of (kind, start, end, value, score)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Most texts hold neither a digit nor an at sign; the scan for them is the only work on those.
    seen = rows.withColumn("t", F.when(F.rlike("t", F.lit("[0-9@]")), F.col("t")).otherwise(""))
    return seen.select("doc_id", *[kind_spans(k).alias(k.name) for k in KINDS])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans as text."""

    def joined(kinds: list[str]) -> Column:
        spans = F.concat(*[F.col(k) for k in kinds])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = find_spans(docs, doc_id, text)
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined([k.name for k in KINDS]).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.concat(*[F.col(k.name) for k in KINDS]), lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
