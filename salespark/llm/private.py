"""Personal data: patterns propose spans, checksums confirm, context words score.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped):
email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits).  They always stay.  The method adds ``iban`` (mod 97) and ``ssn`` (area,
group and serial in range).  Every span has a score: its kind's prior, more for
a confirmed checksum, more or less for context words within ``REACH`` code
points.  Added spans stay from ``LEAST_SCORE`` on.

The patterns are written so that a long run without a match is passed once:
possessive repeats, and starts only where a run begins.  All of it is built from
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.llm import spans

# The base patterns (in possessive form), the checked kinds, context words.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
PRIORS = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.5, "iban": 0.5, "ssn": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}
NEARBY = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "expires"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "taxpayer", "tax id"),
}
AGAINST = {
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "serial", "tracking"),
    "phone": ("total", "sum", "score"),
    "ssn": ("part number", "order", "model"),
}
REACH, FOR, LESS, LEAST_SCORE = 40, 0.3, -0.2, 0.6

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Whether an IBAN's check digits hold: moved to the end, letters as 10..35, remainder 1."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)),
                     F.substring(plain, 1, 4))

    def step(acc, i):
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _words(words) -> str:
    return r"(?<!\p{L})(?:" + "|".join(words) + r")"


def _score(kind: str, span: Column, text: Column) -> Column:
    near = spans.around(text, span, REACH)
    score = F.lit(PRIORS[kind] + CHECKED.get(kind, 0.0)) + F.when(near.rlike(_words(NEARBY[kind])), FOR).otherwise(0.0)
    if kind in AGAINST:
        score = score + F.when(near.rlike(_words(AGAINST[kind])), LESS).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def find(docs: DataFrame) -> DataFrame:
    """Adds ``private_spans`` to ``docs``: array of (start, ord, end, kind, match, score),
    by start, then kind.  Positions are code points, end exclusive.  A null text is
    empty and has no spans.  Columns of ``docs`` stay as they are (a column of the
    same name gives way)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("private_spans").select(F.struct("*").alias("__row"), text.alias("__text"))
    may = {"email": F.instr("__text", "@") > 0, "phone": F.instr("__text", "+") > 0,
           "ip": F.instr("__text", ".") > 0, "ssn": F.instr("__text", "-") > 0}
    rows = spans.located(rows, [(k, p, may.get(k, F.lit(True))) for k, p in PATTERNS.items()], "__text")
    whole = F.col("__text")

    def checked(kind):
        kept = F.filter(f"s_{kind}", lambda s: _valid(kind, s["match"]))
        scored = F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"),
            s["match"].alias("match"), _score(kind, s, whole).alias("score")))
        return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)

    some = sum((F.size(f"s_{k}") for k in PATTERNS), F.lit(0)) > 0
    found = F.when(some, F.sort_array(F.concat(*map(checked, PATTERNS))))
    return (rows.withColumn("private_spans", found).select("__row.*", "private_spans")
            .withColumn("private_spans", F.coalesce("private_spans", F.array().cast(
                spans.SPAN.replace("match:string", "match:string,score:double")))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans and their scores."""
    all_spans = F.col("private_spans")
    base = F.filter(all_spans, lambda s: s["kind"].isin(*BASE))
    count = {k: F.size(F.filter(all_spans, spans.of_kind(k))).cast("long") for k in BASE}
    return found.select(
        "doc_id", *(c.alias(f"n_{k}") for k, c in count.items()),
        F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(all_spans).alias("spans"),
        F.transform(all_spans, lambda s: s["score"]).alias("scores"))
