"""Secret scan: patterns, and sliding-window entropy of candidate strings.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped):
assign (a password, secret, token or key set to a value of 8 or more characters),
access (AKIA and in all 16 or more characters), hex (32 or more hex digits).
They always stay.

The method adds ``entropy`` spans.  Candidates are runs of ``SHORTEST`` or more
characters of the base64 alphabet.  Each has a character class (hex digits;
letters and digits; base64 with marks) and passes if the largest Shannon entropy
of its windows of ``WINDOW`` characters reaches the class's bound.  The entropy
is updated from window to window: one character enters, one leaves, and only
their counts change.  Candidates that an allow-list pattern matches (identifiers,
paths, plain words, documentation examples) or that lie within a base span are
suppressed.  All of it is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.llm import spans

# The base patterns (in possessive form), the alphabet, bounds and allow-list.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
          r"([A-Za-z0-9+/_.=-]++)")
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "entropy": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SHORTEST = WINDOW = 20
#: (class, pattern of the whole candidate, least entropy of a window in bits a character)
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
)
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z_=/+-]+$",  # no digit: words, rules, paths
    r"^[0-9+/_=-]+$",  # no letter: numbers, dates, rules
    r"(?i)example|placeholder|changeme|redacted|dummy|xxxx",
    r"(?i)0123456789|abcdefghij",
    r"^(?:[A-Za-z]+[-_/=]|[0-9]+[-_/=])+(?:[A-Za-z]+|[0-9]+)$",  # words and numbers joined by marks
)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of a string's windows.

    The state is the count of every character of the alphabet, the sum of
    c * log2(c) over the counts (in units of 2^-32, so that it never drifts) and its
    least value over whole windows.  A step moves the window by one character: one
    enters, one leaves, and the sum changes by their counts' parts alone.  The
    characters' places in the alphabet are looked up once, so time is linear in the
    string's length.
    """
    part = F.array(*[F.lit(round(c * math.log2(c) * 2 ** 32) if c > 1 else 0).cast("long") for c in range(window + 2)])
    places = F.transform(F.split(text, "", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    enter = F.slice(places, F.lit(1), F.length(text))  # split may leave an empty text behind
    leave = F.concat(F.array_repeat(F.lit(-1), F.least(F.length(text), F.lit(window))),
                     F.slice(places, F.lit(1), F.greatest(F.length(text) - window, F.lit(0))))
    moves = F.zip_with(enter, leave, lambda e, gone: F.struct(e.alias("enter"), gone.alias("leave")))

    def step(acc, move):
        more, less = F.get(acc["counts"], move["enter"]), F.get(acc["counts"], F.greatest(move["leave"], F.lit(0)))
        entered = F.get(part, more + 1) - F.get(part, more)
        left = F.when(move["leave"] >= 0, F.get(part, less) - F.get(part, less - 1)).otherwise(F.lit(0).cast("long"))
        total = F.when(move["enter"] == move["leave"], acc["total"]).otherwise(acc["total"] + entered - left)
        held = F.least(acc["held"] + 1, F.lit(window))
        return F.struct(
            F.transform(acc["counts"], lambda c, k: c + F.when(k == move["enter"], 1).otherwise(0)
                        - F.when(k == move["leave"], 1).otherwise(0)).alias("counts"),
            total.alias("total"), held.alias("held"),
            F.when(held == window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"),
                     F.lit(0).alias("held"), F.lit(2 ** 62).cast("long").alias("least"))
    return F.aggregate(moves, start, step, lambda acc: F.when(acc["held"] < window, F.lit(0.0)).otherwise(
        F.lit(math.log2(window)) - acc["least"].cast("double") / F.lit(float(window * 2 ** 32))))


def _valid(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 1)) >= LEAST_VALUE
    if kind != "entropy":
        return F.lit(True)
    bound = F.lit(99.0)
    for _, pattern, least in reversed(CLASSES):
        bound = F.when(match.rlike(pattern), least).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(match) >= bound)


def find(docs: DataFrame) -> DataFrame:
    """Adds ``secret_spans`` to ``docs``: array of (start, ord, end, kind, match), by
    start, then kind.  Positions are code points, end exclusive.  A null text is
    empty and has no spans.  Columns of ``docs`` stay as they are (a column of the
    same name gives way)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("secret_spans").select(F.struct("*").alias("__row"), text.alias("__text"))
    may = {"access": F.instr("__text", "AKIA") > 0, "assign": (F.instr("__text", "=") > 0) | (F.instr("__text", ":") > 0)}
    rows = spans.located(rows, [(k, p, may.get(k, F.lit(True))) for k, p in PATTERNS.items()], "__text")
    def valid(kind):
        return F.filter(f"s_{kind}", lambda s: _valid(kind, s["match"]))

    rows = rows.withColumn("__base", F.when(
        sum((F.size(f"s_{k}") for k in BASE), F.lit(0)) > 0, F.concat(*map(valid, BASE))
    ).otherwise(spans.no_spans()))
    rows = rows.withColumn("__more", F.when(F.size("s_entropy") > 0, F.filter(
        F.filter("s_entropy", lambda s: ~F.exists(
            "__base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))),
        lambda s: _valid("entropy", s["match"]))).otherwise(spans.no_spans()))
    return rows.withColumn("secret_spans", F.sort_array(F.concat("__base", "__more"))).select(
        "__row.*", "secret_spans")


def redacted(found: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` put to ``mark``; the spans are dropped."""
    text = F.when(F.size("secret_spans") > 0, spans.replaced(F.col("text"), F.col("secret_spans"), mark)
                  ).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("secret_spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and all spans."""
    all_spans = F.col("secret_spans")
    base = F.filter(all_spans, lambda s: s["kind"].isin(*BASE))
    count = {k: F.size(F.filter(all_spans, spans.of_kind(k))).cast("long") for k in BASE}
    return found.select(
        "doc_id", *(c.alias(f"n_{k}") for k, c in count.items()),
        F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(all_spans).alias("spans"))
