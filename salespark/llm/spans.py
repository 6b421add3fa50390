"""Spans of pattern matches in whole texts, with DataFrame functions only.

A pattern's matches and the text between them (``split`` with the same pattern)
alternate, so running sums of their lengths are the code point positions of the
matches: leftmost, non-overlapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,match:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def located(df: DataFrame, kinds: list[tuple[str, str, Column]], text: str = "text") -> DataFrame:
    """Adds a column ``s_<kind>`` of spans for each (kind, Java pattern, may hold).

    ``may hold`` is a cheap condition without which no match is possible.  The
    three steps are columns of their own, so that each is computed once a row.
    """
    found = df.withColumns({
        f"m_{kind}": F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        for kind, pattern, may in kinds})
    parts = found.withColumns({
        f"g_{kind}": F.when(F.size(f"m_{kind}") > 0, F.split(F.col(text), pattern, -1))
        for kind, pattern, _ in kinds})
    pairs = parts.withColumns({f"p_{kind}": F.when(F.size(f"m_{kind}") > 0, F.zip_with(
        F.slice(f"g_{kind}", F.lit(1), F.size(f"m_{kind}")), f"m_{kind}",
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))))
        for kind, _, _ in kinds})
    spans = pairs.withColumns({f"s_{kind}": _positions(kind, order) for order, (kind, _, _) in enumerate(kinds)})
    return spans.drop(*(f"{p}_{kind}" for kind, _, _ in kinds for p in "mgp"))


#: Matches that are put in place at a time: growing one long array is quadratic.
_BLOCK = 128


def _positions(kind: str, order: int) -> Column:
    pairs = f"p_{kind}"

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc, b):
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["at"], F.lit(0))
        part = F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK))
        return F.concat(acc, F.array(F.aggregate(
            part, F.struct(at.alias("at"), no_spans().alias("out")), step)))

    none = F.array().cast(f"array<struct<at:int,out:{SPAN}>>")
    blocks = F.sequence(F.lit(0), ((F.size(pairs) - 1) / _BLOCK).cast("int"))
    return F.when(F.size(pairs) > 0, F.aggregate(
        blocks, none, block, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))
    ).otherwise(no_spans())


def of_kind(kind: str):
    """Condition on a span: its kind."""
    return lambda span: span["kind"] == kind


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def around(text: Column, span: Column, reach: int) -> Column:
    """Lower-case text from ``reach`` code points before a span to as many after."""
    start = F.greatest(span["start"] - F.lit(reach), F.lit(0))
    return F.lower(F.substring(text, start + 1, span["end"] - start + F.lit(reach)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """Text with every span (sorted by start; overlaps merge) put to ``mark``."""
    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, none, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
