"""Quality rules: learned decision lists over native text statistics.

``features`` computes a text's statistics with DataFrame functions.  ``learn``
fits an ordered list of rules from labelled statistics by sequential covering:
a rule is a conjunction of threshold conditions, grown one condition at a time
by information gain on two thirds of the rows and pruned from its end on the
other third; rows that a rule covers leave, and the next rule is learned from
the rest, until no rule is precise enough.  ``verdict`` emits the list as an
ordered Spark CASE WHEN expression: the first rule that holds rejects a text.

Learning takes a bounded sample of the labelled rows (``SAMPLE_ROWS``), chosen
by a hash of doc_id; only their statistics (a few numbers each) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.llm import common

#: Labelled rows that learning takes at most (in expectation; a hash decides).
SAMPLE_ROWS = 20_000
#: Conditions of a rule, rules of a list, quantiles tried as thresholds.
MOST_CONDITIONS, MOST_RULES, QUANTILES = 4, 24, 64
#: A rule must be right on this share of the pruning rows it covers, and cover so many rows.
LEAST_PRECISION, LEAST_COVER = 0.9, 5
LEAST_WORDS, MOST_REPEATED = 50, 50
# White space, symbols.
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "[#*$%&|<>]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules test: base counts as shares, so that they fit texts of any length.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
            "distinct_share", "upper_share", "mark_share", "digit_share", "words_per_line")


def _count(text: str, pattern: str) -> Column:
    """Characters of a class in a text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _repeated(triples: str, ordered: str) -> Column:
    """Words inside 3-word windows that stand twice or more in the text.

    ``ordered`` has (window hash, place) of every window by hash, null where all
    windows differ.  Equal neighbours are repeats; a window covers three words, of
    which those up to the next repeated window count for it.
    """
    last = F.size(ordered) - 1
    places = F.sort_array(F.transform(F.filter(
        ordered, lambda s, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == s["h"]))
        | ((j < last) & (F.get(ordered, j + 1)["h"] == s["h"]))), lambda s: s["at"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda acc, at: F.struct(
        (acc["n"] + F.least(F.lit(3), at - acc["at"])).alias("n"), at.alias("at")), lambda acc: acc["n"])
    return F.when(F.col(ordered).isNull(), F.lit(0)).otherwise(covered)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__q``: a struct of the base counts and ``FEATURES`` of whole texts.

    A null text has no words.  Each step is a column of its own, so that it is
    computed once a row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__row"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(_BLANKS))
    rows = rows.withColumn("w", F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACE, -1)
                                       ).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({
        "n_words": F.size("w"),
        "h": F.when(F.size("w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0),
        "distinct": F.size(F.array_distinct("w")),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": _count("t", _SYMBOLS),
        "upper": _count("t", "[A-ZÀ-ÖØ-Þ]"),
        "marks": _count("t", "[!?=~^]"),
        "digits": _count("t", "[0-9]")})
    rows = rows.withColumns({
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "ordered": F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform(
            "h", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))})
    rows = rows.withColumn("n_repeat_words", _repeated("h", "ordered"))

    def share(of, whole):
        return F.col(of) / F.greatest(F.col(whole), F.lit(1))

    # a generator of one row keeps filters on the statistics above them: pushed below,
    # their expressions would be merged and computed again for every word
    return rows.select("__row", F.explode(F.array(F.struct(
        *(F.col(c).cast("long").alias(c) for c in BASE),
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("distinct", "n_words").alias("distinct_share"), share("upper", "word_chars").alias("upper_share"),
        share("marks", "n_words").alias("mark_share"), share("digits", "word_chars").alias("digit_share"),
        share("n_words", "n_lines").alias("words_per_line")))).alias("__q")).select("__row.*", "__q")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.bound if self.above else v <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions added by information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, name in enumerate(FEATURES):
            v, y = x[inside, f], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            bounds = np.unique(np.quantile(v, np.linspace(0, 1, QUANTILES + 1)))
            at = np.searchsorted(v, bounds, side="right")
            p = np.concatenate([[0], np.cumsum(y)])[at].astype(float)
            n = at - p
            for above in (False, True):
                pp, nn = (p0 - p, n0 - n) if above else (p, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    # halfway to the next value, so that near values fall on the same side
                    above_it = v[at[k]] if at[k] < len(v) else bounds[k]
                    best = (gain[k], Condition(name, above, float((bounds[k] + above_it) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on."""
    def worth(r):
        inside = _covers(r, x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """Ordered rules that reject, by sequential covering."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    while bad.any() and (~bad).any() and len(rules) < MOST_RULES:
        grow = rng.random(len(x)) < 2 / 3
        if not (grow & bad).any() or not (~grow & bad).any():
            break
        rule = _prune(_grow(x[grow], bad[grow]), x[~grow], bad[~grow])
        inside = _covers(rule, x)
        test = inside & ~grow
        if not rule or inside.sum() < LEAST_COVER or not test.any() or bad[test].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        x, bad = x[~inside], bad[~inside]
    return rules


def verdict(rules: list[Rule], q: str = "__q") -> Column:
    """Number of the first rule that holds, 0 if none: an ordered CASE WHEN."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            v = F.col(f"{q}.{c.feature}")
            holds = holds & (v > c.bound if c.above else v <= c.bound)
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(q: str = "__q") -> Column:
    n, repeated = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules learned from labelled documents that the base tests pass (``labels.quality``
    0 is bad).  Rows of null doc_id or label take no part; of a document labelled
    twice the smaller label counts, of rows of one doc_id the first text in order.  Without both classes there are no rules."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
             .filter("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < max(1, int(rows / n * (1 << 20))))
    chosen = (docs.select("doc_id", "text").join(known, "doc_id")
              .groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    got = (features(chosen).filter(~base_failed())
           .select("doc_id", "quality", *(F.col(f"__q.{f}").cast("double").alias(f) for f in FEATURES))
           .orderBy("doc_id", *FEATURES).collect())
    x = np.array([r[2:] for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r.quality == 0 for r in got], bool))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``__q``, ``__failed`` (base tests) and ``__rule`` (first rule that holds or 0)."""
    return features(docs).withColumns({"__failed": base_failed(), "__rule": verdict(rules)})


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept and the
    number of the rule that rejects (0: none)."""
    out = judged(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", *(F.col(f"__q.{c}").alias(c) for c in BASE),
                      F.col("__failed").alias("base_failed"),
                      (~F.col("__failed") & (F.col("__rule") == 0)).alias("kept"),
                      F.col("__rule").alias("rule"))


def kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of ``docs`` that the base tests and the rules keep, columns as they are (in a
    struct meanwhile, so that they may have any names)."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return judged(rows, rules).filter(~F.col("__failed") & (F.col("__rule") == 0)).select("row.*")
