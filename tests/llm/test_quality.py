"""Text statistics against plain counts; learned rules on known concepts."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from salespark.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_statistics(spark, docs, texts):
    random.seed(1)
    rows = [(10**6 + i, "".join(random.choice(["a ", "b ", "c\n", "\n", "#", " ", "\t", "é ", "🙂", "a b c ", "\x0b"])
                                for _ in range(random.randint(0, 60)))) for i in range(800)]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "x y z " * 5000)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(made)
    known = dict(rows) | texts
    for r in quality.judged(both, []).select("doc_id", "__q.*", "__failed").collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r["__failed"])
        assert got == plain(known[r.doc_id]), r.doc_id


def test_learns_ordered_rules():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    f = quality.FEATURES.index
    bad = (x[:, f("symbol_share")] > 0.8) | ((x[:, f("upper_share")] > 0.7) & (x[:, f("distinct_share")] <= 0.4))
    rules = quality.learn(x, bad)
    covered = np.zeros(len(x), bool)
    for rule in rules:
        covered |= quality._covers(rule, x)
    assert (covered == bad).mean() > 0.98 and 2 <= len(rules) <= quality.MOST_RULES
    assert quality.learn(x, np.zeros(len(x), bool)) == []
    assert quality.learn(x, rng.random(len(x)) < 0.1) == []  # noise gives no rule
    assert quality.learn(x[:0], bad[:0]) == []


def test_verdict_is_the_first_rule_that_holds(spark):
    rules = [(quality.Condition("n_words", True, 5.0), quality.Condition("mean_word", False, 2.0)),
             (quality.Condition("n_words", True, 3.0),)]
    df = spark.createDataFrame([(6, 1.0), (6, 3.0), (2, 1.0)], "n_words int, mean_word double")
    df = df.select(F.struct("*").alias("__q"))
    assert [r.v for r in df.select(quality.verdict(rules).alias("v")).collect()] == [1, 2, 0]


def test_held_out_verdicts(docs, labels):
    rules = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    out = quality.judged(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), rules)
    rows = out.filter("not __failed").select("quality", "__rule").collect()
    assert np.mean([(r["__rule"] > 0) == (r.quality == 0) for r in rows]) > 0.9
    assert np.mean([r["__rule"] == 0 for r in rows if r.quality == 1]) > 0.95


def test_edges(spark, edge_docs, no_docs, labels):
    assert quality.quality(edge_docs, labels).count() == edge_docs.count()
    assert quality.kept(edge_docs, []).columns == edge_docs.columns
    assert quality.quality(no_docs, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(edge_docs, none) == []


def test_plan_computes_statistics_once(docs):
    """A filter on the statistics stays above them, and no Python runs."""
    plan = quality.kept(docs, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate explode") and plan.count("xxhash64") == 1
    assert not re.search("Python|Arrow|Pandas", plan)
