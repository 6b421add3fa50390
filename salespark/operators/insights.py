"""Rule-based insights as DataFrames: each insight is a one-row fact (kind,
subject, values) plus its rendered sentence, and the facts are unioned.
Questions are tagged with an intent by ordered keyword rules, as a column
expression over a table of questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import band_label_expr, dround, ratio_pct
from . import customers, kpi, products
from .ordered import cache, local_rows
from .profile import MONTH, Profile, sales_profile

INSIGHT_COLUMNS = ["insight_id", "kind", "subject", "detail", "value", "value2", "text"]

# The intent rules in the order they are tried.  A question
# (lower-cased) gets the first intent whose rule matches; ``all_of`` terms
# must all occur and at least one ``any_of`` term must occur.
INTENT_RULES = [
    ("summary", (), ("summarize", "summary", "overview")),
    ("region_growth", ("region",), ("grow", "fastest", "best", "top")),
    ("profit_drivers", (), ("profit fall", "profit drop", "why is profit", "losing money",
                            "margin")),
    ("top_products", (), ("best product", "top product", "best-performing", "best performing")),
    ("worst_products", (), ("worst product", "underperform", "low performing",
                            "low-performing")),
    ("target_customers", (), ("target", "which customers", "best customers", "loyal")),
    ("recommendations", (), ("recommend", "suggestion", "what should we do")),
]
UNKNOWN_INTENT = "unknown"
RETURN_RATE_ALERT_PCT = 8.0
EROSION_POINTS = 5.0

# The sentences of the insight rows, recommendations and answers.  ``%s`` marks a value (already formatted as text), ``%%`` a
# literal percent sign.
TEMPLATES = {
    "revenue_growth": "Later half against earlier half of the period: revenue %s by %s%%.",
    "top_region": "Largest region: %s, with %s%% of all revenue.",
    "repricing_candidate": "Check the price of %s: revenue is $%s, yet its margin of %s%% lies "
                           "under the median.",
    "discount_erosion": "Orders at %s%% margin in the %s discount band drop to %s%% in the %s band: "
                        "the deepest discounts cost margin.",
    "order_value": "An order is worth $%s on average (%s orders, %s customers); %s%% of lines come back.",
    "restock": "Restock: %s products sell fast at a sound margin.",
    "discontinue": "Review for removal: %s products sell slowly at a thin margin.",
    "return_rate_alert": "Returns stand at %s%%; look at the categories above that.",
    "fastest_region": "Fastest region from first to last month: %s, revenue %s%%.",
    "thinnest_category": "Thinnest category margin: %s at %s%%.",
    "last_band": "Margin in the highest discount band, %s: %s%%.",
    "unprofitable": "Products with a loss in total: %s.",
    "top_products": "Highest revenue: %s.",
    "top_product": "%s (revenue $%s, margin %s%%)",
    "worst_products": "Lowest profit: %s.",
    "worst_product": "%s (profit $%s)",
    "targets": "Champions now: %s customers, ready for a loyalty offer. At risk: %s customers, once "
               "frequent buyers to win back.",
    "no_months": "Growth by region needs at least two months of data.",
    "no_growth": "No region has revenue in the first month, so growth is undefined.",
    "no_drivers": "Nothing in this selection points to a loss of profit.",
    "no_recommendations": "Nothing to recommend for this selection.",
    "help": "Ask about revenue, regions, products, customer segments, margins or recommendations.",
}


def _say(key: str, *values: Column) -> Column:
    """Render template ``key`` with text values (JVM-side ``format_string``)."""
    if not values:
        return F.lit(TEMPLATES[key])
    return F.format_string(TEMPLATES[key], *values)


def _whole(x: Column) -> Column:
    """Whole-number text of ``x`` (half-to-even, as Python's format does)."""
    return F.format_string("%.0f", F.bround(x, 0))


def _thousands(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%,.{digits}f", F.bround(x, digits))


def _fact(df: DataFrame, insight_id: int, kind: str, subject=None, detail=None, value=None,
          value2=None, text=None) -> DataFrame:
    def c(v, typ):
        if v is None:
            return F.lit(None).cast(typ)
        return (v if isinstance(v, Column) else F.lit(v)).cast(typ)
    return df.select(F.lit(insight_id).alias("insight_id"), F.lit(kind).alias("kind"),
                     c(subject, "string").alias("subject"), c(detail, "string").alias("detail"),
                     c(value, "double").alias("value"), c(value2, "double").alias("value2"),
                     c(text, "string").alias("text"))


def region_growth(fact: DataFrame, exact: bool = False, profile: Profile | None = None) -> DataFrame:
    """Per region: revenue in the first and the last month of the data and the
    growth % between them (1 dp).  Needs two months; regions with no first-
    month revenue are left out; fastest (unrounded) first.  ``exact=True`` adds
    the unrounded ``growth``.  The fact is read once, by region and month; a
    ``profile`` has those sums already."""
    months = profile.known("region_months") if profile else cache(
        fact.where(F.col("order_date").isNotNull() & F.col("region").isNotNull())
        .groupBy("region", F.trunc("order_date", "month").alias(MONTH)).agg(F.sum("revenue").alias("rev")))
    bounds = months.agg(F.struct(F.min(MONTH).alias("f"), F.max(MONTH).alias("l"))).scalar()
    first_m, last_m = bounds.getField("f"), bounds.getField("l")

    def revenue_of(month: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col(MONTH) == month, F.col("rev"))), F.lit(0))

    g = months.groupBy("region").agg(revenue_of(first_m).alias("first_rev"), revenue_of(last_m).alias("last_rev"))
    g = g.where((first_m != last_m) & (F.col("first_rev") != 0))
    growth = (F.col("last_rev") - F.col("first_rev")).cast("double") / F.col("first_rev").cast("double") * 100
    out = g.select("region",
                    F.date_format(first_m, "yyyy-MM").alias("first_month"),
                    F.date_format(last_m, "yyyy-MM").alias("last_month"),
                    F.round("first_rev", 2).cast("double").alias("first_month_revenue"),
                    F.round("last_rev", 2).cast("double").alias("last_month_revenue"),
                    dround(growth, 1).alias("growth_pct"), growth.alias("growth"))
    out = out.orderBy(F.col("growth").desc(), "region")
    return out if exact else out.drop("growth")


def category_margin(fact: DataFrame, exact: bool = False, profile: Profile | None = None) -> DataFrame:
    """Margin % (1 dp) per category with revenue > 0, thinnest (unrounded) first.
    ``exact=True`` adds the unrounded ratio ``margin``."""
    sums = profile.known("categories") if profile else (
        fact.where(F.col("category").isNotNull()).groupBy("category")
        .agg(F.sum("revenue").alias("rev"), F.sum("profit").alias("prof")))
    g = sums.where(F.col("rev") > 0)
    out = g.select("category", F.round("rev", 2).cast("double").alias("revenue"),
                   F.round("prof", 2).cast("double").alias("profit"),
                   ratio_pct("prof", "rev").alias("margin_pct"),
                   products.margin_ratio().alias("margin")).orderBy("margin", "category")
    return out if exact else out.drop("margin")


def _bands(fact: DataFrame, edges: list[float] | None, profile: Profile | None) -> DataFrame:
    """(band_idx, discount_band, margin_pct, unrounded margin) of every discount band."""
    if profile is None:
        return products.discount_impact(fact, edges, exact=True)
    return profile.known("bands").select(
        "band_idx", band_label_expr("band_idx", profile.edges).alias("discount_band"),
        ratio_pct("prof", "rev").alias("margin_pct"), products.margin_ratio().alias("margin"))


def discount_erosion(fact: DataFrame, edges: list[float] | None = None, profile: Profile | None = None) -> DataFrame:
    """One row when there are at least two discount bands: first and last
    band, their margins, and whether the last is more than 5 points lower."""
    bands = _bands(fact, edges, profile)
    first = F.min_by(F.struct("discount_band", "margin_pct"), F.col("band_idx"))
    last = F.max_by(F.struct("discount_band", "margin_pct"), F.col("band_idx"))
    agg = bands.agg(first.alias("f"), last.alias("l"), F.count(F.lit(1)).alias("bands"))
    out = agg.where(F.col("bands") >= 2).select(
        F.col("f.discount_band").alias("first_band"),
        F.col("f.margin_pct").alias("first_margin_pct"),
        F.col("l.discount_band").alias("last_band"),
        F.col("l.margin_pct").alias("last_margin_pct"))
    erodes = F.coalesce(F.col("last_margin_pct") < F.col("first_margin_pct") - EROSION_POINTS,
                        F.lit(False))
    return out.withColumn("erodes", erodes)


def profit_drivers(fact: DataFrame, edges: list[float] | None = None, profile: Profile | None = None) -> DataFrame:
    """Profit-erosion facts: the thinnest-margin category, the highest discount
    band's margin, the truly lowest-margin band, and the number of
    loss-making products (each row only when it exists).  All come from one
    profile of the fact."""
    profile = profile or sales_profile(fact, edges, ("products", "categories", "bands"))
    cat = category_margin(fact, exact=True, profile=profile)
    thin = cat.agg(F.min_by(F.struct("category", "margin_pct"),
                            F.struct("margin", "category")).alias("t"),
                   F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    bands = _bands(fact, edges, profile)
    band_agg = bands.agg(
        F.max_by(F.struct("discount_band", "margin_pct"), F.col("band_idx")).alias("last"),
        F.min_by(F.struct("discount_band", "margin_pct"),
                 F.struct(F.col("margin"), F.col("band_idx"))).alias("low"),
        F.count(F.lit(1)).alias("n"), F.count("margin_pct").alias("nm"))
    unprof = profile.known("products").agg(
        F.count_if(F.col("prof") < 0).alias("unprofitable_products")).where(F.col("unprofitable_products") > 0)
    parts = [
        thin.select(F.lit("thinnest_category").alias("driver"),
                    F.col("t.category").alias("subject"), F.col("t.margin_pct").alias("value")),
        band_agg.where((F.col("n") >= 2) & F.col("last.margin_pct").isNotNull()).select(
            F.lit("highest_discount_band").alias("driver"),
            F.col("last.discount_band").alias("subject"),
            F.col("last.margin_pct").alias("value")),
        band_agg.where((F.col("n") >= 2) & (F.col("nm") > 0)).select(
            F.lit("lowest_margin_band").alias("driver"),
            F.col("low.discount_band").alias("subject"),
            F.col("low.margin_pct").alias("value")),
        unprof.select(F.lit("unprofitable_products").alias("driver"),
                      F.lit(None).cast("string").alias("subject"),
                      F.col("unprofitable_products").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _one_row(df: DataFrame) -> DataFrame:
    """A one-row frame computed now, as a local row."""
    return local_rows(df.sparkSession, [list(r) for r in df.limit(1).collect()], df.schema)


def summary_insights(fact: DataFrame, summary: DataFrame | None = None,
                     edges: list[float] | None = None, profile: Profile | None = None) -> DataFrame:
    """Up to five headline insights, in order: growth, top region, a repricing
    candidate, discount erosion, and the average-order-value line.  Each is
    left out when its condition fails (no growth figure, no region, ...).
    All but the distinct counts of the summary come from one profile of the fact."""
    profile = profile or sales_profile(fact, edges, ("products", "region_months", "bands", "days"))
    # one row, read by two of the insights: computed once
    summary = _one_row(summary if summary is not None else kpi.executive_summary(fact, profile=profile))
    g = F.col("revenue_growth_pct")
    growth = summary.where(g.isNotNull()).select(
        g, F.when(g >= 0, "increased").otherwise("decreased").alias("dir"))
    growth = _fact(growth, 1, "revenue_growth", subject=F.col("dir"), value=g,
                   text=_say("revenue_growth", F.col("dir"), _whole(F.abs(g))))

    regions = profile.by("region_months").where(F.col("region").isNotNull())
    total = regions.agg(F.sum("rev")).scalar()
    top = (regions.groupBy("region").agg(F.sum("rev").alias("rev"))
           .select("region", F.when(total != 0, ratio_pct("rev", total)).otherwise(F.lit(0.0)).alias("revenue_share_pct"), "rev")
           .orderBy(F.col("rev").desc(), "region").limit(1))
    top = _fact(top, 2, "top_region", subject=F.col("region"), value=F.col("revenue_share_pct"),
                text=_say("top_region", F.col("region"), _whole(F.col("revenue_share_pct"))))

    cand = products.repriced(products.measured(profile.known("products").where(F.col("rev") > 0))).limit(1)
    cand = _fact(cand, 3, "repricing_candidate", subject=F.col("product_name"),
                 value=F.col("revenue"), value2=F.col("margin_pct"),
                 text=_say("repricing_candidate", F.col("product_name"),
                           _thousands(F.col("revenue")), _whole(F.col("margin_pct"))))

    ero = discount_erosion(fact, edges, profile).where(F.col("erodes"))
    ero = _fact(ero, 4, "discount_erosion", subject=F.col("first_band"),
                detail=F.col("last_band"), value=F.col("first_margin_pct"),
                value2=F.col("last_margin_pct"),
                text=_say("discount_erosion", _whole(F.col("first_margin_pct")),
                          F.col("first_band"), _whole(F.col("last_margin_pct")),
                          F.col("last_band")))

    aov = _fact(summary, 5, "order_value", value=F.col("average_order_value"),
                value2=F.col("return_rate_pct"),
                text=_say("order_value", _thousands(F.col("average_order_value"), 2),
                          F.format_number(F.col("total_orders"), 0),
                          F.format_number(F.col("total_customers"), 0),
                          F.format_string("%.1f", F.col("return_rate_pct"))))
    # a top-k of five: unlike a sort, it needs no second run of every part for its ranges
    return reduce(DataFrame.unionByName, [growth, top, cand, ero, aov]).orderBy("insight_id").limit(5)


def recommendations(fact: DataFrame, summary: DataFrame | None = None, profile: Profile | None = None) -> DataFrame:
    """Restock and Discontinue counts (when non-zero) and a return-rate alert
    above 8 %, as (kind, value, text) rows."""
    profile = profile or sales_profile(fact, groupings=("products", "days"))
    summary = _one_row(summary if summary is not None else kpi.executive_summary(fact, profile=profile))
    counts = cache(products.flagged(products.measured(profile.known("products")))
                   .groupBy("recommendation").agg(F.count(F.lit(1)).alias("products")))
    restock = counts.where((F.col("recommendation") == products.RESTOCK)
                           & (F.col("products") > 0)).select(
        F.lit(1).alias("rec_id"), F.lit("restock").alias("kind"),
        F.col("products").cast("double").alias("value"),
        _say("restock", F.col("products").cast("string")).alias("text"))
    disc = counts.where((F.col("recommendation") == products.DISCONTINUE)
                        & (F.col("products") > 0)).select(
        F.lit(2).alias("rec_id"), F.lit("discontinue").alias("kind"),
        F.col("products").cast("double").alias("value"),
        _say("discontinue", F.col("products").cast("string")).alias("text"))
    rate = F.col("return_rate_pct")
    alert = summary.where(rate > RETURN_RATE_ALERT_PCT).select(
        F.lit(3).alias("rec_id"), F.lit("return_rate_alert").alias("kind"),
        rate.cast("double").alias("value"),
        _say("return_rate_alert", F.format_string("%.1f", rate)).alias("text"))
    return restock.unionByName(disc).unionByName(alert).orderBy("rec_id").limit(3)


def top5_readout(fact: DataFrame) -> DataFrame:
    return products.top_products(fact, 5, "revenue").select(
        "product_id", "product_name", "revenue", "margin_pct")


def worst5_readout(fact: DataFrame) -> DataFrame:
    return products.worst_products(fact, 5, "profit").select("product_id", "product_name", "profit")


def intent_expr(text: Column, rules=INTENT_RULES) -> Column:
    """The intent of a question by ordered keyword rules."""
    q = F.lower(text)
    expr = None
    for intent, all_of, any_of in rules:
        cond = reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in any_of])
        for w in all_of:
            cond = F.contains(q, F.lit(w)) & cond
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, intent) if expr is None else expr.when(cond, intent)
    return expr.otherwise(UNKNOWN_INTENT)


def tag_intents(questions: DataFrame, text_col: str = "text", rules=INTENT_RULES) -> DataFrame:
    return questions.withColumn("intent", intent_expr(F.col(text_col), rules))


def intent_counts(questions: DataFrame, text_col: str = "text", by: list[str] | None = None,
                  rules=INTENT_RULES) -> DataFrame:
    """Questions per intent (and columns ``by``): one grouped count with map-side partials."""
    by = by or []
    return (tag_intents(questions, text_col, rules).groupBy(*by, "intent")
            .agg(F.count(F.lit(1)).alias("questions")).orderBy(*by, F.col("questions").desc(), "intent"))


def context_block(insights: DataFrame) -> DataFrame:
    """One row: the insight sentences as a bulleted block, in insight order
    (at most five rows are gathered)."""
    ordered = insights.agg(F.array_sort(F.collect_list(
        F.struct("insight_id", "text"))).alias("items"))
    return ordered.select(F.concat(F.lit("- "), F.array_join(
        F.transform("items", lambda s: s["text"]), "\n- ")).alias("context"))


def customers_to_target(fact: DataFrame) -> DataFrame:
    return customers.customers_to_target(customers.compute_rfm(fact))


def _joined(rows: DataFrame, order: Column, text: Column, sep: str = " ") -> Column:
    """Aggregate: the texts of a few rows (insights, read-outs) joined in order."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(items, lambda s: s["t"]), sep)


def _answer_summary(fact, summary, edges, profile):
    ins = summary_insights(fact, summary, edges, profile)
    return ins.agg(_joined(ins, F.col("insight_id"), F.col("text")).alias("answer"))


def _answer_region_growth(fact, summary, edges, profile):
    months = profile.known("region_months").agg(F.count_distinct(MONTH)).scalar()
    rg = region_growth(fact, exact=True, profile=profile)
    best = rg.agg(F.min_by(F.struct("region", "growth_pct"),
                           F.struct(-F.col("growth"), F.col("region"))).alias("b"))
    text = _say("fastest_region", F.col("b.region"), _whole(F.col("b.growth_pct")))
    return best.select(F.when(months < 2, _say("no_months"))
                       .when(F.col("b").isNull(), _say("no_growth"))
                       .otherwise(text).alias("answer"))


def _answer_profit_drivers(fact, summary, edges, profile):
    d = profit_drivers(fact, edges, profile)

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("driver") == name, F.struct("subject", "value")))
    agg = d.agg(pick("thinnest_category").alias("c"), pick("highest_discount_band").alias("b"),
                pick("unprofitable_products").alias("u"))
    parts = F.concat_ws(
        " ",  # concat_ws skips the NULL parts of absent drivers
        F.when(F.col("c").isNotNull(),
               _say("thinnest_category", F.col("c.subject"), _whole(F.col("c.value")))),
        F.when(F.col("b").isNotNull(),
               _say("last_band", F.col("b.subject"), _whole(F.col("b.value")))),
        F.when(F.col("u").isNotNull(),
               _say("unprofitable", F.col("u.value").cast("long").cast("string"))))
    return agg.select(F.when(parts == "", _say("no_drivers")).otherwise(parts).alias("answer"))


def _answer_top(fact, summary, edges, profile):
    top = top5_readout(fact)
    line = _say("top_product", F.col("product_name"), _thousands(F.col("revenue")),
                F.coalesce(_whole(F.col("margin_pct")), F.lit("n/a")))
    order = F.struct(-F.col("revenue"), F.col("product_id"))
    return top.agg(_say("top_products", _joined(top, order, line, "; ")).alias("answer"))


def _answer_worst(fact, summary, edges, profile):
    worst = worst5_readout(fact)
    line = _say("worst_product", F.col("product_name"), _thousands(F.col("profit")))
    order = F.struct(F.col("profit"), F.col("product_id"))
    return worst.agg(_say("worst_products", _joined(worst, order, line, "; ")).alias("answer"))


def _answer_targets(fact, summary, edges, profile):
    t = customers_to_target(fact)
    return t.select(_say("targets", F.col("champions").cast("string"),
                         F.col("at_risk").cast("string")).alias("answer"))


def _answer_recommendations(fact, summary, edges, profile):
    recs = recommendations(fact, summary, profile)
    joined = _joined(recs, F.col("rec_id"), F.col("text"))
    return recs.agg(F.when(F.count(F.lit(1)) == 0, _say("no_recommendations")).otherwise(joined)
                    .alias("answer"))


_ANSWERS = {
    "summary": _answer_summary,
    "region_growth": _answer_region_growth,
    "profit_drivers": _answer_profit_drivers,
    "top_products": _answer_top,
    "worst_products": _answer_worst,
    "target_customers": _answer_targets,
    "recommendations": _answer_recommendations,
}


# What of a profile the answers to an intent read.
_READS = {"summary": ("products", "region_months", "bands", "days"), "region_growth": ("region_months",),
          "profit_drivers": ("products", "categories", "bands"), "recommendations": ("products", "days")}


def _answer(fact: DataFrame, intent: str, summary: DataFrame | None, edges: list[float] | None,
            profile: Profile | None) -> DataFrame:
    """One row ``answer`` to an intent; only what it reads is computed."""
    build = _ANSWERS.get(intent)
    if build is None:
        return fact.sparkSession.range(1).select(_say("help").alias("answer"))
    if profile is None and intent in _READS:
        profile = sales_profile(fact, edges, _READS[intent])
    return build(fact, summary, edges, profile)


def answer_question(fact: DataFrame, question: str, summary: DataFrame | None = None,
                    edges: list[float] | None = None, profile: Profile | None = None) -> DataFrame:
    """One row (question, intent, answer): the question is routed by the
    intent rules and only the matching read-out is computed."""
    intent = fact.sparkSession.range(1).select(intent_expr(F.lit(question))).first()[0]
    return _answer(fact, intent, summary, edges, profile).select(
        F.lit(question).alias("question"), F.lit(intent).alias("intent"), "answer")


def answers(fact: DataFrame, questions: DataFrame, text_col: str = "question",
            edges: list[float] | None = None) -> DataFrame:
    """A table of questions with ``intent`` and ``answer``.

    The intents that occur are answered once each, from one profile of the fact, and
    joined to the questions (eight short rows at most, so Spark broadcasts them)."""
    tagged = tag_intents(questions, text_col)
    asked = [r.intent for r in tagged.select("intent").distinct().collect()]  # eight at most
    profile = sales_profile(fact, edges) if set(asked) & set(_READS) else None
    summary = None
    if set(asked) & {"summary", "recommendations"}:
        summary = _one_row(kpi.executive_summary(fact, profile=profile))
    told = [[i, _answer(fact, i, summary, edges, profile).first()["answer"]] for i in asked]
    kinds = T.StructType([T.StructField("intent", T.StringType()), T.StructField("answer", T.StringType())])
    return tagged.join(local_rows(fact.sparkSession, told, kinds), "intent").select(*questions.columns, "intent", "answer")
