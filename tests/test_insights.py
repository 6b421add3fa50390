from __future__ import annotations

from pyspark.sql import functions as F

from salespark.operators.insights import (category_margin, context_block, discount_erosion,
                                          intent_counts, profit_drivers, recommendations,
                                          region_growth, summary_insights, tag_intents,
                                          top5_readout, worst5_readout)


def test_summary_insights_text(sample_df):
    rows = summary_insights(sample_df).collect()
    assert [r.kind for r in rows] == ["revenue_growth", "top_region", "discount_erosion",
                                      "order_value"]
    texts = [r.text for r in rows]
    assert texts[0] == "Later half against earlier half of the period: revenue increased by 22%."
    assert texts[1] == "Largest region: North, with 66% of all revenue."
    assert texts[2] == ("Orders at 39% margin in the 0-10% discount band drop to -74% in the 30-100% band: "
                        "the deepest discounts cost margin.")
    assert texts[3] == ("An order is worth $140.67 on average (12 orders, 5 customers); 25.0% of lines "
                        "come back.")
    block = context_block(summary_insights(sample_df)).first().context
    assert block.startswith("- Later half") and block.count("\n- ") == 3


def test_recommendations(sample_df):
    rows = recommendations(sample_df).collect()
    assert [(r.kind, r.value) for r in rows] == [("restock", 1.0), ("discontinue", 1.0),
                                                 ("return_rate_alert", 25.0)]
    assert rows[2].text.startswith("Returns stand at 25.0%")


def test_region_growth(sample_df):
    rows = region_growth(sample_df).collect()
    assert [(r.region, r.growth_pct) for r in rows] == [("North", 86.3), ("East", -29.8)]
    one_month = sample_df.where(F.month("order_date") == 4)
    assert region_growth(one_month).count() == 0


def test_profit_drivers(sample_df):
    cm = category_margin(sample_df).collect()
    assert cm[0].category == "Home" and cm[0].margin_pct == 26.3
    drivers = {r.driver: (r.subject, r.value) for r in profit_drivers(sample_df).collect()}
    assert drivers["thinnest_category"] == ("Home", 26.3)
    assert drivers["highest_discount_band"] == ("30-100%", -73.7)
    assert drivers["lowest_margin_band"] == ("30-100%", -73.7)
    assert drivers["unprofitable_products"] == (None, 1.0)
    ero = discount_erosion(sample_df).first()
    assert (ero.first_band, ero.last_band, ero.erodes) == ("0-10%", "30-100%", True)


def test_readouts(sample_df):
    assert [r.product_name for r in top5_readout(sample_df).collect()] == [
        "Trail Boots", "Desk Lamp", "Desk Clock"]
    assert worst5_readout(sample_df).first().product_name == "Desk Clock"


def test_intent_rules(spark):
    qs = spark.createDataFrame([
        ("Can you summarize the quarter?",), ("Which region grew fastest?",),
        ("Why is profit falling?",), ("What is our top product?",),
        ("Show the worst product",), ("Which customers should we target?",),
        ("Any recommendation for us?",), ("Hello there",), (None,),
        ("Give an overview of the top region",),  # first rule wins
    ], "text string")
    got = [r.intent for r in tag_intents(qs).collect()]
    assert got == ["summary", "region_growth", "profit_drivers", "top_products", "worst_products",
                   "target_customers", "recommendations", "unknown", "unknown", "summary"]
    counts = {r.intent: r.questions for r in intent_counts(qs).collect()}
    assert counts["unknown"] == 2 and counts["summary"] == 2


def test_answer_question_routes_and_renders(sample_df):
    from salespark.operators.insights import answer_question

    def ask(q):
        return answer_question(sample_df, q).first()
    a = ask("Which region is growing fastest?")
    assert a.intent == "region_growth"
    assert a.answer == "Fastest region from first to last month: North, revenue 86%."
    assert ask("Why is profit falling?").answer == (
        "Thinnest category margin: Home at 26%. Margin in the highest discount band, 30-100%: -74%. "
        "Products with a loss in total: 1.")
    a = ask("Show best-performing products.")
    assert a.intent == "top_products" and a.answer == (
        "Highest revenue: Trail Boots (revenue $798, margin 39%); Desk Lamp (revenue $784, margin 39%); "
        "Desk Clock (revenue $106, margin -66%).")
    assert ask("Any underperforming items?").answer == (
        "Lowest profit: Desk Clock (profit $-70); Desk Lamp (profit $304); Trail Boots (profit $308).")
    assert ask("Which customers should we target?").answer.startswith("Champions now: 1 customers")
    assert ask("What should we do next?").answer.startswith("Restock: 1 products")
    assert ask("Summarize this dashboard.").answer.startswith("Later half against earlier half")
    assert ask("hello").intent == "unknown"
    april = sample_df.where("month(order_date) = 4")
    assert answer_question(april, "which region is growing?").first().answer == (
        "Growth by region needs at least two months of data.")


def test_answers_for_a_table_of_questions(spark, sample_df):
    """Each question has the answer it gets alone; a NULL question is an unknown one."""
    from salespark.operators.insights import answer_question, answers
    asked = ["Give me a summary", "Which region grows fastest?", "why is profit down, margin?", "best product?",
             "worst product", "who to target", "what do you recommend", "hello", "another summary please"]
    table = spark.createDataFrame([(i, q) for i, q in enumerate([*asked, None])], "id int, question string")
    got = {r.id: r for r in answers(sample_df, table).collect()}
    assert len(got) == 10 and got[9].intent == "unknown"
    for i, q in enumerate(asked):
        alone = answer_question(sample_df, q).first()
        assert (got[i].intent, got[i].answer) == (alone.intent, alone.answer)
    assert answers(sample_df, table.limit(0)).count() == 0


def test_profile_equals_separate_aggregates(sample_df):
    from salespark.operators import insights, kpi
    from salespark.operators.profile import sales_profile
    profile = sales_profile(sample_df)
    for build in (insights.region_growth, insights.category_margin, insights.discount_erosion):
        assert build(sample_df, profile=profile).collect() == build(sample_df).collect()
    assert kpi.executive_summary(sample_df, profile=profile).collect() == kpi.executive_summary(sample_df).collect()
    assert profile.by("days").count() == sample_df.select("order_date").distinct().count()


def test_summary_reads_the_fact_twice_at_most(spark):
    """One scan for the profile and one for the distinct counts."""
    from salespark.operators import insights, kpi
    from salespark.operators.profile import sales_profile
    from salespark.plans.inspect import scan_summaries
    from salespark.sources.tables import sales_fact
    fact = sales_fact(spark, "/root/testdata/sf0.001")
    profile = sales_profile(fact)
    summary = kpi.executive_summary(fact, profile=profile)
    summary.collect()
    reads = [s["Location"] for s in scan_summaries(summary)]
    assert sum("lineitem" in r for r in reads) == 1
    out = insights.summary_insights(fact, summary, profile=profile)
    out.collect()
    assert not any("lineitem" in s["Location"] for s in scan_summaries(out))
