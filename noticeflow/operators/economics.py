"""Bid economics over all cases at once, in decimals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Markups of the target, viable and lowest price; scenarios as (name, pays VAT, tax rate).
MARKUPS = {"target": "1.30", "viable": "1.15", "floor": "1.12"}
SCENARIOS = (("vat", True, None), ("simplified_10", False, "0.10"), ("simplified_15", False, "0.15"))
VAT = "0.22"


def money(x: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(x, 2).cast(MONEY)


def select_offers(offers: DataFrame, keys: Sequence[str] = ("case_id", "line_id"), cost: str = "unit_cost_gross", seq: str = "seq") -> DataFrame:
    """The offer of each line: the cheapest selected by hand, else the cheapest that complies, else none."""
    able = offers.where(F.col("selected") | F.col("compliance_status").isin("exact", "compliant"))
    row = F.struct(*[F.col(c) for c in offers.columns])
    best = able.groupBy(*keys).agg(F.min_by(row, F.struct((~F.col("selected")).alias("m"), F.col(cost), F.col(seq))).alias("_o"))
    return best.select("_o.*")


def case_lines(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Lines with their offer, or without one: total_cost_gross is null there."""
    o = select_offers(offers)
    o = o.select("case_id", "line_id", *[F.col(c).alias(f"offer_{c}") for c in o.columns if c not in ("case_id", "line_id")])
    rows = items.join(o, ["case_id", "line_id"], "left")
    return rows.withColumn("total_cost_gross", money(F.col("offer_unit_cost_gross") * F.col("quantity")))


def case_totals(cases: DataFrame, lines: DataFrame, expenses: DataFrame, markups: Mapping[str, str] = MARKUPS) -> DataFrame:
    """Per case: cost, expenses, threshold prices, assessment price (planned bid unless null or 0, else the start price), headroom and discounts."""
    bought = lines.groupBy("case_id").agg(
        F.coalesce(F.sum("total_cost_gross"), F.lit(0)).cast(MONEY).alias("procurement_gross"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("mandatory") & F.col("offer_unit_cost_gross").isNull()).alias("missing"),
        F.count_if(F.col("offer_compliance_status") == "conditional").alias("conditional"),
    )
    spent = expenses.groupBy("case_id").agg(F.sum("amount_gross").cast(MONEY).alias("expenses_gross"))
    t = cases.join(bought, "case_id", "left").join(spent, "case_id", "left").na.fill(0, ["lines", "missing", "conditional"])
    t = t.withColumns({c: F.coalesce(c, F.lit(0).cast(MONEY)) for c in ("procurement_gross", "expenses_gross")})
    for name, factor in markups.items():
        t = t.withColumn(f"{name}_price", money(F.col("procurement_gross") * F.lit(factor).cast("decimal(5,2)") + F.col("expenses_gross")))
        off = F.when(F.col("start_price") > 0, F.round((F.col("start_price") - F.col(f"{name}_price")) / F.col("start_price"), 4).cast("decimal(18,4)"))
        t = t.withColumn(f"{name}_discount", off)
    t = t.withColumn("assessment_price", F.coalesce(F.nullif("planned_bid", F.lit(0).cast(MONEY)), "start_price"))
    return t.withColumn("headroom", (F.col("assessment_price") - F.col("target_price")).cast(MONEY))


def decide(totals: DataFrame, risks: DataFrame | None = None) -> DataFrame:
    """Adds decision and reason: blocked, manual_review, stop or ready; risks turn ready into manual_review."""
    a = F.col("assessment_price")
    ladder = [
        (F.col("lines") == 0, "blocked", "no_lines"),
        (F.col("missing") > 0, "blocked", "missing_products"),
        (F.col("conditional") > 0, "manual_review", "conditional_products"),
        (F.col("procurement_gross") <= 0, "blocked", "no_cost"),
        (a.isNull(), "manual_review", "no_price"),
        (a < F.col("floor_price"), "stop", "below_floor"),
        (a < F.col("viable_price"), "manual_review", "below_viable"),
        (a < F.col("target_price"), "manual_review", "below_target"),
    ]
    what, why = F.lit("ready"), F.lit("target_reached")
    for condition, decision, reason in reversed(ladder):
        what, why = F.when(condition, decision).otherwise(what), F.when(condition, reason).otherwise(why)
    out = totals.withColumns({"decision": what, "reason": why})
    if risks is None:
        return out
    some = risks.select("case_id").distinct().withColumn("_risk", F.lit(True))
    out = out.join(some, "case_id", "left")
    down = (F.col("decision") == "ready") & F.col("_risk").isNotNull()
    return out.withColumns({"reason": F.when(down, "open_risks").otherwise(F.col("reason")), "decision": F.when(down, "manual_review").otherwise(F.col("decision"))}).drop("_risk")


def case_risks(cases: DataFrame, lines: DataFrame, expenses: DataFrame, tolerated_days: int = 14) -> DataFrame:
    """case_id, n, kind (risk or question), text: different ones in the order of rules, then lines."""
    paid = lambda what: expenses.where((F.col("category") == what) & F.col("confirmed") & (F.col("amount_gross") > 0)).select("case_id").distinct()
    rows = lambda df, rule, kind, text, n=F.lit(0): df.select("case_id", F.lit(rule).alias("rule"), n.cast("long").alias("line"), F.lit(kind).alias("kind"), text.alias("text"))
    far = cases.where("own_delivery").join(paid("delivery"), "case_id", "left_anti")
    fit = cases.where("requires_installation").join(paid("installation"), "case_id", "left_anti")
    late = cases.where(F.col("payment_days") > tolerated_days)
    unsure = expenses.where((F.col("amount_gross") > 0) & ~F.col("confirmed"))
    # lines are read once for all their rules
    line, given = F.col("line_id"), F.col("offer_unit_cost_gross").isNotNull()
    by_line = lines.join(cases.select("case_id", "delivery_days"), "case_id", "left")
    rules = [
        (4, ~given & F.col("mandatory"), "question", "product:"),
        (5, given & (F.col("offer_compliance_status") == "conditional"), "risk", "conditional:"),
        (6, given & (F.coalesce("offer_evidence", F.lit("")) == ""), "risk", "no_evidence:"),
        (7, given & (F.col("offer_lead_days") > F.col("delivery_days")), "risk", "lead_days:"),
    ]
    found = [F.when(when, F.struct(F.lit(rule).alias("rule"), line.cast("long").alias("line"), F.lit(kind).alias("kind"), F.concat(F.lit(text), line.cast("string")).alias("text"))) for rule, when, kind, text in rules]
    parts = [
        rows(far, 1, "risk", F.lit("delivery_cost")),
        rows(far, 1, "question", F.lit("delivery_quote")),
        rows(fit, 2, "risk", F.lit("installation_cost")),
        rows(fit, 2, "question", F.lit("installation_quote")),
        rows(late, 3, "risk", F.concat(F.lit("payment_days:"), F.col("payment_days").cast("string"))),
        by_line.select("case_id", F.inline_outer(F.array_compact(F.array(*found)))).where("rule is not null"),
        rows(unsure, 8, "risk", F.concat(F.lit("unconfirmed:"), F.col("category"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # a text has one rule, so that both least ones are of one row; two numbers need no sort
    return out.groupBy("case_id", "kind", "text").agg(F.min("rule").alias("_rule"), F.min("line").alias("_line")).select("case_id", "kind", "text", F.struct(F.col("_rule").alias("rule"), F.col("_line").alias("line")).alias("n"))


def _net(gross: Column, rate: Column) -> Column:
    return F.when(rate > 0, gross / (1 + rate)).otherwise(gross)


def tax_scenarios(totals: DataFrame, lines: DataFrame, expenses: DataFrame, scenarios: Sequence[tuple] = SCENARIOS, vat: str = VAT) -> DataFrame:
    """Per case with an assessment price and scenario: revenue, costs, profit, tax and rate on cost.

    An offer's VAT of 0 means the usual one. Who pays VAT takes it out of price, goods and
    reclaimable expenses; others pay the rate on profit, at least one percent of revenue.
    """
    d = lambda x: F.lit(x).cast("decimal(5,2)")
    rate = F.coalesce(F.nullif(F.col("offer_vat_rate"), F.lit(0).cast("decimal(5,2)")), d(vat))
    zero = F.lit(0).cast("decimal(28,6)")
    goods = lines.groupBy("case_id").agg(F.sum(_net(F.col("total_cost_gross"), rate).cast("decimal(28,6)")).alias("goods_net"))
    net = F.when(F.col("vat_reclaimable"), _net(F.col("amount_gross"), F.col("vat_rate"))).otherwise(F.col("amount_gross")).cast("decimal(28,6)")
    spent = expenses.groupBy("case_id").agg(F.sum(net).alias("spent_net"))
    t = totals.where("assessment_price is not null").join(goods, "case_id", "left").join(spent, "case_id", "left")
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(v).alias("payer"), (d(r) if r else F.lit(None).cast("decimal(5,2)")).alias("rate")) for n, v, r in scenarios]))
    t = t.select("case_id", "assessment_price", "procurement_gross", "expenses_gross", F.coalesce("goods_net", zero).alias("goods_net"), F.coalesce("spent_net", zero).alias("spent_net"), s.alias("s"))
    payer = F.col("s.payer")
    t = t.withColumns(
        {
            "revenue": F.when(payer, _net(F.col("assessment_price"), d(vat))).otherwise(F.col("assessment_price")).cast("decimal(28,6)"),
            "cost": F.when(payer, F.col("goods_net") + F.col("spent_net")).otherwise(F.col("procurement_gross") + F.col("expenses_gross")).cast("decimal(28,6)"),
        }
    )
    t = t.withColumn("profit", money(F.col("revenue") - F.col("cost")))
    least = money(F.col("revenue") * d("0.01"))
    tax = F.when(F.col("s.rate").isNotNull(), F.greatest(money(F.greatest(F.col("profit"), F.lit(0).cast(MONEY)) * F.col("s.rate")), least))
    t = t.withColumn("tax", tax.cast(MONEY))
    return t.select(
        "case_id",
        F.col("s.scenario").alias("scenario"),
        money(F.col("revenue")).alias("revenue_net"),
        money(F.col("cost")).alias("total_cost"),
        "profit",
        "tax",
        F.when(F.col("tax").isNotNull(), (F.col("profit") - F.col("tax")).cast(MONEY)).alias("profit_after_tax"),
        F.when(F.col("cost") > 0, F.bround(F.col("profit") / F.col("cost"), 4).cast("decimal(18,4)")).alias("profit_rate"),
    )


#: What a line without an offer shows; the levels of the bidding table and what each means.
NOT_FOUND = ("НЕ НАЙДЕН", "not_found", "Требуется поиск товара")
LEVELS = (("target", "Цель 30%", "Рабочая цель торгов"), ("viable", "Рабочий порог 15%", "Ниже — только ручное решение"), ("floor", "Жесткий порог 12%", "Ниже не торговаться"))


def summary_positions(lines: DataFrame) -> DataFrame:
    """A row per line of each case: what is asked for and the offer chosen, or that none was found.

    lines: those of case_lines; offer columns that are missing are null.
    """
    offer = lambda c: F.col(f"offer_{c}") if f"offer_{c}" in lines.columns else F.lit(None).cast("string")
    own = lambda c: F.col(c) if c in lines.columns else F.lit(None).cast("string")
    some = F.col("offer_unit_cost_gross").isNotNull()
    return lines.select(
        "case_id", "line_id", own("name").alias("name"), "quantity", own("unit").alias("unit"), own("required_specs").alias("required_specs"), offer("supplier").alias("supplier"), offer("sku").alias("sku"),
        F.when(some, offer("product_name")).otherwise(NOT_FOUND[0]).alias("product_name"), F.when(some, offer("compliance_status")).otherwise(NOT_FOUND[1]).alias("compliance_status"),
        F.col("offer_unit_cost_gross").alias("unit_cost_gross"), "total_cost_gross", offer("stock").alias("stock"), offer("lead_days").alias("lead_days"), offer("evidence").alias("evidence"),
        F.when(some, offer("notes")).otherwise(NOT_FOUND[2]).alias("notes"),
    )


def summary_offers(offers: DataFrame) -> DataFrame:
    """All offers of all cases in the order of a report: rank within the line by cost, then seq, and whether it is the line's choice."""
    nth = F.row_number().over(Window.partitionBy("case_id", "line_id").orderBy("unit_cost_gross", "seq"))
    chosen = select_offers(offers).select("case_id", "line_id", F.col("seq").alias("_chosen"))
    rows = offers.withColumn("rank", nth).join(chosen, ["case_id", "line_id"], "left")
    return rows.withColumn("chosen", F.coalesce(F.col("seq") == F.col("_chosen"), F.lit(False))).drop("_chosen")


def summary_thresholds(totals: DataFrame) -> DataFrame:
    """Three rows per case: level, threshold price, the reduction from the start price and its share (null without one), and what the level means."""
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("level"), F.col(f"{name}_price").alias("threshold"), F.col(f"{name}_discount").alias("discount"), F.lit(why).alias("meaning")) for k, (name, label, why) in enumerate(LEVELS)]))
    rows = totals.select("case_id", "start_price", level.alias("l"))
    return rows.select("case_id", F.col("l.k").alias("place"), F.col("l.level").alias("level"), F.col("l.threshold").alias("threshold"), (F.col("start_price") - F.col("l.threshold")).cast(MONEY).alias("reduction"), F.col("l.discount").alias("discount"), F.col("l.meaning").alias("meaning"))
