"""Long-format metrics (entity, year, metric, value): derivation, lookup, coverage, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Labels of statement lines for each figure, best first.
ALIASES = {
    "Revenue": ["Revenue", "Revenues", "Sales Revenue, Net", "SalesRevenueNet", "Total revenues and other income", "Sales and Operating Revenue"],
    "OperatingIncome": ["Operating Income", "Operating Income (Loss)", "OperatingIncomeLoss", "Income Before Tax from Continuing Operations", "Income Before Tax"],
    "NetIncome": ["Net Income", "Net Income (Loss)", "NetIncomeLoss", "Net Income from Continuing Operations"],
    "GrossProfit": ["Gross Profit"],
    "SGA": ["Selling, General and Administrative Expense"],
    "RnD": ["Research and Development Expense"],
    "TotalAssets": ["Total Assets", "Assets"],
    "TotalLiabilities": ["Total Liabilities", "Liabilities"],
    "LiabilitiesAndEquity": ["Total Liabilities and Stockholders' Equity"],
    "NoncurrentLiabilities": ["Total Non Current Liabilities", "Total Noncurrent Liabilities"],
    "Equity": ["Stockholders' Equity", "Total equity", "StockholdersEquity", "Total Stockholders' Equity"],
    "CurrentAssets": ["Current Assets", "Assets, Current", "AssetsCurrent", "Total Current Assets"],
    "CurrentLiabilities": ["Current Liabilities", "Liabilities, Current", "LiabilitiesCurrent", "Total Current Liabilities"],
    "Inventory": ["Inventory, Net", "InventoryNet", "Inventory"],
    "CFO": ["Net Cash from Operating Activities", "Net Cash Provided by Operating Activities", "NetCashProvidedByUsedInOperatingActivities"],
    "CapEx": ["Payments to Acquire Property, Plant and Equipment", "Purchases of property and equipment", "Capital Expenditures"],
}
RATIOS = ("Net Profit Margin %", "Operating Margin %", "ROA % (Avg Assets)", "ROE % (Avg Equity)", "Current Ratio", "Quick Ratio", "Debt-to-Equity", "Debt-to-Assets", "Free Cash Flow", "Operating Cash Flow Ratio")


def melt(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long without nulls."""
    return wide.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def pick_by_alias(facts: DataFrame, entity: str, year: str, label: str, value: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(entity, year, one column for each figure): the value of the first alias that an entity has in any year.

    Labels are compared trimmed and in lower case; of repeated rows of a year the greatest value counts.
    """
    spark = facts.sparkSession
    known = spark.createDataFrame([(a.strip().lower(), f, i) for f, xs in aliases.items() for i, a in enumerate(xs)], "alias string, figure string, priority int")
    rows = facts.where(F.col(value).isNotNull() & F.col(year).isNotNull()).select(entity, year, F.lower(F.trim(label)).alias("alias"), F.col(value).cast("double").alias("v"))
    hit = rows.join(F.broadcast(known), "alias")  # a fixed list of labels
    best = hit.withColumn("p", F.min("priority").over(Window.partitionBy(entity, "figure"))).where("priority = p")
    return best.groupBy(entity, year).pivot("figure", list(aliases)).agg(F.max("v"))


def sum_by_alias(facts: DataFrame, entity: str, year: str, label: str, value: str, aliases: Sequence[str], name: str) -> DataFrame:
    """(entity, year, name): the sum over all aliases that an entity has in a year; years without any value stay null.

    Labels are compared trimmed and in lower case; of repeated rows of a label and year the greatest value counts.
    """
    wanted = sorted({a.strip().lower() for a in aliases})
    rows = facts.where(F.col(year).isNotNull()).select(entity, year, F.lower(F.trim(label)).alias("alias"), F.col(value).cast("double").alias("v")).where(F.col("alias").isin(*wanted))
    return rows.groupBy(entity, year, "alias").agg(F.max("v").alias("v")).groupBy(entity, year).agg(F.sum("v").alias(name))


def search(facts: DataFrame, term: str, metric: str = "metric", n: int | None = None) -> DataFrame:
    """The facts whose metric holds the term whatever its letter case, the shortest metric names first; n of them if given."""
    hit = facts.where(F.contains(F.lower(F.col(metric)), F.lit(term.lower())))
    return hit.orderBy(F.length(metric), *facts.columns).limit(n) if n else hit


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), F.when(b != 0, b.cast("double")))


def derive(figures: DataFrame, entity: str, year: str) -> DataFrame:
    """(entity, year, metric, value) of the ten ratios; averages take the previous row of the entity, whatever its year."""
    w = Window.partitionBy(entity).orderBy(year)
    c = F.col
    avg2 = lambda x: (c(x) + F.lag(x).over(w)) / 2
    op = F.coalesce(c("OperatingIncome"), c("GrossProfit") - c("SGA") - c("RnD"))
    split = F.when(c("CurrentLiabilities").isNotNull() | c("NoncurrentLiabilities").isNotNull(), F.coalesce(c("CurrentLiabilities"), F.lit(0.0)) + F.coalesce(c("NoncurrentLiabilities"), F.lit(0.0)))
    liab = F.coalesce(c("TotalLiabilities"), split, c("LiabilitiesAndEquity") - c("Equity"))
    f = figures.withColumns({"_op": op, "_liab": liab, "_aa": avg2("TotalAssets"), "_ae": avg2("Equity"), "_capex": F.abs("CapEx")})
    wide = f.select(
        entity, year, (ratio(c("NetIncome"), c("Revenue")) * 100).alias(RATIOS[0]), (ratio(c("_op"), c("Revenue")) * 100).alias(RATIOS[1]), (ratio(c("NetIncome"), c("_aa")) * 100).alias(RATIOS[2]),
        (ratio(c("NetIncome"), c("_ae")) * 100).alias(RATIOS[3]), ratio(c("CurrentAssets"), c("CurrentLiabilities")).alias(RATIOS[4]), ratio(c("CurrentAssets") - c("Inventory"), c("CurrentLiabilities")).alias(RATIOS[5]),
        ratio(c("_liab"), c("Equity")).alias(RATIOS[6]), ratio(c("_liab"), c("TotalAssets")).alias(RATIOS[7]), (c("CFO") - c("_capex")).alias(RATIOS[8]), ratio(c("CFO"), c("CurrentLiabilities")).alias(RATIOS[9]),
    )
    return melt(wide, [entity, year], RATIOS)


def latest_filed(facts: DataFrame, keys: Sequence[str], filed: str, tie: Sequence[str] = ()) -> DataFrame:
    """The fact filed last for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(filed).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in tie))
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def grid(entities: DataFrame, years: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every combination of three short lists of a question."""
    return entities.crossJoin(years).crossJoin(metrics)


def lookup(wanted: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """wanted with value and status: found, nan (a row without value) or not_in_db; of repeated facts the greatest counts."""
    f = facts.groupBy(*keys).agg(F.max(F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))).alias(value), F.lit(1).alias("_in"))
    out = wanted.join(f, list(keys), "left")
    return out.withColumn("status", F.when(F.col("_in").isNull(), "not_in_db").when(F.col(value).isNull(), "nan").otherwise("found")).drop("_in")


def lookup_stats(looked: DataFrame) -> DataFrame:
    n = F.count("*")
    return looked.agg(n.alias("total"), F.count_if(F.col("status") != "not_in_db").alias("in_db"), F.count_if(F.col("status") == "found").alias("found"), F.count_if(F.col("status") == "nan").alias("nan"), F.count_if(F.col("status") == "not_in_db").alias("not_in_db"), F.when(n > 0, F.count_if(F.col("status") == "found") * F.lit(100.0).cast("double") / n).alias("found_pct"))


def coverage(facts: DataFrame, entities: DataFrame, years: DataFrame, metrics: DataFrame, entity: str, year: str, metric: str, not_applicable: DataFrame | None = None) -> DataFrame:
    """(entity, year, n_metrics, n_present, missing): which expected metrics lack for each entity and year, in order.

    not_applicable (entity, metric) pairs are expected of nobody.
    """
    want = entities.select(entity).distinct().crossJoin(F.broadcast(years.select(year).distinct())).crossJoin(F.broadcast(metrics.select(metric).distinct()))
    if not_applicable is not None:
        want = want.join(not_applicable.select(entity, metric).distinct(), [entity, metric], "left_anti")
    have = facts.where(F.col("value").isNotNull()).select(entity, year, metric).distinct().withColumn("_in", F.lit(1))
    j = want.join(have, [entity, year, metric], "left")
    return j.groupBy(entity, year).agg(F.count("*").alias("n_metrics"), F.count("_in").alias("n_present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.col(metric)))), ", ").alias("missing"))


def gated_merge(previous: DataFrame, new: DataFrame, year: str, last_years: int, missing_previous: int, missing_new: int) -> tuple[DataFrame, bool]:
    """(facts, replaced): the last years of previous give way to new's if no more is missing there and the schemas agree."""
    if previous.dtypes != new.dtypes:
        raise ValueError(f"schemas differ: {previous.dtypes} and {new.dtypes}")
    if missing_new > missing_previous:
        return previous, False
    first = F.broadcast(new.agg((F.max(year) - last_years + 1).alias("_first")))
    kept = previous.crossJoin(first).where(F.col("_first").isNull() | (F.col(year) < F.col("_first"))).drop("_first")
    return kept.unionByName(new.crossJoin(first).where(F.col(year) >= F.col("_first")).drop("_first")), True


def direction(pct: Column) -> Column:
    return F.when(pct > 5, "Strong Growth").when(pct > 0, "Moderate Growth").when(pct > -5, "Slight Decline").otherwise("Significant Decline")


def trend(facts: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """(keys, first_year, last_year, first_value, last_value, change, change_pct, cagr_pct, direction) over at least two years.

    Percentages need a positive first value, the growth rate two positive ones; null else.
    """
    f = facts.where(F.col(value).isNotNull() & F.col(year).isNotNull())
    g = f.groupBy(*keys).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min_by(value, year).cast("double").alias("first_value"), F.max_by(value, year).cast("double").alias("last_value")).where("last_year > first_year")
    n = (F.col("last_year") - F.col("first_year")).cast("double")
    g = g.withColumn("change", F.col("last_value") - F.col("first_value")).withColumn("change_pct", F.when(F.col("first_value") > 0, F.col("change") * 100.0 / F.col("first_value")))
    g = g.withColumn("cagr_pct", F.when((F.col("first_value") > 0) & (F.col("last_value") > 0), (F.pow(F.col("last_value") / F.col("first_value"), 1.0 / n) - 1) * 100))
    return g.withColumn("direction", direction(F.col("change_pct")))


def yoy(facts: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """(keys, year, value, previous, yoy_pct) against the previous row, where that is positive."""
    w = Window.partitionBy(*keys).orderBy(year)
    f = facts.where(F.col(value).isNotNull()).select(*keys, year, F.col(value).cast("double").alias("value")).withColumn("previous", F.lag("value").over(w))
    return f.where("previous > 0").withColumn("yoy_pct", (F.col("value") - F.col("previous")) * 100.0 / F.col("previous"))


def kpi_lines(looked: DataFrame, entity: str, year: str, metric: str, value: str) -> DataFrame:
    """(entity, block): the found figures of each entity as lines of text, by metric and year."""
    from marlstone.functions.text import compact_money

    shown = compact_money(F.col(value), percent=F.col(metric).contains("%"), ratio=F.col(metric).rlike("(?i)ratio|debt-to|quick|current"))
    rows = looked.where(F.col(value).isNotNull()).select(entity, metric, year, F.format_string("%s %s: %s", F.col(metric), F.col(year).cast("string"), shown).alias("line"))
    return rows.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(metric, year, "line"))), lambda s: s["line"]), "\n").alias("block"))
