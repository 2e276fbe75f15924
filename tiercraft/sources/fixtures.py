"""Record tables derived by Spark from the TPC-H-style test tables.

The segmentation engine reads one table of valued records (players,
accounts, any records). These derivations turn the given star schema into
such tables so that every query's work grows with the input tables:

* ``players``        one row per customer with orders (value = spend per active day)
* ``players_dirty``  the same with missing / 'nan' / duplicate ids and missing values
* ``current`` / ``prior``  per-customer value before / after a split date
* ``companies``      one row per supplier with revenue, debt, equity
* ``dated``          players with the last order's date as text, in the forms people write
* ``dotted``         custom with dots in the column names
* ``texts`` / ``awkward``  text cells for the strict parse / for CSV files
* ``custom``         one row per part, value as money text, size as recency
* ``offers``         per-order quantities by category (Pareto input)
* ``lines``          one record per order line (value = extended price, recency =
                     days since shipping): the custom mode on the largest table,
                     in which many line ids repeat

Aggregations run before joins (orders are reduced to one row per customer
before meeting ``customer``; lineitems to one row per supplier before
meeting ``supplier``), so a skewed key is combined map-side and the joins
are one-to-one. Amounts are summed as decimals so the doubles are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.sources.readers import ROW_ORDER

# Fixed values of the fixtures (see FIXTURES.md).
AS_OF = "2001-08-02 00:00:00"
SPLIT_DATE = "1998-04-15 00:00:00"
COPY_ORDER = 1 << 62     # copies come after every original row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money_sum(c: str) -> F.Column:
    return F.sum(F.col(c).cast("decimal(18,2)"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    per_cust = (orders.groupBy("o_custkey")
                .agg(_money_sum("o_totalprice").alias("_spend"),
                     F.countDistinct("o_orderdate").alias("_days"),
                     F.max("o_orderdate").alias("_last")))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = cust.join(per_cust, cust.c_custkey == per_cust.o_custkey)
    k = F.col("c_custkey")
    return j.select(
        F.concat(F.lit("P"), k.cast("string")).alias("PlayerID"),
        F.col("c_name").alias("FullName"),
        (F.col("_spend").cast("double") / F.col("_days") / F.lit(1000)).alias("NetADT"),
        F.datediff(F.lit(AS_OF).cast("timestamp_ntz").cast("date"),
                   F.col("_last").cast("date")).cast("bigint").alias("DaysSinceLastVisit"),
        F.when(k % 4 == 0, "YES").when(k % 4 == 1, " no ").when(k % 4 == 2, "y")
        .alias("CanEmail"),
        F.when(k % 30 == 0, F.lit(None).cast("string")).when(k % 30 == 1, "")
        .otherwise(F.col("c_mktsegment")).alias("ZipCode"),
        k.alias(ROW_ORDER))


def players_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """players with bad ids and missing values, plus an exact second copy of
    every 50th row (a duplicate id). One pass over ``players``: rows that get
    a copy are exploded into two instead of unioning a second scan."""
    base = players(spark, sf_dir)
    ro = F.col(ROW_ORDER)
    copies = F.when(ro % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    x = base.withColumn("_copy", F.explode(copies))
    first = F.col("_copy") == 0
    return x.select(
        F.when(~first, F.col("PlayerID"))
        .when(ro % 97 == 0, F.lit(None).cast("string")).when(ro % 89 == 0, " nan ")
        .otherwise(F.concat(F.lit(" "), F.col("PlayerID"))).alias("PlayerID"),
        "FullName",
        F.when(first & (ro % 20 == 0), F.lit(None).cast("double")).otherwise(F.col("NetADT"))
        .alias("NetADT"),
        "DaysSinceLastVisit", "CanEmail", "ZipCode",
        F.when(first, ro).otherwise(ro + F.lit(COPY_ORDER)).alias(ROW_ORDER))


def _period(spark: SparkSession, sf_dir: str, before: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    split = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    cond = F.col("o_orderdate") < split if before else F.col("o_orderdate") >= split
    per = (orders.where(cond).groupBy("o_custkey")
           .agg(_money_sum("o_totalprice").alias("_spend"), F.count(F.lit(1)).alias("_n")))
    value = F.col("_spend").cast("double") / F.col("_n") / F.lit(1000)
    if before:
        value = F.when(F.col("o_custkey") % 40 == 0, F.lit(0.0)).otherwise(value)
    return per.select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("PlayerID"),
                      value.alias("NetADT"), F.col("o_custkey").alias(ROW_ORDER))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _period(spark, sf_dir, before=False)


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _period(spark, sf_dir, before=True)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rev = (li.groupBy("l_suppkey")
           .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") *
                      (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("_rev")))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey",
                                                  "s_acctbal")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (sup.join(rev, sup.s_suppkey == rev.l_suppkey)
         .join(nat, sup.s_nationkey == nat.n_nationkey))
    k = F.col("s_suppkey")
    return j.select(
        F.concat(F.lit("A"), k.cast("string")).alias("AccountID"),
        F.col("s_name").alias("FullName"),
        F.col("n_name").alias("Industry"),
        F.col("_rev").cast("double").alias("AnnualRevenue"),
        ((k % 30) * 1000).cast("double").alias("Debt"),
        F.when(k % 33 == 0, F.lit(0.0)).otherwise(F.lit(5000) + F.col("s_acctbal"))
        .alias("Equity"),
        (k % 26).alias("MonthsSinceContact"),
        F.when(k % 3 == 0, "High Risk").otherwise("Low Risk").alias("RiskTier"),
        k.alias(ROW_ORDER))


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        k.alias("ref_id"), F.col("p_name").alias("label"),
        F.when(k % 40 == 0, "n/a")
        .otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).alias("worth"),
        F.col("p_size").alias("recency_days"),
        k.alias(ROW_ORDER))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")

    def part(cond):
        return F.sum(F.when(cond, q))

    return (li.groupBy("l_orderkey")
            .agg(part(F.col("l_returnflag") == "A").alias("OfferSlots"),
                 part(F.col("l_returnflag") == "N").alias("OfferTables"),
                 part(F.col("l_returnflag") == "R").alias("OfferFood"),
                 part(F.col("l_linestatus") == "F").alias("OfferHotel"))
            .withColumn(ROW_ORDER, F.col("l_orderkey")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("line_id"),
        F.col("l_extendedprice").alias("amount"),
        F.datediff(F.lit(AS_OF).cast("timestamp_ntz").cast("date"),
                   F.col("l_shipdate").cast("date")).cast("bigint").alias("days_since_ship"),
        # (order, line number) repeats in the tables: with the other columns a row is unique
        F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey",
                 "l_suppkey").alias(ROW_ORDER))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """players with LastVisitDate as text in seven forms, by customer, instead of days."""
    orders = table(spark, sf_dir, "orders")
    last = (orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("_last"),
                                            _money_sum("o_totalprice").alias("_spend")))
    k, t = F.col("o_custkey"), F.col("_last")
    forms = ["M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'.5'", "MMM d, yyyy",
             "yyyy-MM-dd", None, "d.M.yyyy"]
    text = F.coalesce(*[F.when(k % 7 == i, F.date_format(t, form) if form else F.lit("not a date"))
                        for i, form in enumerate(forms)])
    return last.select(F.concat(F.lit("P"), k.cast("string")).alias("PlayerID"),
                       (F.col("_spend").cast("double") / 1000).alias("NetADT"),
                       text.alias("LastVisitDate"), k.alias(ROW_ORDER))


def dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir).select(
        F.col("ref_id").alias("Member No."), F.col("worth").alias("Net.Worth"),
        F.col("recency_days").alias("Days.Since"), ROW_ORDER)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text, most of them in forms that only some parses accept."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    cell = (F.when(k % 6 == 0, F.concat(F.lit("$"), price)).when(k % 6 == 1, F.concat(F.lit(" "), price, F.lit(" ")))
            .when(k % 6 == 2, F.concat(k.cast("string"), F.lit("e2"))).when(k % 6 == 3, F.lit("1,000"))
            .when(k % 6 == 4, F.concat(F.lit("-"), price)))
    return table(spark, sf_dir, "part").select(k.alias("ref_id"), cell.alias("cell"))


def awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with quotes, commas, line breaks, outer blanks and null tokens."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = (F.when(k % 6 == 0, F.concat(F.lit('say "'), name, F.lit('", twice')))
            .when(k % 6 == 1, F.concat(name, F.lit("\nsecond line")))
            .when(k % 6 == 2, F.concat(F.lit("  "), name, F.lit(" ")))
            .when(k % 6 == 3, F.lit("N/A")).when(k % 6 == 4, F.concat(F.lit('"'), name))
            .otherwise(name))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), k.cast("string")).alias("PlayerID"), text.alias("FullName"),
        F.when(k % 4 != 0, F.concat(F.lit("$"), F.col("c_acctbal").cast("string"))).alias("NetADT"))
