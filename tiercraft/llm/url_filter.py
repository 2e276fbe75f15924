"""URL rules by host suffix and path prefix.

Each URL is expanded into its host suffixes (at label borders) times those
prefixes of its path whose lengths occur among the rules. Expressions and rules
meet in an equi-join on 32 bits of their SHA-256, hits are confirmed on the
full digest, and the longest fitting rule of a URL wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, lower_ascii, without

#: (verdict, host, path): the rules of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1)
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lower_ascii(bare)).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    kept = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when((F.coalesce(F.instr(url, "://"), F.lit(0)) > 0) & (F.instr(kept, "/") > 0),
                  F.substring(kept, F.instr(kept, "/"), F.length(kept))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has verdict, host and path. A rule fits its host and all
    subdomains if the path starts with its path; the longest (host and path
    together) wins, then the longer host, then block over allow. Without a rule
    ``rule`` is null and ``verdict`` is ``default``.

    Null urls and urls without ``://`` have an empty host and path and no rule;
    repeated rows are judged alike; null or repeated rules do nothing more;
    input columns called like the four new ones are replaced; empty tables
    (pages or rules) give empty results and the default verdict.

    Distinct (host, path) pairs are judged and joined back, so copies of a URL
    cost one row; Spark broadcasts the rules while they are small and splits
    skewed join keys beyond that.
    """
    rules = rules.select("verdict", "host", "path").dropna().distinct()
    # Distinct lengths of rule paths and label counts of rule hosts: bounded by the longest ones, not by the rules.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    depths = sorted(r[0] for r in rules.select(_n_labels(F.col("host"))).distinct().collect())
    pages = without(pages, "host", "path", "rule", "verdict")
    parsed = (pages.withColumn("host", url_host(col(url_col)))
              .withColumn("path", url_path(col(url_col))))
    found = _judge(parsed.select("host", "path").distinct(), rules, lengths, depths)
    h, p, r, v, d, e = fresh(parsed, "__h", "__p", "__r", "__v", "__d", "__e")
    found = found.select(F.col("host").alias(h), F.col("path").alias(p),
                         F.col("rule").alias(r), F.col("rule_verdict").alias(v), F.lit(0).alias(e))
    # URLs without a host fit no rule; dealt out they do not meet in one task.
    dealt = parsed.withColumn(d, F.when(F.col("host") == "", 1 + F.monotonically_increasing_id() % 1000)
                              .otherwise(0).cast("int"))
    return (dealt.join(found, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p))
                       & (F.col(d) == F.col(e)), "left")
            .select(*map(col, pages.columns), "host", "path", F.col(r).alias("rule"),
                    F.coalesce(F.col(v), F.lit(default)).alias("verdict")))


def _n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _judge(urls: DataFrame, rules: DataFrame, lengths: list[int], depths: list[int]) -> DataFrame:
    # Only suffixes of as many labels as some rule's host has, cut from the right end.
    suffixes = F.array_compact(F.array(*[F.when(_n_labels(F.col("host")) >= k, F.substring_index("host", ".", -k))
                                         for k in depths])) if depths else F.array().cast("array<string>")
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths
                       else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = (urls.where(F.col("host") != "")
                   .select("host", "path", F.explode(suffixes).alias("suffix"))
                   .select("host", "path", "suffix", F.explode(fitting).alias("n"))
                   .select("host", "path", _digest(F.col("suffix"), F.expr("left(path, n)")).alias("d"))
                   .withColumn("short", _short(F.col("d"))))
    keyed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rd"),
        F.struct((F.length("host") + F.length("path")).alias("size"),
                 F.length("host").alias("host_size"),
                 (F.col("verdict") == "block").cast("int").alias("strict"),
                 F.concat("host", "path").alias("rule"),
                 F.col("verdict").alias("rule_verdict")).alias("hit"))
    keyed = keyed.withColumn("short", _short(F.col("rd")))
    return (expressions.join(keyed, "short").where(F.col("d") == F.col("rd"))
            .groupBy("host", "path").agg(F.max("hit").alias("hit"))
            .select("host", "path", "hit.rule", "hit.rule_verdict"))
