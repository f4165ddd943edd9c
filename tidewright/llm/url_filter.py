"""URL filters by hashed host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into expressions: the suffixes of the host at label
boundaries and the prefixes of the path, of only those depths and lengths that occur in
the rules. Expressions meet the rules in an equi-join on the first `prefix_hex` hex digits
of their SHA-256, then the full digests are compared. The longest rule (host and path
characters together, then host) decides; block beats allow among equals.

Rules are broadcast while they are at most `broadcast_rules`; beyond, the join shuffles.
A null url or one without "://" has an empty host and path and no rule. Null or empty
rule hosts, null paths and repeated rules are ignored; so are extra columns. Repeated rows
get a verdict each; an empty table, of pages or rules, is no exception.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 1_000_000


def host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path columns."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return pages.withColumns(
        {
            "host": F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), empty),
            "path": F.coalesce(path, empty),
        }
    )


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    prefix_hex: int = 8,
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """pages(page_id, url) judged by rules(verdict, host, path): page_id, host, path, rule, verdict."""
    rules = rules.where(
        "host is not null and host <> '' and path is not null and verdict is not null"
    ).select("verdict", "host", "path").distinct()
    rules = rules.select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.")).alias("depth"),
        F.length("path").alias("path_length"),
    )
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    shape = rules.agg(
        F.collect_set("depth").alias("d"), F.collect_set("path_length").alias("p"), F.count(F.lit(1)).alias("n")
    ).first()
    parsed = host_and_path(
        pages.select("page_id", F.col("url").cast("string").alias("url"))
    ).select("page_id", "host", "path")
    depths, lengths = F.array(*map(F.lit, sorted(shape["d"]))), F.array(*map(F.lit, sorted(shape["p"])))
    if not shape["n"]:
        return parsed.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    labels = F.split("host", r"\.")
    places = parsed.select("host", "path").where("host <> ''").distinct().withColumn("labels", labels)
    suffixes = F.transform(
        F.filter(depths, lambda d: d <= F.size("labels")), lambda d: F.array_join(
            F.slice("labels", F.size("labels") - d + 1, d), "."
        )
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    said = places.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select(
        "host", "path", "suffix", F.explode("prefixes").alias("prefix")
    )
    said = said.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("seen")).withColumn(
        "short", F.substring("seen", 1, prefix_hex)
    )
    few = F.broadcast(rules) if shape["n"] <= broadcast_rules else rules
    met = said.join(few, "short").where("seen = digest")
    best = F.max(
        F.struct(
            F.length("rule").alias("length"),
            "host_length",
            (F.col("verdict") == "block").alias("block"),
            "rule",
            "verdict",
        )
    )
    judged = met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    # urls without a host match nothing; they would all meet in one task
    none = F.lit(None).cast("string")
    out = parsed.where("host <> ''").join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", "verdict"
    )
    out = out.unionByName(
        parsed.where("host = ''").select("page_id", "host", "path", none.alias("rule"), none.alias("verdict"))
    )
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
