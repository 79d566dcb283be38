"""URL filters: host and path rules, and pattern rules fetched by their rarest literal token.

Host rules like ``example.net/en/`` fit a host and its subdomains if the path
starts with the rule's; the longest rule wins.  They are found by joining the
URL's host suffixes with the rules' hosts.

Pattern rules are regular expressions.  A rule is indexed under one literal
token that every URL it fits must hold: of its literal tokens the one that the
fewest URLs of the table hold.  URLs are cut into the same tokens, tokens fetch
the rules indexed under them by an equi-join, and only fetched rules run.

Work is done once for each different URL, so that a URL on a third of all rows
is one row; verdicts then go back by a join that adaptive execution can split.

Defined cases: a null URL, or one without ``://``, has empty host and path and
matches no host rule; patterns see the lower-cased URL (null: none); of several
fitting patterns the least id is named; repeated rows stay; further columns pass
through, but for columns named like one of the results; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (rule, verdict)
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: (id, pattern over the lower-cased URL, literal tokens that every fit holds)
PATTERN_RULES = [
    ("adult-host", r"://([^/?#]*[.-])?adult([.-][^/?#]*)?([/?#]|$)", ["adult"]),
    ("bets-host", r"://([^/?#]*[.-])?free[.-]bets([.-][^/?#]*)?([/?#]|$)", ["free", "bets"]),
    ("casino-host", r"://([^/?#]*[.-])?casino([.-][^/?#]*)?([/?#]|$)", ["casino"]),
    ("pills-host", r"://([^/?#]*[.-])?cheap[.-]pills([.-][^/?#]*)?([/?#]|$)", ["cheap", "pills"]),
    ("porn-host", r"://([^/?#]*[.-])?porn([.-][^/?#]*)?([/?#]|$)", ["porn"]),
    ("spam-host", r"://([^/?#]*[.-])?spam[.-]farm([.-][^/?#]*)?([/?#]|$)", ["spam", "farm"]),
    ("click-track", r"[?&]adclick=[0-9]+", ["adclick"]),
    ("warez-path", r"://[^?#]*/warez/", ["warez"]),
]
#: Up to so many rules are sent to every task; beyond, rules are joined by shuffles.
MOST_SENT = 50_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The different runs of a-z and 0-9 of the lower-cased URL."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))


def suffixes(host: Column) -> Column:
    """The host and every part of it after a dot."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )


def sent(rules: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rules) if n <= MOST_SENT else rules


def host_verdicts(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, rule, verdict) of the longest rule that fits; ``urls`` has url, host, path, each url once."""
    rows = [(*r.partition("/")[::2], r, v) for r, v in rules]
    table = urls.sparkSession.createDataFrame(
        [(h, "/" + p, r, v) for h, p, r, v in rows], "suffix string, start string, rule string, verdict string"
    )
    return (
        urls.select("url", "path", F.explode(suffixes(F.col("host"))).alias("suffix"))
        .join(sent(table, len(rows)), "suffix")
        .where(F.startswith("path", "start"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("r"))
        .select("url", "r.rule", "r.verdict")
    )


def indexed(urls: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(id, pattern, token): every pattern rule under its rarest literal token (ties: the least)."""
    for name, pattern, tokens in rules:
        if not tokens or not all(re.fullmatch("[a-z0-9]+", t) for t in tokens):
            raise ValueError(f"{name}: needs literal tokens of a-z and 0-9")
        re.compile(pattern)
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(i, p, t) for i, p, ts in rules for t in ts], "id string, pattern string, token string"
    )
    wanted = sent(table.select("token").distinct(), len(rules))
    counts = (
        urls.select(F.explode(tokens_of(F.col("url"))).alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = F.min_by(F.struct("pattern", "token"), F.struct(F.coalesce("n", F.lit(0)), "token"))
    return table.join(counts, "token", "left").groupBy("id").agg(rarest.alias("r")).select("id", "r.pattern", "r.token")


def pattern_verdicts(urls: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(url, pattern_rule): the least id of the fetched rules that fit."""
    index = stored(indexed(urls, rules), "rules")
    low = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
        .join(sent(index, len(rules)), "token")
        .where(F.rlike(low, F.col("pattern")))
        .groupBy("url")
        .agg(F.min("id").alias("pattern_rule"))
    )


def url_filter(
    pages: DataFrame,
    url: str = "url",
    host_rules: list[tuple[str, str]] = HOST_RULES,
    pattern_rules: list[tuple[str, str, list[str]]] = PATTERN_RULES,
) -> DataFrame:
    """``pages`` with host, path, rule, pattern_rule and verdict (allow or block).

    A host rule decides; without one a fitting pattern blocks, and else the URL is allowed.
    """
    key = f"url_{uuid.uuid4().hex[:8]}"
    column = F.col(f"`{url}`")
    urls = stored(pages.where(column.isNotNull()).select(column.alias("url")).distinct(), "urls").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    )
    found = (
        host_verdicts(urls, host_rules)
        .join(pattern_verdicts(urls, pattern_rules), "url", "full")
        .select(
            F.col("url").alias(key), "rule", "pattern_rule",
            F.coalesce("verdict", F.when(F.col("pattern_rule").isNotNull(), F.lit("block"))).alias("verdict"),
        )
    )
    added = {"host", "path", "rule", "pattern_rule", "verdict"}
    return pages.withColumn(key + "_of", column).drop(*(added & set(pages.columns))).join(
        found, F.col(key + "_of") == F.col(key), "left"
    ).select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in added],
        host_of(F.col(key + "_of")).alias("host"),
        path_of(F.col(key + "_of")).alias("path"),
        "rule",
        "pattern_rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
