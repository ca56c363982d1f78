"""URL rules by expressions and short hash prefixes.

A rule is a host and a path; it fits its host and all subdomains when the URL's
path starts with the rule's path. Every distinct (host, path) of the input is
expanded into host-suffix and path-prefix expressions, but only in the shapes
(number of labels, path length) that some rule has, so a URL gives at most as
many expressions as the rule set has shapes. Expressions meet the rules in an
equi-join on the first 32 bits of their SHA-256 digests; the full digest is
confirmed afterwards and the longest rule wins.

Defined cases: a null URL, or one without ``://``, has an empty host and an
empty path and fits no rule. Rules of equal length: the longer host wins, then
``block``. Repeated rows are judged alike and all returned. Extra columns are
kept as they are. Null rule fields never fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarflow.llm.texts import carried, lower_ascii

SHORT_HEX_DIGITS = 8


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT_HEX_DIGITS)


def expressions(keys: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """One row per (host, path) and expression of one of the given shapes."""
    host, path = F.col("host"), F.col("path")
    fitting = [
        F.when(
            (_labels(host) >= labels) & (F.length(path) >= length),
            F.struct(
                F.substring_index(host, ".", -labels).alias("suffix"),
                F.substring(path, 1, length).alias("prefix"),
            ),
        )
        for labels, length in shapes
    ]
    made = F.explode(F.array_compact(F.array(*fitting)))
    return keys.select("host", "path", made.alias("made")).select(
        "host", "path", _digest(F.col("made.suffix"), F.col("made.prefix")).alias("digest")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``row`` (the input row) with host, path, rule and verdict.

    ``rules`` has host, path and verdict. Only its distinct shapes come to the
    driver: pairs of small numbers, at most labels times path lengths.
    """
    parsed = carried(pages, host=url_host(F.col(url)), path=url_path(F.col(url)))
    known = rules.where(
        F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()
    ).withColumn("host", lower_ascii(F.col("host")))
    shapes = [
        (row["labels"], row["length"])
        for row in known.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("length"))
        .distinct()
        .collect()
    ]
    if not shapes:
        return parsed.select(
            "row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )

    digest = _digest(F.col("host"), F.col("path"))
    listed = known.select(
        _short(digest).alias("short"),
        digest.alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        "verdict",
    )
    # Hot URLs are one row here: the distinct step counts them down before the shuffle.
    keys = parsed.select("host", "path").distinct()
    found = (
        expressions(keys, sorted(shapes))
        .withColumn("short", _short(F.col("digest")))
        .join(listed, "short")
        .where(F.col("digest") == F.col("rule_digest"))
    )
    order = F.struct(F.length("rule"), F.col("host_length"), (F.col("verdict") == "block").cast("int"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    # The page side may hold one URL many times; adaptive execution splits such a partition.
    return parsed.join(best, ["host", "path"], "left").select(
        "row",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
