"""URL filters: prefix rules by host, then pattern rules found by their rarest literal token.

A pattern is literal text with `*` (anything), `^` (a separator or the end) and `||` (the start of a host label).
Its tokens are the runs of letters and digits that stand whole in any URL that it matches. Each pattern is indexed by
that token of its own which is in the fewest URLs of the corpus; a URL's tokens fetch the patterns indexed
there, and only those run as regular expressions. Patterns without a token are indexed by "", which every URL has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import ascii_lower, checked_broadcast, materialize, quoted


@dataclass(frozen=True)
class Pattern:
    """allow beats block where both match."""

    text: str
    action: str = "block"


#: Values that are fixed: rules by host suffix and path prefix.
PREFIX_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Pages that are rarely text worth training on; a parameter.
PATTERNS = (
    Pattern("/login^"),
    Pattern("/signup^"),
    Pattern("/cart^"),
    Pattern("/wp-admin/"),
    Pattern("^casino^"),
    Pattern("^poker^"),
    Pattern("^xxx^"),
    Pattern("||ads."),
    Pattern("||tracker."),
    Pattern("/download/*.exe^"),
    Pattern("?page=2&ref=x^"),
    Pattern("||docs.*/login^", "allow"),
)
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"
TOKEN = "[^a-z0-9]+"


def compile_pattern(text: str) -> str:
    """A regular expression to be found in a lower-cased URL."""
    out, rest = "(?s)", text.lower()
    if rest.startswith("||"):
        out, rest = r"(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", rest[2:]
    return out + "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.sub(r"([^a-z0-9])", r"\\\1", c) for c in rest)


def pattern_tokens(text: str) -> list[str]:
    """Runs of letters and digits with something on either side that no letter or digit can take the place of."""
    anchored, rest = text.startswith("||"), text.lower().removeprefix("||")
    out = []
    for m in re.finditer("[a-z0-9]+", rest):
        before = rest[m.start() - 1] if m.start() else "." if anchored else "*"
        after = rest[m.end()] if m.end() < len(rest) else "*"
        if before != "*" and after != "*":
            out.append(m[0])
    return sorted(set(out))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prefix_verdicts(urls: DataFrame, rules=PREFIX_RULES) -> DataFrame:
    """url, rule and action of the longest rule whose host is the url's or a suffix of whole labels, and whose path starts its path. urls: distinct url, host, path."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(a, h, p, h + p) for a, h, p in rules] or [("", "", "", "")], "action string, suffix string, start string, rule string").where("rule != ''")
    deepest = max([h.count(".") + 1 for _, h, _ in rules], default=1)
    labels = F.split("host", r"\.", -1)
    # No rule has more labels than this, so longer suffixes can't fit.
    some = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.lit(deepest))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(some)), lambda i: F.array_join(F.slice(some, i, F.lit(deepest)), "."))
    each = urls.where("host != ''").select("url", "path", F.explode(suffixes).alias("suffix"))
    fits = each.join(checked_broadcast(table, len(rules)), "suffix").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("url").agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "action")).alias("best"))
    return best.select("url", "best.rule", "best.action")


def url_tokens(urls: DataFrame) -> DataFrame:
    """url, low (lower-cased) and each distinct token of it, "" included."""
    low = ascii_lower(F.col("url"))
    return urls.select("url", low.alias("low"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(low, TOKEN)))).alias("token"))


def pattern_index(urls: DataFrame, patterns=PATTERNS) -> DataFrame:
    """token, regex and allow (0 or 1) of each pattern, by its token that the fewest of the urls have."""
    spark = urls.sparkSession
    rows = [(i, compile_pattern(p.text), int(p.action == "allow"), t) for i, p in enumerate(patterns) for t in (pattern_tokens(p.text) or [""])]
    table = spark.createDataFrame(rows, "pattern int, regex string, allow int, token string")
    wanted = checked_broadcast(table.select("token").distinct(), len(rows))
    counts = url_tokens(urls).where("token != ''").join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    chosen = table.join(counts, "token", "left").groupBy("pattern", "regex", "allow").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), F.col("token"))).alias("token"))
    return materialize(chosen.select("token", "regex", "allow"), small=True)


def pattern_verdicts(urls: DataFrame, patterns=PATTERNS) -> DataFrame:
    """url and verdict of each url that a pattern matches."""
    index = checked_broadcast(pattern_index(urls, patterns), len(patterns))
    hits = url_tokens(urls).join(index, "token").where(F.expr("low rlike regex"))
    return hits.groupBy("url").agg(F.when(F.max("allow") == 1, "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, rules=PREFIX_RULES, patterns=PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, matched (whether a pattern matched).

    The verdict is that of the longest prefix rule that fits; else of the patterns, else allow. A null url or one
    without :// has an empty host and path and fits no prefix rule; a null url is allowed. Each distinct url is judged
    once, so repeated rows have equal results. An empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"))
    urls = materialize(rows.where("url is not null").select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    known = materialize(urls.join(prefix_verdicts(urls, rules), "url", "left").join(pattern_verdicts(urls, patterns), "url", "left"))
    joined = rows.join(known, "url", "left")  # plain tables both: the rows of a url that many pages have can be split
    return joined.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("action", "verdict", F.lit("allow")).alias("verdict"), F.col("verdict").isNotNull().alias("matched"),
    )
