"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that
hold it over the host's page total; lines above `ratio` are boilerplate of that host and
are dropped from its pages. A line that one page alone holds repeats nothing and stays,
so a host of one page keeps all its lines.

The plan counts (host, line digest) with partial aggregation, so that a host or a
line with a third of all rows arrives as one partial count per task. A host has at
most (mean lines per page / ratio) boilerplate lines, so its list is a short array
that joins the pages by host, and meets a page's lines in one hashed intersection. The lists
are counted first: up to `BROADCAST_LINES` lines in all they are broadcast, beyond that
Spark joins by host and splits a skewed one.

Cases: a null text stays null with no lines. A page with the same line twice counts
once. Blank lines are never counted or dropped. Pages without a host (null) form one
host. Repeated rows are pages of their own. Lines compare without outer blanks.
Columns beside those named are kept as they are; where two have the names of the
counts, other names (or none) can be asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.frames import saved

RATIO, BROADCAST_LINES = 0.05, 100_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


#: What is no text of a page, and the tags that end a line, as patterns that Java and RE2 read alike. What is opened and
#: never closed goes to the page's end, so that no later opening searches it again.
_NO_TEXT = r"(?is)<(?:!--(?:.*?-->|.*)|(?:script|style|noscript|template|head)(?:\s[^>]*)?(?:>(?:.*?</(?:script|style|noscript|template|head)\s*>|.*)|\z))"
_ENDS_LINE = r"(?i)</?(?:p|div|li|ul|ol|br|tr|table|h[1-6]|section|article|header|footer|nav|aside|main|blockquote|pre|td|th|dd|dt|dl|form|hr|body|html)(?:\s[^>]*)?/?>"


def lines_of_html(html: Column) -> Column:
    """The text of a page by its block tags, a line each; entities stay as they are written.

    Tags are looked for up to the last `>` only: each scan ends at one, and time is linear in any page.
    """
    text = F.regexp_replace(html, _NO_TEXT, "")
    tagged = F.regexp_extract(text, "(?s)^.*>", 0)
    return F.concat(F.regexp_replace(F.regexp_replace(tagged, _ENDS_LINE, "\n"), "<[^>]*>", ""), F.substring(text, F.length(tagged) + 1, F.length(text)))


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.trim(x)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO) -> DataFrame:
    """(host, drop): for each host that has any, the digests of its boilerplate lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    seen = pages.select(host.alias("host"), F.explode(F.array_distinct(_digests(lines))).alias("line"))
    totals = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    # Totals are one row per host. A line's own count is compared after the join; hosts are few against lines.
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("c.host").agg(F.collect_list("line").alias("drop"))


def dedup(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The pages with boilerplate lines dropped from the text, and beside it, in the columns `counts` names, how many lines there were and how many are gone."""
    text = F.col(text_col)
    drops = saved(boilerplate(pages, host, text, ratio).toDF("__host", "__drop"))
    if (drops.agg(F.sum(F.size("__drop"))).collect()[0][0] or 0) <= BROADCAST_LINES and drops.count() <= BROADCAST_LINES:
        drops = F.broadcast(drops)  # and the pages stay where they are
    parted = F.split(text, "\n")
    # Lines and what of them goes are bound once for a page: inside a lambda a plain column's expression is computed for each line.
    once = F.struct(parted.alias("lines"), F.array_intersect(_digests(parted), F.col("__drop")).alias("gone"))
    kept = F.transform(F.array(once), lambda s: F.filter(s["lines"], lambda x: (F.trim(x) == "") | ~F.array_contains(s["gone"], F.xxhash64(F.trim(x)))))[0]
    joined = pages.join(drops, host.eqNullSafe(F.col("__host")), "left").withColumn("__kept", F.when(F.col("__drop").isNull(), parted).otherwise(kept))
    own = {"__lines": F.coalesce(F.size(parted), F.lit(0)), "__left": F.size("__kept"), text_col: F.when(F.col("__drop").isNull(), text).otherwise(F.array_join("__kept", "\n"))}
    rows = joined.withColumns(own).drop("__host", "__drop", "__kept")
    if counts:
        rows = rows.withColumns({counts[0]: F.col("__lines"), counts[1]: F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__lines") - F.col("__left"))})
    return rows.drop("__lines", "__left")
