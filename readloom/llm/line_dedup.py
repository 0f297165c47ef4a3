"""Boilerplate lines by site-relative frequency, in DataFrame functions.

The visible lines of a page are its HTML without scripts, styles, comments and tags, broken at block tags. Per host, the
pages that hold a line are counted against all its pages; a line in more than the given share of them, and on enough pages,
is boilerplate and leaves all pages of the host.

Given results: null HTML has no lines. A page whose URL has no host keeps all its lines. A line counts once a page, however
often it stands there, and goes each time. Repeated pages count and stay each. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialise, small

#: Share of a host's pages above which a line is boilerplate, and the least pages that it must be on.
RATIO, LEAST_PAGES = 0.3, 3
#: Hosts and line hashes of 8 bytes up to which the table of the hosts' boilerplate is broadcast; a larger one is joined by shuffle.
BROADCAST_VALUES = 1_000_000
# What leaves a page, what breaks a line, and entities.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
ENDS = r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B\n]*"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The visible lines, without white space at either end and without empty ones."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BLOCK, "\n"), TAG, "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), ENDS, "\n")
    return F.split(F.substring(text, 2, 2147483647), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, bad): for each host with boilerplate, the hashes of these lines. pages has (host, lines).

    A host has at most its mean lines a page over `ratio` of them. Lines of one host are spread by their hash.
    """
    totals = pages.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    line = F.explode_outer(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))))
    counts = pages.where("host is not null").select("host", line.alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    over = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("bad"))


def clean(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(id, host, n_lines, n_dropped, text) for each page; text: the lines that stay."""
    rows = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), lines_of(F.col(html)).alias("lines"))
    # a page ends with a line end: the last part is empty
    rows = materialise(rows.select("id", "host", F.slice("lines", 1, F.size("lines") - 1).alias("lines")), "lines")
    bad = small(materialise(boilerplate(rows, ratio, least_pages), "boilerplate"), BROADCAST_VALUES, F.size("bad") + 4)
    kept = F.filter("lines", lambda x: ~F.array_contains("bad", F.xxhash64(x)))
    out = rows.join(bad, "host", "left").select("id", "host", "lines", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    return out.select(F.col("id").alias(id), "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


_TEXT = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')"
for _entity, _sign in ENTITIES:
    _TEXT = "replace({}, '{}', '{}')".format(_TEXT, _entity, _sign.replace("'", "''"))
SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '') AS host,
                  list_filter(string_split(regexp_replace(chr(10) || {_TEXT} || chr(10), '{ENDS}', chr(10), 'g'), chr(10)), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
n AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM n JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY host),
k AS (SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM p LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS INT) AS n_lines, CAST(len(lines) - len(kept) AS INT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
