r"""Line deduplication by site-relative frequency.

Pages are grouped by the host of their URL. A page's lines are its visible text, cut at line ends and at block-level
tags, white space collapsed. A line is boilerplate when it stands on at least ``LEAST_COPIES`` pages of its host and on
more than one page in ``SHARE``, on hosts of at least ``LEAST_PAGES`` pages; every place of it is dropped.

Counting explodes the distinct line hashes of a page and sums them with map-side combination, so a host that holds a
third of the pages meets in partial sums only. What is joined back is one row for each host: boilerplate lines of a
host number at most SHARE times its mean distinct lines a page, whatever its pages. Spark broadcasts that table only
where its stored size is under the session's threshold.

Defined results: null html has no lines; null and malformed URLs share the host ''; each row counts as a page, repeated
rows too; a line that a page repeats counts once; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import stored, table

SHARE, LEAST_COPIES, LEAST_PAGES = 10, 3, 5
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
#: What ends a line: scripts, styles and comments, which are removed with their content, and block-level tags.
BREAK = rf"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->|/?(?:{BLOCK_TAGS})\b[^>]*>)"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), BREAK, "\n"), TAG, "")
    text = F.btrim(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), F.lit(" \n"))
    return F.filter(F.split(text, r" ?\n[ \n]*"), lambda x: x != "")


def boilerplate(lines: DataFrame, share: int = SHARE, least_copies: int = LEAST_COPIES, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, drop: the hashes of each host's boilerplate lines."""
    totals = lines.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least_pages)
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    counts = lines.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_copies)
    return counts.join(totals, "host").where(share * F.col("n") > F.col("n_pages")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def drop_boilerplate(pages: DataFrame, **limits: int) -> DataFrame:
    """page_id, host, lines and kept (the lines that stay) of every page. Lines are cut once and stored."""
    lines = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")))
    drop = stored(boilerplate(lines, **limits)).withColumnRenamed("host", "_host")
    joined = lines.join(drop, F.col("host") == F.col("_host"), "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x))))
    return joined.select("page_id", "host", "lines", kept.alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_boilerplate(table(spark, sf_dir, "pages"))
    text = F.array_join("kept", "\n")
    return done.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLE = {
    "op9_line_dedup": rf"""
WITH own AS (SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'),
    '[ \t\x0B\f\r]*\n[ \t\x0B\f\r\n]*', chr(10), 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM pages),
line AS (SELECT r, page_id, host, i, lines[i] AS l FROM (SELECT r, page_id, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM own))),
bad AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT r) AS n FROM line GROUP BY ALL) JOIN (SELECT host, count(*) AS n_pages FROM own GROUP BY host) USING (host)
  WHERE n >= {LEAST_COPIES} AND n_pages >= {LEAST_PAGES} AND {SHARE} * n > n_pages),
marked AS (SELECT line.*, bad.l IS NOT NULL AS gone FROM line LEFT JOIN bad ON line.host = bad.host AND line.l = bad.l),
done AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(strlen(coalesce(kept, '')) AS BIGINT) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256
FROM own LEFT JOIN done USING (r)"""
}
