"""Line deduplication by how many of a site's pages hold a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that each host's pages are dealt to when they meet the host's lines, so that no host lands in one task.
SALTS = 64


def boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """__ld_host, __ld_line (hash) of the lines that more than `ratio` of the host's pages hold, and at least min_pages of them.
    A line counts once a page. Blank lines never count. Counts are partially summed before the shuffle, so one host with
    most of the pages, or one line on all of them, stays spread over the tasks. A host has at most (lines per page) /
    ratio such lines."""
    # a line's hash: 64 bits, so that what is shuffled does not grow with the length of lines
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    lines = F.array_distinct(F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda x: F.trim(x) != ""))
    pages = docs.select(host.alias("__ld_host"), F.transform(lines, lambda x: F.xxhash64(x)).alias("__ld_lines"))
    # the total of a host rides along as a line of its own, so that one pass and one shuffle give both counts
    counts = pages.select("__ld_host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "__ld_lines")).alias("__ld_line")).groupBy("__ld_host", "__ld_line").agg(F.count(F.lit(1)).alias("__ld_pages"))
    frequent = counts.where(F.col("__ld_line").isNotNull() & (F.col("__ld_pages") >= min_pages))
    totals = counts.where(F.col("__ld_line").isNull()).select("__ld_host", F.col("__ld_pages").alias("__ld_total"))
    return frequent.join(totals, "__ld_host").where(F.col("__ld_pages") > F.lit(ratio) * F.col("__ld_total")).select("__ld_host", "__ld_line")


def drop_lines(docs: DataFrame, ratio: float = 0.1, min_pages: int = 3, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with text_col without its host's boilerplate lines, and n_lines and n_dropped (in place of columns of these
    names).

    A document stays even if all its lines go (its text is then empty); a null text stays null with no lines; null hosts
    are one host of their own; repeated rows are pages of their own; a text may have any length; an empty table gives an
    empty one. Other columns pass through, whatever their names."""
    known = boilerplate(docs, ratio, min_pages, host_col, text_col).groupBy("__ld_host").agg(F.collect_set("__ld_line").alias("known"))
    known = known.select("__ld_host", "known", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # the row as it is in one column, so that no name can clash; dealt by all of it, so that copies of a page are spread
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct("*").alias("page"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__ld_host"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(SALTS)).cast("int").alias("salt"))
    text = F.col("page")[text_col]
    rows = rows.join(known, ["__ld_host", "salt"], "left").withColumn("lines", F.split(text, "\n", -1))
    rows = rows.withColumn("kept", F.filter("lines", lambda x: ~F.coalesce(F.array_contains("known", F.xxhash64(x)), F.lit(False))))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("page")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, n("lines").alias("n_lines"), (n("lines") - n("kept")).alias("n_dropped"))


#: DuckDB SQL for what op4 returns of the table documents.
SQL = """
WITH lines AS (
  SELECT coalesce(source, '') AS host, doc_id, unnest(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> ''))) AS line
  FROM documents),
totals AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
known AS (
  SELECT host, line FROM lines JOIN totals USING (host)
  GROUP BY host, line, total HAVING count(*) >= 3 AND count(*) > 0.1 * total),
cut AS (
  SELECT doc_id, coalesce(source, '') AS host, text IS NOT NULL AS has, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
SELECT doc_id, count(*) FILTER (WHERE has)::BIGINT AS n_lines, count(k.line)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(c.line, chr(10) ORDER BY i) FILTER (WHERE k.line IS NULL), '')) AS kept_sha256
FROM cut c LEFT JOIN known k ON c.host = k.host AND c.line = k.line GROUP BY doc_id
"""
