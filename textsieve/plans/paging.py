"""Queries on pages: their lines, their texts, and matches back in their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match
from ..sources import pages
from .catalog import _t, query

_NAMES = "|".join(pages.BLOCKS)
#: Lines of each page, numbered by block and line, with where they start in the page's text.
_L = rf"""b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)</?({_NAMES})\b[^>]*>', chr(30), 'g'), '(?i)</?br\b[^>]*>', chr(10), 'g'), '(?i)<[a-z/!?][^>]*>', '', 'g') AS h FROM b),
d AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(30)) AS bs FROM c),
e AS (SELECT page_id, generate_subscripts(bs, 1) AS bi, string_split(unnest(bs), chr(10)) AS ls FROM d),
f AS (SELECT page_id, bi, generate_subscripts(ls, 1) AS li, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS x FROM e),
g AS (SELECT page_id, bi, li, x, right(x, 1) IN ('-', chr(173)) AS wrap FROM f WHERE x <> ''),
h AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY bi) - 1 AS block, row_number() OVER (PARTITION BY page_id, bi ORDER BY li) - 1 AS line, CASE WHEN wrap THEN x[1:length(x) - 1] ELSE x END AS said, wrap, lead(li) OVER (PARTITION BY page_id, bi ORDER BY li) IS NULL OR wrap AS tight FROM g),
l AS (SELECT page_id, block, line, wrap, said, CASE WHEN tight THEN said ELSE said || ' ' END AS part, coalesce(sum(length(said) + CASE WHEN tight THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY block, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h)"""


@query(f"WITH {_L} SELECT page_id, block::INTEGER AS block, line::INTEGER AS line, start::INTEGER AS start, said AS text, wrap FROM l")
def scan_pages(spark, d):
    return pages.scan(_t(spark, d, "pages")).select("page_id", F.explode("lines").alias("x")).select("page_id", "x.*")


_WORDS = ["the", "de la", "und"]


# each match's source, read again as a page is, is the word, tags and dropped hyphens inside it or not; matches of several words
# may stand over tags that part them
@query(f"""WITH {_L}, t AS (SELECT page_id, regexp_extract_all(lower(string_agg(part, '' ORDER BY block, line)), '[\\p{{L}}\\p{{N}}_]+') AS w FROM l GROUP BY page_id), i AS (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT page_id, phrase, count(*)::BIGINT AS n, CASE WHEN contains(phrase, ' ') THEN NULL ELSE count(*)::BIGINT END AS same FROM i, (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) v(phrase) WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase GROUP BY page_id, phrase""")
def page_matches(spark, d):
    source = _t(spark, d, "pages")
    scanned = pages.scan(source)
    sought = spark.createDataFrame([(i, "words", w) for i, w in enumerate(_WORDS)], "ord long, list_key string, phrase string")
    found = match.search_all(scanned.select(F.col("page_id").alias("doc_id"), "text"), sought).select(F.col("doc_id").alias("page_id"), "phrase", "start", "end")
    placed = pages.located(scanned, found).join(found.select("page_id", "phrase", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), ["page_id", "start", "end"])
    per_page = placed.groupBy("page_id").agg(F.collect_list(F.struct("phrase", "source_start", "source_end")).alias("hits"))
    said = lambda x: F.substring("html", x["source_start"].cast("int") + 1, (x["source_end"] - x["source_start"]).cast("int"))
    read = source.join(per_page, "page_id").select("page_id", F.explode(F.transform("hits", lambda x: F.struct(x["phrase"].alias("phrase"), said(x).alias("said")))).alias("x"))
    counted = read.groupBy("page_id", "x.phrase", "x.said").agg(F.count(F.lit(1)).alias("k"))
    # most are the word as it stands there
    plain, single = F.lower("said") == F.col("phrase"), ~F.contains("phrase", F.lit(" "))
    again = pages.scan(counted.where(single & ~plain).select("said").distinct().withColumn("html", F.col("said")), "said").select("said", F.lower("text").alias("again"))
    same = plain | F.coalesce(F.col("again") == F.col("phrase"), F.lit(False))
    return counted.join(again, "said", "left").groupBy("page_id", "phrase").agg(F.sum("k").alias("n"), F.when(~F.contains("phrase", F.lit(" ")), F.sum(F.when(same, F.col("k")).otherwise(0))).alias("same"))
