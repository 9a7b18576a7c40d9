"""Queries that look for all kinds of things in one pass, and on what comes of the hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import automaton, highlight, match, stats
from .catalog import _LK, _PATTERNS, _W, _lexicon, _sql_values, _t, query
from .matching import _T

#: Each pattern's matches with their number, and what stands before them.
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS pattern_name, {i} AS later, unnest(regexp_extract_all(lower(text), '{p}')) AS m, generate_subscripts(regexp_extract_all(lower(text), '{p}'), 1) AS k, string_split_regex(lower(text), '{p}') AS ps, regexp_extract_all(lower(text), '{p}') AS ms FROM documents WHERE regexp_matches(lower(text), '{p}')"
    for i, (k, p) in enumerate(_PATTERNS.items())
)
#: Matches with places and tokens, of those with the same tokens the last pattern's.
_X = f"""h AS ({_HITS}), hb AS (SELECT doc_id, pattern_name, later, m, length(array_to_string(ps[1:k], '')) + length(array_to_string(ms[1:k - 1], '')) AS b FROM h),
x AS (SELECT hb.doc_id, pattern_name, later, m, b, t1.i AS i1, t2.i AS i2 FROM hb JOIN t t1 ON t1.doc_id = hb.doc_id AND t1.s <= b AND b < t1.s + length(t1.raw) JOIN t t2 ON t2.doc_id = hb.doc_id AND t2.s <= b + length(m) - 1 AND b + length(m) - 1 < t2.s + length(t2.raw)
QUALIFY row_number() OVER (PARTITION BY hb.doc_id, t1.i, t2.i ORDER BY later DESC, b DESC) = 1)"""


@query(f"WITH {_T}, {_X} SELECT doc_id, pattern_name, m AS found, b::BIGINT AS start_pos, (b + length(m))::BIGINT AS end_pos, i1::BIGINT AS start_token, i2::BIGINT AS end_token FROM x")
def regex_spans(spark, d):
    return automaton.regex_rows(_t(spark, d, "documents"), _PATTERNS)


# order, list, phrase, type, ordered, forms, flags
_SOUGHT = [
    (0, "common", "of the", "text", False, None, True),
    (1, "names", "The", "surname", True, ["the", "them", "then", "thene", "under"], True),
    (2, "romance", "de la", "text", True, None, True),
    (3, "names", "By-Nc", "surname", True, ["by-nc", "by-ncs", "nc"], True),
    (4, "people", "The and the", "full_name", True, ["the and the", "the of the", "and the of", "the la"], True),
    (5, "german", "die der", "text", True, None, True),
    (6, "single", "the", "text", True, None, True),
    (7, "off", "la", "text", True, None, False),
    (8, "off", "Les", "surname", True, ["les"], False),
    (9, "blank", "!!!", "text", True, None, True),
    (10, "people", "Die und", "full_name", True, ["die und der", "die die und"], True),
    (11, "common", "in the and", "text", False, None, True),
]
_TEXTS = _sql_values([(r[0], r[1], r[2], r[4]) for r in _SOUGHT if r[3] == "text" and r[6]], "ord, list_key, phrase, ordered", "s0")
_FORMS = lambda kind, begins: _sql_values([(r[0], r[1], r[2], f) for r in _SOUGHT if r[3] == kind and r[6] for f in r[5] if begins(f)[:3] == r[2].lower()[:3] and (kind == "surname" or f.count(" ") == 2)], "ord, list_key, phrase, form", "f0")


#: Everything that search_all finds, with tokens and characters, as `al`.
_ALL = rf"""WITH {_W}, {_LK}, {_T}, {_X},
n AS (SELECT doc_id, i, raw, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM t WHERE regexp_matches(raw, '^[\p{{L}}\p{{N}}_]')),
lw AS (SELECT wk.doc_id, wk.w AS keys, w.w AS plain, nn.ti, nn.ts, nn.te FROM wk JOIN w USING (doc_id) JOIN (SELECT doc_id, list(i ORDER BY j) AS ti, list(s ORDER BY j) AS ts, list(s + length(raw) ORDER BY j) AS te FROM n GROUP BY doc_id) nn USING (doc_id)),
e AS (SELECT *, unnest(range(1, len(keys) + 1)) AS q FROM lw),
ph AS (SELECT ord, s0.list_key, s0.phrase, ordered, pk.pw, k FROM {_TEXTS} JOIN pk ON pk.phrase = s0.phrase),
m AS (SELECT doc_id, ord, list_key, phrase, CASE WHEN NOT ordered THEN 'unordered' WHEN k > 1 THEN 'phrase' ELSE 'word' END AS kind, ti[q] AS i1, ti[q + k - 1] AS i2, ts[q] AS s, te[q + k - 1] AS e
  FROM e JOIN ph ON q + k - 1 <= len(keys) AND CASE WHEN ordered THEN keys[q:q + k - 1] = pw ELSE list_sort(keys[q:q + k - 1]) = list_sort(pw) END
  UNION ALL SELECT doc_id, ord, list_key, phrase, 'full_name', ti[q], ti[q + 2], ts[q], te[q + 2] FROM e JOIN {_FORMS('full_name', lambda f: f.split(' ')[0])} ON array_to_string(plain[q:q + 2], ' ') = form),
pp AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+-[\p{{L}}\p{{N}}_]+') AS ms, string_split_regex(lower(text), '[\p{{L}}\p{{N}}_]+-[\p{{L}}\p{{N}}_]+') AS ps FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{N}}_]-[\p{{L}}\p{{N}}_]')),
pr AS (SELECT doc_id, m, length(array_to_string(ps[1:k], '')) + length(array_to_string(ms[1:k - 1], '')) AS b FROM (SELECT doc_id, ms, ps, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM pp)),
pt AS (SELECT pr.doc_id, m, b, n.i FROM pr JOIN n ON n.doc_id = pr.doc_id AND n.s = b),
c AS (SELECT doc_id, m AS form, i AS i1, i + 2 AS i2, b AS s, b + length(m) AS e FROM pt UNION ALL SELECT doc_id, lower(raw), i, i, s, s + length(raw) FROM n WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.doc_id = n.doc_id AND n.i IN (pt.i, pt.i + 2))),
al AS (SELECT * FROM m UNION ALL SELECT doc_id, ord, list_key, phrase, 'surname', i1, i2, s, e FROM c JOIN {_FORMS('surname', lambda f: f)} USING (form)
  UNION ALL SELECT doc_id, 12 + later, 'patterns', pattern_name, 'regex', i1, i2, b, b + length(m) FROM x)
"""


@query(f"""{_ALL}SELECT doc_id, ord::BIGINT AS ord, list_key, phrase, kind, i1::INTEGER AS start_token, i2::INTEGER AS end_token FROM al""")
def search_all(spark, d):
    return _all(spark, d).drop("start", "end", "form")


def _all(spark, d):
    flags = [(r[:6] + (r[6] if r[3] == "text" else True, r[6] if r[3] == "surname" else True)) for r in _SOUGHT]
    sought = match.small(spark, flags, "ord long, list_key string, phrase string, type string, ordered boolean, forms array<string>, search_text boolean, search_surnames boolean")
    return match.search_all(_t(spark, d, "documents"), sought, _PATTERNS, _lexicon(spark))


#: Colours of lists; the others are green.
_COLORS = {"common": "#ff0000", "names": "#0000ff", "patterns": "#ffcc00"}
_COLOR = "CASE list_key " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in _COLORS.items()) + " ELSE '#00ff00' END"
_PIECES = f"""{_ALL.rstrip()}, co AS (SELECT doc_id, s AS start, e AS "end", ord, {_COLOR} AS color, phrase AS title FROM al WHERE s < e),
cu AS (SELECT doc_id, x AS b, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS f FROM (SELECT doc_id, start AS x FROM co UNION SELECT doc_id, "end" FROM co)),
pi AS (SELECT doc_id, b AS start, f AS "end", arg_max(color, (co.start, ord, co."end", title)) AS color, arg_max(title, (co.start, ord, co."end", title)) AS title, count(*) AS n, list_sort(list_distinct(list(title))) AS titles
  FROM cu JOIN co USING (doc_id) WHERE co.start <= b AND co."end" >= f GROUP BY doc_id, b, f)"""


def _pieces(spark, d):
    color = F.coalesce(*(F.when(F.col("list_key") == k, c) for k, c in _COLORS.items()), F.lit("#00ff00"))
    return highlight.pieces(_all(spark, d).withColumn("color", color).withColumn("title", F.col("phrase")))


@query(f"""{_PIECES} SELECT doc_id, start::INTEGER AS start, "end"::INTEGER AS "end", color, title, n, titles FROM pi""")
def highlight_spans(spark, d):
    return _pieces(spark, d)


# a run for each of a document's lines, its line feed included
@query(f"""{_PIECES}, li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
ru AS (SELECT doc_id, k - 1 AS run, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(x) - 1 AS rs, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS re FROM li)
SELECT doc_id, run::BIGINT AS run, color, title, (greatest(start, rs) - rs)::BIGINT AS from_char, (least("end", re) - rs)::BIGINT AS to_char FROM pi JOIN ru USING (doc_id) WHERE start < re AND rs < "end" """)
def highlight_runs(spark, d):
    cut = F.split("text", "\n")
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.arrays_zip(F.transform(cut, F.char_length).alias("n"), text.starts(F.transform(cut, lambda x: F.concat(x, F.lit(" ")))).alias("s"))).alias("run", "x"))
    runs = lines.select("doc_id", F.col("run").cast("long").alias("run"), F.col("x.s").cast("long").alias("run_start"), (F.col("x.s") + F.col("x.n") + 1).cast("long").alias("run_end"))
    return highlight.by_runs(_pieces(spark, d), runs).select("doc_id", "run", "color", "title", "from_char", "to_char")


def _escaped(x: str) -> str:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{c}', '{e}')"
    return x


@query(f"""{_PIECES}, tx AS (SELECT doc_id, text, start, "end", color, title, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS bef FROM pi JOIN documents USING (doc_id)),
pa AS (SELECT doc_id, string_agg({_escaped("substr(text, bef::BIGINT + 1, (start - bef)::BIGINT)")} || '<mark style="background:' || color || '" title="' || {_escaped("title")} || '">' || {_escaped('substr(text, start::BIGINT + 1, ("end" - start)::BIGINT)')} || '</mark>', '' ORDER BY start) AS done, max("end") AS upto FROM tx GROUP BY doc_id)
SELECT doc_id, md5(coalesce(done, '') || {_escaped("substr(text, coalesce(upto, 0)::BIGINT + 1)")}) AS html FROM documents LEFT JOIN pa USING (doc_id)""")
def highlight_html(spark, d):
    return highlight.marked(_t(spark, d, "documents"), _pieces(spark, d)).select("doc_id", F.md5("html").alias("html"))


# Statistics and results


@query(f"""{_ALL.rstrip()}, fo AS (SELECT phrase, kind, CASE WHEN kind = 'regex' THEN '' ELSE lower(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT)) END AS form, count(*) AS n, list_sort(list_distinct(list(al.doc_id % 10))) AS pages FROM al JOIN documents d ON d.doc_id = al.doc_id GROUP BY ALL)
SELECT phrase, kind, sum(n)::BIGINT AS total, list_sort(list(form || ':' || n || ':' || array_to_string(pages, ','))) AS forms FROM fo GROUP BY phrase, kind""")
def search_stats(spark, d):
    # a pattern's matches are too many kinds of text to be told apart here
    found = _all(spark, d).withColumn("page", F.col("doc_id") % 10).withColumn("form", F.when(F.col("kind") != "regex", F.col("form")))
    shown = F.transform(F.map_entries("forms"), lambda x: F.concat_ws(":", x["key"], x["value"]["count"].cast("string"), F.array_join(F.transform(x["value"]["pages"], lambda p: p.cast("string")), ",")))
    return stats.search_stats(found).select("phrase", "kind", "total", F.array_sort(shown).alias("forms"))


@query(f"""{_ALL.rstrip()}, cn AS (SELECT doc_id, ord, list_key, phrase, kind, count(*) AS n FROM al GROUP BY ALL),
st AS (SELECT doc_id, sum(n)::BIGINT AS total, list({{'list_key': list_key, 'phrase': phrase, 'kind': kind, 'n': n}} ORDER BY ord) AS stats FROM cn GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'total_matches': coalesce(total, 0), 'stats': coalesce(stats, [])}}) AS VARCHAR) AS result FROM documents LEFT JOIN st USING (doc_id)""")
def result_json(spark, d):
    return stats.results(_t(spark, d, "documents"), _all(spark, d))


@query(f"""{_ALL.rstrip()}, cn AS (SELECT kind, phrase, count(*) AS n FROM al GROUP BY ALL)
SELECT CAST(to_json({{'word_stats': (SELECT list({{'phrase': phrase, 'count': n}} ORDER BY n DESC, phrase) FROM cn WHERE kind = 'word'), 'phrase_stats': (SELECT list({{'phrase': phrase, 'count': n}} ORDER BY n DESC, phrase) FROM cn WHERE kind = 'phrase')}}) AS VARCHAR) AS stats""")
def stats_json(spark, d):
    return stats.by_words_and_phrases(_all(spark, d))
