"""Queries on tokens, forms and kinds of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lists, match, spans, stats
from .catalog import _E, _KEYS, _M, _W, _found, _lexicon, _long, _phrases, _sql_values, _t, query

#: Tokens of each document with their places.
_T = r"""a AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+') AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS i FROM a),
t AS (SELECT doc_id, i, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS s FROM u)"""


@query("SELECT doc_id, coalesce(regexp_matches(text, '[а-яА-ЯёЁ]'), false) AS cyrillic FROM documents")
def is_cyrillic(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.coalesce(text.is_cyrillic(F.col("text")), F.lit(False)).alias("cyrillic"))


@query(r"SELECT phrase FROM (SELECT p_name AS phrase FROM part UNION ALL SELECT p_brand FROM part) WHERE regexp_matches(phrase, '^[a-zA-Zа-яА-ЯёЁ\s\-]+$')")
def letters_only(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_name").alias("phrase")).unionAll(p.select("p_brand")).where(text.letters_only(F.col("phrase")))


@query(rf"WITH {_W} SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE x = 'the' GROUP BY 1")
def exact_run(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("x")).where("x = 'the'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+-[\p{L}\p{N}_]+')) AS pair FROM documents")
def double_surname(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(text.hyphen_pairs(F.col("text"))).alias("pair"))


@query(rf"WITH {_T}, q AS (SELECT doc_id, doc_id % length(text) AS pos FROM documents WHERE length(text) > 0) SELECT doc_id, pos::BIGINT AS pos, i::BIGINT AS token_idx FROM q JOIN t USING (doc_id) WHERE s <= pos AND pos < s + length(raw)")
def pos_to_token(spark, d):
    q = _t(spark, d, "documents").where(F.char_length("text") > 0).withColumn("pos", F.col("doc_id") % F.char_length("text"))
    return q.select("doc_id", "pos", text.token_of(F.col("text"), F.col("pos")).cast("long").alias("token_idx"))


@query(f"WITH {_W}, {_E}, {_M}, {_T}, n AS (SELECT doc_id, i, raw, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM t WHERE regexp_matches(raw, '^[\\p{{L}}\\p{{N}}_]')) SELECT m.doc_id, phrase, start_word::BIGINT AS start_word, lower(substr(text, (x.s + 1)::BIGINT, (y.s + length(y.raw) - x.s)::BIGINT)) AS form FROM m JOIN n x ON m.doc_id = x.doc_id AND start_word = x.j JOIN n y ON m.doc_id = y.doc_id AND end_word = y.j JOIN documents d ON d.doc_id = m.doc_id WHERE kind = 'phrase'")
def match_form(spark, d):
    return match.phrase_match(_t(spark, d, "documents"), _phrases(spark)).where("kind = 'phrase'").select("doc_id", "phrase", *_long("start_word"), "form")


@query(rf"SELECT name, CASE WHEN r THEN 'regex' WHEN len(regexp_extract_all(name, '[\p{{L}}\p{{N}}_]+')) > 1 THEN 'phrase' ELSE 'word' END AS kind FROM (SELECT p_name AS name, p_partkey % 7 = 0 AS r FROM part UNION ALL SELECT c_mktsegment, false FROM customer)")
def match_kind(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") % 7 == 0).alias("r")).unionAll(_t(spark, d, "customer").select("c_mktsegment", F.lit(False)))
    return rows.select("name", text.match_kind(text.words(F.col("name")), F.col("r")).alias("kind"))


@query(f"WITH {_W}, {_E}, {_M} SELECT doc_id, to_json({{'phrase': phrase, 'start': start_word::BIGINT, 'end': end_word::BIGINT, 'kind': kind}}) AS json FROM m".replace("to_json(", "CAST(to_json(").replace(") AS json", ") AS VARCHAR) AS json"))
def match_json(spark, d):
    row = F.struct("phrase", F.col("start_word").cast("long").alias("start"), F.col("end_word").cast("long").alias("end"), "kind")
    return _found(spark, d).select("doc_id", F.to_json(row).alias("json"))


@query(f"WITH {_W}, {_E}, {_M} SELECT list_key, count(*) FILTER (WHERE kind = 'word')::BIGINT AS words, count(*) FILTER (WHERE kind = 'phrase')::BIGINT AS phrases FROM m GROUP BY 1")
def stats_by_kind(spark, d):
    count = lambda k: F.count_if(F.col("kind") == k)
    return _found(spark, d).groupBy("list_key").agg(count("word").alias("words"), count("phrase").alias("phrases"))


@query(
    f"WITH {_W}, lk AS (SELECT doc_id, w AS raw, list_transform(w, lambda x: coalesce(list_extract(map_extract({_KEYS}, x), 1), x)) AS w FROM w),"
    f" lp AS (SELECT phrase, k, list_transform(pw, lambda x: coalesce(list_extract(map_extract({_KEYS}, x), 1), x)) AS pw FROM p), le AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM lk),"
    " x AS (SELECT CASE WHEN k > 1 THEN 'phrase' ELSE 'word' END AS kind, CASE WHEN k > 1 THEN phrase ELSE split_part(pw[1], '|', 1) END AS key, array_to_string(raw[i:i + k - 1], ' ') AS form FROM le JOIN lp ON w[i] = pw[1] AND w[i:i + k - 1] = pw)"
    " SELECT kind, key, sum(n)::BIGINT AS total, list_sort(list(form || ':' || n)) AS forms FROM (SELECT kind, key, form, count(*) AS n FROM x GROUP BY ALL) GROUP BY kind, key"
)
def footnote_stats(spark, d):
    found = match.phrase_match(_t(spark, d, "documents"), _phrases(spark), lexicon=_lexicon(spark))
    return stats.footnotes(found, _lexicon(spark))


_NAMES = [("in the and", "in the and"), ("in the and", "in the the"), ("of the the", "the of the")]


@query(f"WITH {_W}, {_E} SELECT doc_id, name, form, (i - 1)::BIGINT AS start_word FROM e JOIN {_sql_values(_NAMES, 'name, form')} ON array_to_string(w[i:i + 2], ' ') = form WHERE left(form, 3) = left(name, 3)")
def full_name_match(spark, d):
    return match.full_name_match(_t(spark, d, "documents"), spark.createDataFrame(_NAMES, "name string, form string")).select("doc_id", "name", "form", *_long("start_word"))


_LEXICON = [("dies", "die"), ("ands", "and"), ("das", "der"), ("die", "der"), ("les", "le")]


@query(f"WITH {_W} SELECT lemma, count(*)::BIGINT AS n FROM (SELECT coalesce(l.lemma, x) AS lemma FROM (SELECT unnest(w) AS x FROM w) LEFT JOIN {_sql_values(_LEXICON, 'word, lemma', 'l')} ON x = l.word) GROUP BY 1")
def lemma_lookup(spark, d):
    counts = _t(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return match.lemmas(counts, spark.createDataFrame(_LEXICON, "word string, lemma string")).groupBy("lemma").agg(F.sum("n").cast("long").alias("n"))


@query("""WITH t AS (SELECT p_partkey, trim(p_name) AS term, lower(trim(p_name)) AS k FROM part), o AS (SELECT term FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey) = 1)
SELECT term, CASE WHEN len(w) > 1 THEN 'phrase' ELSE 'word' END AS kind, array_to_string(list_sort(w), ' ') AS key FROM (SELECT term, regexp_extract_all(lower(term), '[\\p{L}\\p{N}_]+') AS w FROM o)""".replace("\\\\", "\\"))
def prepare_terms(spark, d):
    return lists.prepared_terms(_t(spark, d, "part").withColumnRenamed("p_name", "term"), text.words(F.col("term")), F.col("p_partkey"))


@query("SELECT array_to_string(list_sort(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')), ' ') AS key, arg_min(p_name, p_partkey) AS info, count(DISTINCT p_name)::BIGINT AS terms FROM part GROUP BY 1")
def term_maps(spark, d):
    p = _t(spark, d, "part").withColumn("key", F.array_join(F.array_sort(text.words(F.col("p_name"))), " "))
    return p.groupBy("key").agg(F.min_by("p_name", "p_partkey").alias("info"), F.count_distinct("p_name").alias("terms"))


@query("""WITH c AS (SELECT p_partkey, p_size % 9 AS s, p_size % 9 + 6 AS e, p_partkey % 5 + 3 AS a, p_partkey % 11 + 1 AS b FROM part),
k AS (SELECT p_partkey, s AS x FROM c UNION SELECT p_partkey, e FROM c UNION SELECT p_partkey, a FROM c WHERE a > s AND a < e UNION SELECT p_partkey, b FROM c WHERE b > s AND b < e)
SELECT p_partkey, part_start::BIGINT AS part_start, part_end::BIGINT AS part_end FROM (SELECT p_partkey, x AS part_start, lead(x) OVER (PARTITION BY p_partkey ORDER BY x) AS part_end FROM k) WHERE part_end IS NOT NULL""")
def wrap_split(spark, d):
    s = _t(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).cast("long").alias("s"), (F.col("p_size") % 9 + 6).cast("long").alias("e"), F.array(F.col("p_partkey") % 5 + 3, F.col("p_partkey") % 11 + 1).alias("at"))
    return spans.split_at(s, F.col("s"), F.col("e"), F.col("at")).select("p_partkey", "part_start", "part_end")


@query("SELECT l_orderkey AS page, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1")
def bounding_rect(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("SELECT user_id, event_id FROM events QUALIFY event_type <> 'error' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def multi_annotation(spark, d):
    e = _t(spark, d, "events")
    errors = lists.one_each(e.where("event_type = 'error'"), F.col("user_id"), F.struct("ts", "event_id"))
    return e.where("event_type is distinct from 'error'").unionByName(errors).select("user_id", "event_id")
