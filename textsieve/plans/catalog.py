"""The library's queries over the driver's tables, by name, and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, registry, text
from ..operators import automaton, lists, match, spans, stats

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PHRASES = [("of the", "common"), ("in the and", "common"), ("the", "single"), ("de la", "romance"), ("die der", "german"), ("!!!", "blank")]
_P = "(VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in PHRASES) + ") p0(phrase, list_key)"
#: Words of each document, and the phrases with their words.
_W = rf"w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), p AS (SELECT phrase, list_key, pw, len(pw) AS k FROM (SELECT phrase, list_key, regexp_extract_all(lower(phrase), '[\p{{L}}\p{{N}}_]+') AS pw FROM {_P}) WHERE len(pw) > 0)"
_E = "e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)"
_M = "m AS (SELECT doc_id, phrase, list_key, i - 1 AS start_word, i + k - 2 AS end_word, CASE WHEN k > 1 THEN 'phrase' ELSE 'word' END AS kind, doc_id % 10 AS page FROM e JOIN p ON e.w[e.i] = p.pw[1] AND e.w[e.i:e.i + p.k - 1] = p.pw)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _phrases(spark: SparkSession) -> DataFrame:
    return match.small(spark, PHRASES, "phrase string, list_key string")


def _long(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]



def _sql_values(rows: list[tuple], columns: str, name: str = "v") -> str:
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") {name}({columns})"


# Texts


@query("SELECT doc_id, trim(lower(translate(text, 'Ёё', 'Ее')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm FROM documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+') AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS i FROM t)
SELECT doc_id, i::BIGINT AS token_idx, lower(raw) AS token, (sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw))::BIGINT AS start_pos,
CASE WHEN regexp_matches(raw, '^[\p{L}\p{N}_]') THEN 'word' WHEN regexp_matches(raw, '^\s') THEN 'space' ELSE 'punct' END AS type FROM e""")
def tokenize(spark, d):
    return automaton.token_rows(_t(spark, d, "documents"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n FROM documents")
def word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no, line FROM (SELECT doc_id, trim(x, ' ' || chr(9) || chr(13)) AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> ''")
def doc_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS words FROM documents")
def doc_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(text.words(F.col("text")), " ").alias("words"))


@query("SELECT item_id, trim(x) AS line FROM (SELECT item_id, unnest(string_split(replace(text, ',', chr(10)), chr(10))) AS x FROM benchmark) WHERE trim(x) <> ''")
def text_input_lines(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.explode(text.lines(F.replace("text", F.lit(","), F.lit("\n")))).alias("line"))


@query("SELECT doc_id, replace(replace(text, '-' || chr(10), ''), chr(173) || chr(10), '') AS joined FROM documents")
def dehyphenate(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.dehyphenate(F.col("text")).alias("joined"))


@query(rf"WITH {_W}, {_E} SELECT array_to_string(w[i:i + 2], ' ') AS gram, count(*)::BIGINT AS n FROM e WHERE i + 2 <= len(w) GROUP BY 1 HAVING count(*) > 1")
def ngrams(spark, d):
    words = _t(spark, d, "documents").select(text.words(F.col("text")).alias("w"))
    grams = words.select(F.explode(text.neighbours(F.col("w"), 3)).alias("x")).select(F.concat_ws(" ", "x.w0", "x.w1", "x.w2").alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# A few stop words.
_STOP = ["the", "of", "and", "to", "in", "is", "die", "der", "und", "le", "la", "les", "de", "el", "los"]


@query(rf"WITH {_W} SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(w) AS word FROM w) WHERE word NOT IN ({', '.join(repr(x) for x in _STOP)}) GROUP BY word")
def stop_words(spark, d):
    return _t(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).where(~F.col("word").isin(_STOP)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS label FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)")
def file_size_label(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.file_size_label(F.col("n_chars") * 37).alias("label"))


@query("SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') || ' МСК' AS label FROM events")
def msk_time(spark, d):
    return _t(spark, d, "events").select("event_id", text.msk_time(F.col("ts")).alias("label"))


# Matches


@query(f"WITH {_W}, {_E}, {_M} SELECT doc_id, phrase, start_word::BIGINT AS start_word, end_word::BIGINT AS end_word, kind FROM m")
def phrase_match(spark, d):
    return match.phrase_match(_t(spark, d, "documents"), _phrases(spark)).select("doc_id", "phrase", *_long("start_word", "end_word"), "kind")


@query(f"WITH {_W}, {_E} SELECT doc_id, phrase, (i - 1)::BIGINT AS start_word, (i + k - 2)::BIGINT AS end_word FROM e JOIN p ON i + k - 1 <= len(w) AND list_sort(w[i:i + k - 1]) = list_sort(pw)")
def unordered_phrase_match(spark, d):
    return match.unordered_match(_t(spark, d, "documents"), _phrases(spark)).select("doc_id", "phrase", *_long("start_word", "end_word"))


# words, lemmas and stems: equal by both or not at all
_LEMMAS = [("the", "the", "th"), ("this", "the", "thi"), ("die", "die", "d"), ("der", "die", "d"), ("den", "die", "d"), ("la", "le", "l"), ("les", "le", "l"), ("of", "of", "of"), ("off", "of", "off"), ("in", "", "i"), ("im", "", "i")]
#: The word that stands for all that are equal to it.
_KEYS = "MAP {" + ", ".join(f"'{w}': '{lemma}|{stem}'" for w, lemma, stem in _LEMMAS if lemma) + "}"
_LK = rf"wk AS (SELECT doc_id, list_transform(w, lambda x: coalesce(list_extract(map_extract({_KEYS}, x), 1), x)) AS w FROM w), pk AS (SELECT phrase, list_key, k, list_transform(pw, lambda x: coalesce(list_extract(map_extract({_KEYS}, x), 1), x)) AS pw FROM p), ek AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM wk)"


def _lexicon(spark: SparkSession) -> DataFrame:
    return match.small(spark, _LEMMAS, "word string, lemma string, stem string")


@query(f"WITH {_W}, {_LK} SELECT doc_id, phrase, (i - 1)::BIGINT AS start_word, (i + k - 2)::BIGINT AS end_word FROM ek JOIN pk ON ek.w[ek.i] = pk.pw[1] AND ek.w[ek.i:ek.i + k - 1] = pk.pw")
def phrase_match_lemma(spark, d):
    return match.phrase_match(_t(spark, d, "documents"), _phrases(spark), lexicon=_lexicon(spark)).select("doc_id", "phrase", *_long("start_word", "end_word"))


@query(f"WITH {_W}, {_LK} SELECT doc_id, phrase, (i - 1)::BIGINT AS start_word, (i + k - 2)::BIGINT AS end_word FROM ek JOIN pk ON i + k - 1 <= len(w) AND list_sort(w[i:i + k - 1]) = list_sort(pw)")
def unordered_match_lemma(spark, d):
    return match.unordered_match(_t(spark, d, "documents"), _phrases(spark), lexicon=_lexicon(spark)).select("doc_id", "phrase", *_long("start_word", "end_word"))


@query(f"WITH {_W}, {_E}, {_M} SELECT doc_id, phrase, count(*)::BIGINT AS n FROM m WHERE kind = 'word' GROUP BY ALL")
def word_match(spark, d):
    return match.phrase_match(_t(spark, d, "documents"), _phrases(spark)).where("kind = 'word'").groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_W} SELECT doc_id, phrase FROM w JOIN p ON list_has_all(w, pw)")
def phrase_prefilter(spark, d):
    return match.prefilter(_t(spark, d, "documents"), _phrases(spark))


# Patterns with ASCII borders.
_PATTERNS = {"email": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "long_number": r"\d{13,16}"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern_name, len(regexp_extract_all(lower(text), '{p}'))::BIGINT AS n FROM documents WHERE regexp_matches(lower(text), '{p}')" for k, p in _PATTERNS.items()))
def regex_count(spark, d):
    return match.regex_counts(_t(spark, d, "documents"), _PATTERNS)


@query(f"WITH {_W}, {_E} SELECT DISTINCT doc_id, (i - 1)::BIGINT AS i, phrase_id FROM e JOIN (SELECT pw[1] AS t, row_number() OVER (ORDER BY phrase)::BIGINT AS phrase_id FROM p) ON w[i] = t")
def candidate_probe(spark, d):
    words = _t(spark, d, "documents").select("doc_id", F.posexplode(text.words(F.col("text"))).alias("i", "text")).select("doc_id", F.col("i").cast("long").alias("i"), "text", F.col("text").alias("lemma"), F.col("text").alias("stem"))
    first = _phrases(spark).withColumn("w", text.words(F.col("phrase"))).where(F.size("w") > 0)
    first = first.select(F.row_number().over(Window.orderBy("phrase")).cast("long").alias("phrase_id"), F.col("w")[0].alias("text"))  # a handful of phrases
    return match.probe(words, first.select("phrase_id", "text", F.col("text").alias("lemma"), F.col("text").alias("stem")))


# Statistics


def _found(spark, d):
    m = match.phrase_match(_t(spark, d, "documents"), _phrases(spark))
    return m.withColumn("page", F.col("doc_id") % 10).withColumn("form", F.col("matched"))


@query(f"WITH {_W}, {_E}, {_M} SELECT list_key, kind, phrase, count(DISTINCT (doc_id, start_word, end_word))::BIGINT AS n, list_sort(list_distinct(list(page))) AS pages FROM m GROUP BY ALL")
def stats_matches(spark, d):
    return stats.by_list(_found(spark, d))


@query(f"WITH {_W}, {_E}, {_M} SELECT list_key, kind, count(*)::BIGINT AS total FROM m GROUP BY ALL")
def stats_totals(spark, d):
    return stats.totals(stats.by_list(_found(spark, d)))


@query(f"WITH {_W}, {_E}, {_M} SELECT phrase, kind, phrase AS form, count(*)::BIGINT AS n, list_sort(list_distinct(list(page))) AS pages FROM m GROUP BY ALL")
def stats_search(spark, d):
    return stats.by_form(_found(spark, d))


@query(f"WITH {_W}, {_E}, {_M} SELECT count(*)::BIGINT AS total_matches FROM m")
def total_matches(spark, d):
    return _found(spark, d).agg(F.count(F.lit(1)).alias("total_matches"))


# Pages and spans


@query("SELECT conv_id, turn, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::BIGINT AS \"offset\" FROM conversations")
def page_offsets(spark, d):
    return spans.page_offsets(_t(spark, d, "conversations"), "conv_id", "turn", F.char_length("text")).select("conv_id", "turn", "offset")


_SPANS = "s AS (SELECT conv_id, turn, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::BIGINT AS p0, length(text) AS n FROM conversations), b AS (SELECT conv_id, turn, p0 AS b_start, p0 + n - 1 AS b_end FROM s), a AS (SELECT conv_id, turn * 90 AS a_start, turn * 90 + 400 AS a_end FROM conversations)"


def _spans(spark, d):
    c = _t(spark, d, "conversations")
    b = spans.page_offsets(c, "conv_id", "turn", F.char_length("text")).select("conv_id", "turn", F.col("offset").alias("b_start"), (F.col("offset") + F.char_length("text") - 1).alias("b_end"))
    return c.select("conv_id", (F.col("turn") * 90).alias("a_start"), (F.col("turn") * 90 + 400).alias("a_end")), b


@query(f"WITH {_SPANS} SELECT conv_id, turn, a_start, a_end, greatest(a_start, b_start) - b_start AS local_start, least(a_end, b_end) - b_start AS local_end FROM a JOIN b USING (conv_id) WHERE a_start <= b_end AND b_start <= a_end")
def span_page_overlap(spark, d):
    a, b = _spans(spark, d)
    return spans.overlapping(a, b, "conv_id").select("conv_id", "turn", "a_start", "a_end", (F.greatest("a_start", "b_start") - F.col("b_start")).alias("local_start"), (F.least("a_end", "b_end") - F.col("b_start")).alias("local_end"))


@query(f"WITH {_SPANS} SELECT conv_id, a_start, turn AS page FROM a JOIN b USING (conv_id) WHERE a_start BETWEEN b_start AND b_end")
def match_page(spark, d):
    a, b = _spans(spark, d)
    point = a.select("conv_id", "a_start", F.col("a_start").alias("a_end"))
    return spans.overlapping(point, b, "conv_id").select("conv_id", "a_start", F.col("turn").alias("page"))


@query("""WITH s AS (SELECT user_id, event_id AS span_id, event_id % 500 AS start_pos, event_id % 500 + event_id % 7 AS end_pos FROM events),
n AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY user_id ORDER BY start_pos, end_pos, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s)
SELECT user_id, span_id, (sum(new) OVER (PARTITION BY user_id ORDER BY start_pos, end_pos, span_id) - 1)::BIGINT AS cluster FROM n""")
def overlap_clusters(spark, d):
    s = _t(spark, d, "events").select("user_id", F.col("event_id").alias("span_id"), (F.col("event_id") % 500).alias("start_pos"), (F.col("event_id") % 500 + F.col("event_id") % 7).alias("end_pos"))
    return spans.clusters(s, "user_id").select("user_id", "span_id", "cluster")


@query("SELECT event_id % 100 AS s, event_id % 100 + 5 AS e, count(*)::BIGINT AS n, list_sort(list(event_id)) AS ids FROM events GROUP BY ALL")
def span_groups(spark, d):
    return _t(spark, d, "events").groupBy((F.col("event_id") % 100).alias("s"), (F.col("event_id") % 100 + 5).alias("e")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))


# Lists


def _links(spark, d):
    return _t(spark, d, "part").select(F.col("p_type").alias("list"), F.col("p_name").alias("phrase"))


@query("SELECT DISTINCT p_type AS list, p_name AS phrase FROM part")
def list_phrases(spark, d):
    return _links(spark, d).distinct()


@query("SELECT p_type AS list, count(*)::BIGINT AS n FROM part GROUP BY 1")
def list_counts(spark, d):
    return _links(spark, d).groupBy("list").agg(F.count(F.lit(1)).alias("n"))


_HALVES = ("length(p_name) % 3 <> 0", "length(p_name) % 3 <> 1")


@query(f"(SELECT 'added' AS change, phrase FROM (SELECT p_name AS phrase FROM part WHERE {_HALVES[1]} EXCEPT SELECT p_name FROM part WHERE {_HALVES[0]})) UNION ALL (SELECT 'deleted', phrase FROM (SELECT p_name AS phrase FROM part WHERE {_HALVES[0]} EXCEPT SELECT p_name FROM part WHERE {_HALVES[1]}))")
def list_diff(spark, d):
    p = _t(spark, d, "part")
    old, new = (p.where(h).select(F.col("p_name").alias("phrase")) for h in _HALVES)
    return lists.diff(old, new)


@query(f"SELECT DISTINCT p_name AS phrase FROM part WHERE {_HALVES[1]} AND p_name NOT IN (SELECT p_name FROM part WHERE {_HALVES[0]})")
def list_import(spark, d):
    p = _t(spark, d, "part")
    return p.where(_HALVES[1]).join(p.where(_HALVES[0]).select("p_name"), "p_name", "left_anti").select(F.col("p_name").alias("phrase")).distinct()


@query(f"SELECT DISTINCT p_name AS phrase FROM part WHERE {_HALVES[0]} AND p_name NOT IN (SELECT p_name FROM part WHERE {_HALVES[1]})")
def list_minus(spark, d):
    p = _t(spark, d, "part")
    return p.where(_HALVES[0]).join(p.where(_HALVES[1]).select("p_name"), "p_name", "left_anti").select(F.col("p_name").alias("phrase")).distinct()


@query(f"SELECT DISTINCT lower(p_name) AS phrase FROM part WHERE {_HALVES[0]} UNION SELECT lower(p_type) FROM part")
def union_terms(spark, d):
    p = _t(spark, d, "part")
    return p.where(_HALVES[0]).select(F.lower("p_name").alias("phrase")).unionByName(p.select(F.lower("p_type").alias("phrase"))).distinct()


@query("SELECT lower(p_type) AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedup_first(spark, d):
    return lists.one_each(_t(spark, d, "part").select(F.lower("p_type").alias("key"), "p_partkey"), F.col("key"), F.col("p_partkey"))


@query("SELECT lower(p_type) AS key, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedup_last(spark, d):
    return lists.one_each(_t(spark, d, "part").select(F.lower("p_type").alias("key"), "p_partkey"), F.col("key"), F.desc("p_partkey"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 20")
def paginate(spark, d):
    return lists.page(_t(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 50, 20)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old') AND contains(lower(p_name), 'b')")
def list_search(spark, d):
    return lists.search(_t(spark, d, "part"), "p_name", "OLD b").select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%77%' OR c_custkey = 77")
def registry_search(spark, d):
    return _t(spark, d, "customer").where(F.col("c_name").ilike("%77%") | (F.col("c_custkey") == F.expr("try_cast('77' as bigint)"))).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_nationkey NULLS FIRST, c_custkey LIMIT 100")
def registry_page(spark, d):
    return lists.page(_t(spark, d, "customer"), [F.asc_nulls_first("c_nationkey"), F.col("c_custkey")]).select("c_custkey", "c_name")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, list_sort(list(event_id)) AS ids FROM events GROUP BY ALL")
def changes_by_date(spark, d):
    return _t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention(spark, d):
    e = _t(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.col("ts") >= F.col("now") - F.expr("interval 3 days")).select("event_id")


@query("SELECT user_id, least(round(100.0 * sum(value) / nullif(sum(value + 10), 0), 2), 100) AS percent FROM events GROUP BY 1")
def progress(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.least(F.round(100.0 * F.sum("value") / F.nullif(F.sum(F.col("value") + 10), F.lit(0)), 2), F.lit(100.0)).alias("percent"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def task_state(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


# Registries and names

_SOUGHT = [("of", "m"), ("Der", "f"), ("Толстой", "m")]


@query("SELECT doc_id, surname, gender, matched_case, count(*)::BIGINT AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[А-Яа-яЁёA-Za-z]+(?:-[А-Яа-яЁёA-Za-z]+)?'))) AS w FROM documents) JOIN " + _sql_values(_SOUGHT, "surname, gender", "v") + " ON w = lower(surname), (VALUES ('nom'), ('gen'), ('dat'), ('acc'), ('ins'), ('pre')) c(matched_case) GROUP BY ALL")
def surname_index_find(spark, d):
    index = names.surname_index(spark.createDataFrame(_SOUGHT, "surname string, gender string"))
    return match.surnames_found(_t(spark, d, "documents"), index).groupBy("doc_id", "surname", "gender", "matched_case").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN a IS NULL THEN '—' WHEN b IS NULL OR a > b THEN 'Числится' ELSE 'Снят' END AS label FROM (SELECT o_orderkey, nullif(o_orderkey % 5, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM orders)")
def status_label(spark, d):
    v = _t(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("a"), F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("b"))
    return v.select("o_orderkey", registry.status_label(F.col("a"), F.col("b")).alias("label"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderkey % 5, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM orders) WHERE a IS NOT NULL AND (b IS NULL OR a > b)")
def active_filter(spark, d):
    v = _t(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("a"), F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("b"))
    return v.where("a is not null and (b is null or a > b)").select("o_orderkey")


@query("WITH o AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_custkey % 3 <> 1) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_registry(spark, d):
    c = _t(spark, d, "customer")
    return lists.upsert(c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name"), c.where("c_custkey % 3 <> 1").select("c_custkey", F.upper("c_name").alias("c_name")), "c_custkey", ["c_name"])


from . import derived, forms, matching, paging, records, search, tasks  # noqa: E402, F401  (they add their queries)
