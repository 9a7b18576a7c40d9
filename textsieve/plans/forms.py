"""Queries on forms, notes, lists of tasks and ranges of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms, lists
from .catalog import _links, _sql_values, _t, query


@query("""SELECT c_custkey, (i - 1)::INTEGER AS place, text, type FROM (SELECT c_custkey, unnest(list_concat([{'text': c_mktsegment, 'type': 'full_name'}], CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [{'text': c_name, 'type': CASE c_custkey % 3 WHEN 0 THEN 'surname' ELSE 'text' END}] END)) AS x,
generate_subscripts(list_concat([1], CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [2] END), 1) AS i FROM customer), LATERAL (SELECT x.text AS text, x.type AS type)""")
def terms_from_form(spark, d):
    texts = F.array(F.concat(F.lit("  "), "c_mktsegment"), F.lit(" "), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat("c_name", F.lit(" "))), F.lit("beyond the types"))
    kinds = F.array(F.lit(" full_name"), F.lit("surname"), F.get(F.array(F.lit("surname "), F.lit("odd"), F.lit(None).cast("string")), (F.col("c_custkey") % 3).cast("int")))
    return _t(spark, d, "customer").select("c_custkey", F.posexplode(forms.terms_from_form(texts, kinds)).alias("place", "x")).select("c_custkey", "place", "x.*")


_AGENT = """CASE o_orderkey % 3 WHEN 0 THEN 'fiz' WHEN 1 THEN 'ur' END AS agent_type, nullif(o_orderkey, o_orderkey // 7 * 7) AS registry_number, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS full_name,
CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS include_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + to_days((o_orderkey % 4 - 1)::INTEGER) END AS exclude_date"""


@query(f"""SELECT o_orderkey, coalesce(agent_type, '') AS agent_type, coalesce(registry_number::VARCHAR, '') AS number, coalesce(full_name, '') AS full_name, CASE WHEN include_date IS NULL THEN '—' WHEN exclude_date IS NULL OR include_date > exclude_date THEN 'Числится' ELSE 'Снят' END AS status_label,
coalesce(strftime(include_date, '%Y-%m-%d'), '') AS date_included, coalesce(strftime(exclude_date, '%Y-%m-%d'), '') AS date_excluded, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || chr(10) || o_orderstatus ELSE '' END AS domain,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority || ':' || CASE WHEN o_orderkey % 4 = 1 THEN 'surname' ELSE 'text' END ELSE '' END AS terms FROM (SELECT *, {_AGENT} FROM orders)""")
def record_form(spark, d):
    when = lambda rule, x: F.when(F.expr(rule), x)
    records = _t(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, "fiz").when(F.col("o_orderkey") % 3 == 1, "ur").alias("agent_type"),
        when("o_orderkey % 7 > 0", F.col("o_orderkey")).alias("registry_number"),
        when("o_orderkey % 11 > 0", F.col("o_orderpriority")).alias("full_name"),
        when("o_orderkey % 5 > 0", F.to_date("o_orderdate")).alias("include_date"),
        when("o_orderkey % 2 = 0", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4 - 1).cast("int"))).alias("exclude_date"),
        when("o_orderkey % 3 > 0", F.array("o_orderpriority", "o_orderstatus")).alias("domain_name"),
        when("o_orderkey % 4 > 0", F.array(F.struct(F.col("o_orderpriority").alias("text"), when("o_orderkey % 4 = 1", F.lit("surname")).alias("type")))).alias("search_terms"),
    )
    shown = forms.agent_to_form(records, ["o_orderkey"])
    return shown.withColumn("terms", F.array_join(F.transform("search_terms", lambda x: F.concat_ws(":", x["text"], x["type"])), "|")).drop("search_terms")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ur' ELSE 'old' END AS agent_type, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey END AS registry_number, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS full_name,
CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS include_date, NULL::VARCHAR AS exclude_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '|b.ru' END AS domains, o_orderstatus || ':text' AS terms FROM orders""")
def record_from_form(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    pick = lambda n, *some: F.get(F.array(*some), (F.col("o_orderkey") % n).cast("int"))
    form = _t(spark, d, "orders").select(
        "o_orderkey",
        F.lit("old").alias("old_agent_type"),
        pick(3, F.lit("ur"), F.lit("odd"), F.lit(None).cast("string")).alias("agent_type"),
        pick(4, F.lit(""), F.concat(F.lit("-"), "o_custkey"), F.concat(F.lit(" "), "o_custkey"), F.col("o_custkey").cast("string")).alias("number"),
        F.when(F.col("o_orderkey") % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("full_name"),
        pick(3, day, F.concat(day, F.lit("T10:00:00")), F.date_format("o_orderdate", "dd.MM.yyyy")).alias("date_included"),
        pick(3, F.lit(" "), F.lit("2001-02-30"), F.lit(None).cast("string")).alias("date_excluded"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderstatus", F.lit("\n b.ru "))).otherwise("  ").alias("domain"),
        F.array(F.col("o_orderstatus"), F.lit(" ")).alias("terms_text"),
        F.array(F.lit("odd"), F.lit("text")).alias("terms_type"),
    )
    made = forms.agent_from_form(form, ["o_orderkey"], ["fiz", "ur"])
    shown = {"include_date": F.date_format("include_date", "yyyy-MM-dd"), "exclude_date": F.date_format("exclude_date", "yyyy-MM-dd"), "domains": F.array_join("domain_name", "|"), "terms": F.array_join(F.transform("search_terms", lambda x: F.concat_ws(":", x["text"], x["type"])), "|")}
    return made.withColumns(shown).drop("domain_name", "search_terms")


# persons and organisations, at home and abroad, after a form that has a field, a bad one, or none
@query("""SELECT c_custkey, type, CASE WHEN type = 'FL' AND area = 'russian' AND c_custkey % 3 < 2 THEN CASE WHEN c_custkey % 3 = 0 THEN '1999-12-31' END ELSE '1980-01-02' END AS birth_date,
CASE WHEN type = 'FL' AND area = 'russian' THEN nullif(trim(c_mktsegment), '') ELSE 'old place' END AS birth_place, CASE WHEN type = 'UL' AND area = 'russian' AND c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 3 = 1 THEN c_name END ELSE 'old region' END AS company_region
FROM (SELECT *, CASE WHEN c_custkey % 4 = 1 THEN 'UL' ELSE 'FL' END AS type, CASE WHEN c_nationkey % 2 = 0 THEN 'russian' ELSE 'international' END AS area FROM customer)""")
def listed_from_form(spark, d):
    pick = lambda n, *some: F.get(F.array(*some), (F.col("c_custkey") % n).cast("int"))
    none = F.lit(None).cast("string")
    form = _t(spark, d, "customer").select(
        "c_custkey",
        F.lit("FL").alias("old_type"),
        F.when(F.col("c_nationkey") % 2 == 0, "russian").otherwise("international").alias("area"),
        F.lit("1980-01-02").cast("date").alias("old_birth_date"),
        F.lit("old place").alias("old_birth_place"),
        F.lit("old region").alias("old_company_region"),
        pick(4, F.lit("FL"), F.lit(" UL "), F.lit("odd"), none).alias("type"),
        pick(3, F.lit(" 1999-12-31"), F.lit("31.12.1999"), none).alias("birth_date"),
        F.concat(F.lit(" "), "c_mktsegment").alias("birth_place"),
        pick(3, none, F.col("c_name"), F.lit("  ")).alias("company_region"),
    )
    return forms.listed_from_form(form, ["c_custkey"], ["FL", "UL"], "FL", "UL", "russian").withColumn("birth_date", F.date_format("birth_date", "yyyy-MM-dd"))


# Titles of lists.
_TITLES = {"inagents": "Иностранные агенты", "profanity": "Нецензурная лексика"}


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'Шаблон' WHEN event_type = 'view' THEN 'Список пользователя' WHEN event_type = 'click' THEN '{_TITLES['inagents']}' ELSE '{_TITLES['profanity']}' END AS title,
CASE WHEN event_type = 'error' THEN '«' || event_type || '»' WHEN event_type <> 'click' THEN CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END WHEN event_id % 3 = 0 THEN ''
ELSE 'Иноагент (Статус: ' || CASE WHEN event_id % 5 = 0 THEN 'Снят' ELSE 'Числится' END || ')' || chr(10) || 'Имя ' || user_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Дата рождения: None' ELSE '' END || chr(10) || chr(10) || 'Деятельность: нет' || chr(10) || 'В реестре с: ' || strftime(ts, '%Y-%m-%d') || chr(10) || chr(10) || 'Основание: ' || value::DECIMAL(10, 2) END AS content,
CASE WHEN event_type = 'error' THEN '"error"' ELSE event_type END AS shown FROM events""")
def annotation(spark, d):
    day = F.to_date("ts")
    agent = F.struct(F.when(F.col("event_id") % 2 == 0, "fiz").otherwise("ur").alias("agent_type"), F.concat(F.lit("Имя "), "user_id").alias("full_name"), F.lit(None).cast("date").alias("birth_date"), day.alias("include_date"), F.when(F.col("event_id") % 5 == 0, day).when(F.col("event_id") % 5 == 1, F.date_sub(day, 3)).alias("exclude_date"), F.col("value").cast("decimal(10, 2)").cast("string").alias("include_reason"))
    key = F.when(F.col("event_type") == "click", "inagents").when(~F.col("event_type").isin("view", "error"), "profanity")
    said = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "regex").otherwise("word").alias("kind"), F.col("event_type").alias("phrase"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise("").alias("original"), key.alias("list_key"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 > 0), agent).alias("agent"))
    return forms.annotated(said, _TITLES, "inagents", "fiz").select("event_id", "title", "content", "shown")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'COMPLETED' ELSE 'PENDING' END AS state, CASE event_id % 3 WHEN 0 THEN 'top' || user_id WHEN 1 THEN 'json' || user_id ELSE '—' END AS label,
CASE WHEN event_id % 4 = 3 THEN '—' ELSE strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') || ' МСК' END AS created, CASE WHEN event_id % 4 = 3 THEN '—' ELSE strftime(date_trunc('second', ts) + INTERVAL 27 HOUR, '%d.%m.%Y %H:%M') || ' МСК' END AS expires,
CASE WHEN event_id % 5 = 0 THEN '—' ELSE printf('%d.50 с', user_id) END AS took, CASE event_id % 3 WHEN 0 THEN event_id % 1000 || ' B' WHEN 1 THEN '7 B' ELSE '—' END AS size_label FROM events""")
def task_view(spark, d):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pick = lambda n, *some: F.get(F.array(*some), (F.col("event_id") % n).cast("int"))
    none = F.lit(None).cast("string")
    told = F.struct(
        pick(3, F.lit("unused"), F.concat(F.lit("json"), "user_id"), none).alias("source_filename"), pick(4, none, at, none, F.lit(" ")).alias("created_at"),
        F.when(F.col("event_id") % 5 == 0, F.lit("-1.5")).otherwise(F.concat("user_id", F.lit(".5"))).alias("processing_time"), pick(3, none, F.lit("7"), none).alias("source_file_size_bytes"),
    )
    fields = F.create_map(
        F.lit("state"), F.when(F.col("event_type") == "click", "PROCESSING").when(F.col("event_type") == "view", "COMPLETED").otherwise(F.col("event_type")),
        F.lit("source_filename"), pick(3, F.concat(F.lit("top"), "user_id"), none, F.lit("")),
        F.lit("created_at"), pick(4, at, none, at, F.lit("yesterday")),
        F.lit("source_file_size_bytes"), pick(3, (F.col("event_id") % 1000).cast("string"), F.lit("x"), none),
        F.lit("result_data_json"), F.to_json(told),
    )
    view = forms.task_list(_t(spark, d, "events").select(F.col("event_id").alias("task_id"), fields.alias("fields")), 24 * 3600)
    return view.select(F.col("task_id").alias("event_id"), "state", "label", "created", "expires", "took", "size_label")


# each conversation's turns as its pages
@query("""WITH p AS (SELECT conv_id, turn + 1 AS page, max(turn + 1) OVER (PARTITION BY conv_id) AS last FROM conversations), r AS (SELECT DISTINCT conv_id, conv_id % 6 AS a, conv_id % 4 + 1 AS b, last FROM p),
t AS (SELECT *, CASE WHEN a < 1 THEN 'below 1' WHEN a > b THEN 'start behind end' WHEN a > last THEN 'out of range' END AS problem FROM r)
SELECT conv_id, page, NULL AS problem FROM p JOIN t USING (conv_id) WHERE problem IS NULL AND page BETWEEN a AND least(b, t.last) UNION ALL SELECT conv_id, NULL, problem FROM t WHERE problem IS NOT NULL UNION ALL SELECT -1, NULL, 'no pages'""")
def page_range(spark, d):
    pages = _t(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"))
    ranges = pages.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 6).alias("start"), (F.col("conv_id") % 4 + 1).alias("end"))
    return forms.page_range(pages, ranges.unionByName(spark.createDataFrame([(-1, 1, 1)], ranges.schema)), "conv_id", "page")


_GONE = [("ECONOMY", "red ring"), ("PROMO", "blue bolt"), ("PROMO", "nothing")]


@query("SELECT p_type AS list, p_name AS phrase FROM part WHERE (p_type, p_name) NOT IN (SELECT (l, p) FROM " + _sql_values(_GONE, "l, p", "g") + ")")
def list_remove(spark, d):
    return lists.removed(_links(spark, d), spark.createDataFrame(_GONE, "list string, phrase string"))
