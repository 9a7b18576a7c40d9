"""Queries on tasks, files, exports and overlapping matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import lists, spans
from ..streaming import tasks as lives
from .catalog import _E, _M, _W, _found, _t, query

_KEY = "CASE WHEN event_id % 3 = 0 THEN 'job:' ELSE 'task:' END || user_id || ':' || event_type"


def _keys(spark, d):
    return _t(spark, d, "events").select("event_id", "user_id", F.expr("concat(CASE WHEN event_id % 3 = 0 THEN 'job:' ELSE 'task:' END, user_id, ':', event_type)").alias("key"))


@query(f"SELECT DISTINCT split_part(substr(k, 6), ':', 1) AS id FROM (SELECT {_KEY} AS k FROM events) WHERE starts_with(k, 'task:')")
def task_ids(spark, d):
    return lists.with_prefix_id(_keys(spark, d), "key", "task:")


@query(f"SELECT event_id, k AS key FROM (SELECT event_id, {_KEY} AS k FROM events) WHERE NOT starts_with(k, 'task:')")
def delete_by_prefix(spark, d):
    return lists.without_prefix(_keys(spark, d), "key", "task:").select("event_id", "key")


@query("SELECT event_id, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def iso_time(spark, d):
    said = F.concat(F.date_format(F.col("ts") + F.expr("interval 30 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return _t(spark, d, "events").select("event_id", F.date_format(text.iso_time(said), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT user_id, CASE WHEN bool_or(event_id % 97 = 0) THEN 'В работе' WHEN max(CASE WHEN event_id % 5 = 0 THEN ts END) IS NULL THEN 'Не проводилось' ELSE 'Выполенено' END AS status, NOT bool_or(event_id % 97 = 0) AS can_run FROM events GROUP BY user_id")
def run_status(spark, d):
    runs = _t(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_id") % 97 == 0).alias("running"), F.max(F.when(F.col("event_id") % 5 == 0, F.col("ts"))).alias("last"))
    return runs.select("user_id", text.run_status(F.col("running"), F.col("last")).alias("status"), (~F.col("running")).alias("can_run"))


@query("SELECT p_type AS list, string_agg(p_name, chr(10) ORDER BY p_name) AS content FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY 1")
def list_export(spark, d):
    return lists.export_text(_t(spark, d, "part").select(F.col("p_type").alias("list"), F.col("p_name").alias("phrase")))


@query("WITH c AS (SELECT * FROM (VALUES ('blue bolt', 'new bolt'), ('red ring', 'red anvil')) c(o, n) WHERE n NOT IN (SELECT p_name FROM part)) SELECT p_type AS list, coalesce(n, p_name) AS phrase FROM part LEFT JOIN c ON o = p_name")
def phrase_rename(spark, d):
    changes = spark.createDataFrame([("blue bolt", "new bolt"), ("red ring", "red anvil")], "old string, new string")
    return lists.renamed(_t(spark, d, "part").select(F.col("p_type").alias("list"), F.col("p_name").alias("phrase")), changes)


@query("SELECT event_id AS name, user_id AS stem FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value < 1)")
def retention_companions(spark, d):
    files = _t(spark, d, "events").select(F.col("event_id").alias("name"), F.col("user_id").alias("stem"), "value")
    return lists.with_companions(files, F.col("value") < 1).select("name", "stem")


@query("SELECT c_custkey, split_part(n, ' ', 1) AS surname, split_part(n, ' ', 2) AS first, split_part(n, ' ', 3) AS patronymic FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ivanov Ivan ' ELSE '' END || replace(c_name, ' ', '_') AS n FROM customer) WHERE c_custkey % 2 = 0")
def split_full_name(spark, d):
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, " Ivanov  Ivan ").otherwise(""), F.replace("c_name", F.lit(" "), F.lit("_")))
    return _t(spark, d, "customer").select("c_custkey", names.split_full_name(said).alias("n")).where("n is not null").select("c_custkey", "n.*")


# the greedy choice, match by match, in all groups of overlapping ones at once
@query(rf"""WITH RECURSIVE {_W}, {_E}, {_M}, f AS (SELECT DISTINCT doc_id, phrase, start_word, end_word, kind FROM m),
g AS (SELECT *, CASE WHEN start_word <= max(end_word) OVER (PARTITION BY doc_id ORDER BY start_word, end_word, phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start_word, end_word, phrase) AS cl FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cl ORDER BY CASE WHEN kind = 'phrase' THEN 0 ELSE 1 END, start_word - end_word, start_word, phrase) AS rn FROM c),
r AS (SELECT doc_id, cl, 1::BIGINT AS rn, [rn] AS kept, range(start_word, end_word + 1) AS gone FROM o WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.cl, o.rn, CASE WHEN list_has_any(gone, range(start_word, end_word + 1)) THEN kept ELSE list_append(kept, o.rn) END, CASE WHEN list_has_any(gone, range(start_word, end_word + 1)) THEN gone ELSE list_concat(gone, range(start_word, end_word + 1)) END
  FROM r JOIN o ON o.doc_id = r.doc_id AND o.cl = r.cl AND o.rn = r.rn + 1),
l AS (SELECT doc_id, cl, unnest(arg_max(kept, rn)) AS rn FROM r GROUP BY doc_id, cl)
SELECT doc_id, phrase, start_word::BIGINT AS start_word, end_word::BIGINT AS end_word, kind FROM o JOIN l USING (doc_id, cl, rn)""")
def resolve_overlaps(spark, d):
    found = _found(spark, d).select("doc_id", "phrase", "start_word", "end_word", "kind").distinct().withColumn("by_lemma", F.lit(True))
    return spans.resolve_overlaps(found).select("doc_id", "phrase", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "kind")


# a user's events are a task's, whose life ends after six hours without any
@query("""WITH e AS (SELECT user_id::VARCHAR AS task_id, ts, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS rank, event_type AS message, (event_id % 10)::DOUBLE AS step, CASE WHEN event_type = 'signup' THEN 50 + user_id END AS most FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, lag(ts) OVER (PARTITION BY task_id ORDER BY ts) AS prev FROM e)),
f AS (SELECT task_id, min(ts) AS created_at, max(ts) AS last_at, arg_max(rank, (ts, rank, message)) AS rank, arg_max(message, (ts, rank, message)) AS message, sum(step) AS progress, coalesce(arg_max(most, (ts, most)) FILTER (WHERE most IS NOT NULL), 100) AS most, count(*) AS n_events FROM s GROUP BY task_id, life)
SELECT task_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(last_at, '%Y-%m-%d %H:%M:%S.%f') AS last_at, strftime(last_at + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS expires_at, ['PENDING', 'PROCESSING', 'COMPLETED'][greatest(rank, 0) + 1] AS state, message, progress, least(round(progress / most * 100, 2), 100) AS percent, n_events FROM f""")
def task_lives(spark, d):
    state = F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "purchase", "COMPLETED")
    e = _t(spark, d, "events").select(F.col("user_id").alias("task_id"), "ts", state.alias("state"), F.col("event_type").alias("message"), (F.col("event_id") % 10).cast("double").alias("step"), F.when(F.col("event_type") == "signup", F.col("user_id") + 50).cast("double").alias("most"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    found = lives.lives(e, 6 * 3600)
    return found.select("task_id", *map(shown, ("created_at", "last_at", "expires_at")), *found.columns[4:])
