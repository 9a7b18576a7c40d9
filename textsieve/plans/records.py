"""Queries on registries, lists of terms, OCR tables and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..operators import lists
from ..sources import registry as files
from ..sources import scratch
from .catalog import _links, _sql_values, _t, query

@query(r"SELECT raw, nullif(regexp_extract(raw, '(\w+?\.\d+)', 1), '') AS code FROM (SELECT s_name || ' (' || left(s_name, 3) || '.' || s_suppkey || ')' AS raw FROM supplier)")
def sanction_code(spark, d):
    raw = F.concat("s_name", F.lit(" ("), F.substring("s_name", 1, 3), F.lit("."), "s_suppkey", F.lit(")"))
    return _t(spark, d, "supplier").select(raw.alias("raw")).select("raw", registry.sanction_code(F.col("raw")).alias("code"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS birth, 'г. Город ' || o_custkey AS place FROM orders")
def birth_details(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("ИМЯ, "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" г.р., г. Город "), "o_custkey", F.lit(";")).alias("raw"))
    return o.select("o_orderkey", F.date_format(registry.birth_date(F.col("raw")), "yyyy-MM-dd").alias("birth"), registry.birth_place(F.col("raw")).alias("place"))


@query("SELECT p_partkey, split_part(trim(p_name), ' ', 1) AS surname FROM part")
def extract_surname(spark, d):
    return _t(spark, d, "part").select("p_partkey", registry.surname_of(F.col("p_name")).alias("surname"))


@query("SELECT c_custkey, c_name AS title FROM customer")
def org_title(spark, d):
    return _t(spark, d, "customer").select("c_custkey", registry.org_title(F.concat(F.lit("Автономная организация «"), "c_name", F.lit("»"))).alias("title"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS person, c_custkey % 3 = 0 AS russian, unnest([c_name || ' ' || c_mktsegment, c_mktsegment]) AS x FROM customer)
SELECT c_custkey, x AS text, CASE WHEN person THEN 'full_name' ELSE 'text' END AS type FROM c UNION SELECT c_custkey, split_part(x, ' ', 1), 'surname' FROM c WHERE person AND russian""")
def build_terms(spark, d):
    terms = registry.search_terms(F.concat_ws(" ", "c_name", "c_mktsegment"), F.array("c_mktsegment"), F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0)
    return _t(spark, d, "customer").select("c_custkey", F.explode(terms).alias("x")).select("c_custkey", "x.text", "x.type")


def _terms(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, F.array().cast("array<string>")).when(F.col("p_partkey") % 3 == 2, F.split("p_name", " ")).alias("terms"))


@query("SELECT p_partkey, p_partkey % 3 = 2 AS has FROM part")
def has_phrases(spark, d):
    return _terms(spark, d).select("p_partkey", registry.has_terms(F.col("terms")).alias("has"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 2 AND list_contains(string_split(p_name, ' '), 'widget')")
def terms_contains(spark, d):
    return _terms(spark, d).where(F.array_contains("terms", "widget")).select("p_partkey")


@query("SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_partkey % 3 = 2 THEN string_split(p_name, ' ') ELSE [] END, ['', '', '', '', '', ''])[1:6], '|') AS slots FROM part")
def terms_slots(spark, d):
    return _terms(spark, d).select("p_partkey", F.array_join(registry.term_slots(F.col("terms")), "|").alias("slots"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 0")
def registry_filter(spark, d):
    wanted = {"c_mktsegment": "FURNITURE", "unknown": "x"}  # filters on columns that aren't there are ignored
    c = _t(spark, d, "customer").where("c_acctbal > 0")
    for name, value in wanted.items():
        c = c.where(F.col(name) == value) if name in c.columns else c
    return c.select("c_custkey")


@query("SELECT phrase, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS brand FROM (SELECT DISTINCT p_name AS phrase FROM part WHERE p_size < 20) JOIN part ON p_name = phrase GROUP BY 1")
def registry_lookup(spark, d):
    p = _t(spark, d, "part")
    first = p.groupBy(F.col("p_name").alias("phrase")).agg(F.min("p_partkey").alias("p_partkey"), F.min_by("p_brand", "p_partkey").alias("brand"))
    return first.join(p.where("p_size < 20").select(F.col("p_name").alias("phrase")), "phrase", "left_semi")


@query("""WITH o AS (SELECT c_name, nullif(c_nationkey % 4, 0) AS area, 'old' AS state FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_name, nullif(c_nationkey % 4, 0) AS area, 'new' AS state FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.area, o.area) AS area, coalesce(n.state, o.state) AS state FROM o FULL JOIN n ON o.c_name IS NOT DISTINCT FROM n.c_name AND o.area IS NOT DISTINCT FROM n.area""")
def sync_registry(spark, d):
    c = _t(spark, d, "customer").withColumn("area", F.nullif(F.col("c_nationkey") % 4, F.lit(0)))
    pick = lambda rule, state: c.where(rule).select("c_name", "area", F.lit(state).alias("state"))
    return lists.sync(pick("c_custkey % 3 <> 0", "old"), pick("c_custkey % 3 <> 1", "new"), ["c_name", "area"], ["state"])


@query(" UNION ALL ".join(f"SELECT s_name || '{a}{k}' AS raw, '{a}' AS area, '{k}' AS type, {str(on).lower()} AS is_active FROM supplier WHERE s_suppkey % 2 = {int(on)}" for a in ("international", "russian") for k in ("FL", "UL") for on in (True, False)))
def registry_raw_explode(spark, d):
    branch = lambda a, k, on: F.when(F.col("s_suppkey") % 2 == int(on), F.struct(F.concat("s_name", F.lit(a + k)).alias("raw"), F.lit(a).alias("area"), F.lit(k).alias("type"), F.lit(on).alias("is_active")))
    rows = F.array(*(branch(a, k, on) for a in ("international", "russian") for k in ("FL", "UL") for on in (True, False)))
    return _t(spark, d, "supplier").select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("x.*")


# Lists

_PALETTE = [("ECONOMY", "#ff0000"), ("PROMO", "#0000ff")]


@query("SELECT DISTINCT p_type AS list, coalesce(color, '#00ff00') AS color FROM part LEFT JOIN " + _sql_values(_PALETTE, "k, color") + " ON p_type = k")
def list_colors(spark, d):
    colors = spark.createDataFrame(_PALETTE, "list string, color string")
    return _links(spark, d).select("list").distinct().join(colors, "list", "left").select("list", F.coalesce("color", F.lit("#00ff00")).alias("color"))


@query("SELECT p_type AS list, p_name AS phrase FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND trim(p_name) <> ''")
def load_lists(spark, d):
    return _links(spark, d).where(F.col("list").isin("ECONOMY", "PROMO")).where(F.trim("phrase") != "")


@query("SELECT k AS list, count(p_name)::BIGINT AS n FROM (VALUES ('ECONOMY'), ('PROMO'), ('user')) v(k) LEFT JOIN part ON p_type = k GROUP BY 1")
def menu_counts(spark, d):
    shown = spark.createDataFrame([("ECONOMY",), ("PROMO",), ("user",)], "list string")
    counts = _links(spark, d).groupBy("list").agg(F.count("phrase").alias("n"))
    return shown.join(counts, "list", "left").select("list", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT event_id FROM events WHERE NOT (ts::DATE IN (DATE '2024-01-01', DATE '2024-01-03'))")
def log_clear(spark, d):
    days = [F.to_date(F.lit(x)) for x in ("2024-01-01", "2024-01-03")]
    return _t(spark, d, "events").where(~F.to_date("ts").isin(days)).select("event_id")


@query("SELECT c_nationkey, CAST(to_json(list_sort(list(c_name))) AS VARCHAR) AS phrases FROM customer GROUP BY 1")
def user_list(spark, d):
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list("c_name"))).alias("phrases"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, CASE WHEN c_acctbal > 0 THEN 'Числится' ELSE 'Снят' END AS status FROM customer ORDER BY c_name LIMIT 100")
def admin_grid(spark, d):
    grid = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.when(F.col("c_acctbal") > 0, "Числится").otherwise("Снят").alias("status"))
    return lists.page(grid, [F.col("name")])


# Fonts

_PUA = [("", "а"), ("", "б")]


@query("SELECT n.n_nationkey, coalesce(m.real, n.c) AS shown FROM (SELECT n_nationkey, ['" + "', '".join((_PUA[0][0], _PUA[1][0], "z")) + "'][n_nationkey % 3 + 1] AS c FROM nation) n LEFT JOIN " + _sql_values(_PUA, "c, real", "m") + " ON n.c = m.c")
def pua_map(spark, d):
    c = F.get(F.array(F.lit(_PUA[0][0]), F.lit(_PUA[1][0]), F.lit("z")), (F.col("n_nationkey") % 3).cast("int"))
    return _t(spark, d, "nation").select("n_nationkey", c.alias("c")).join(spark.createDataFrame(_PUA, "c string, real string"), "c", "left").select("n_nationkey", F.coalesce("real", "c").alias("shown"))


# Registry files

_HEADERS = {"No": "number", "Name ": "full_name", "Kind": "kind", "Balance": "balance", "Date": "day"}


# customers as files of their nations, under two lines of title and a header, read as a registry
@query("SELECT c_custkey::VARCHAR AS number, CASE WHEN c_custkey % 4 <> 0 THEN c_name || CASE WHEN c_custkey % 5 = 0 THEN '; and others' ELSE '' END END AS full_name, c_mktsegment AS kind, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal::DECIMAL(18, 2)::VARCHAR END AS balance FROM customer")
def registry_csv(spark, d):
    path = scratch.folder(spark, "registry")
    c = _t(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('; and others"'))).otherwise(F.concat(F.lit(" "), "c_name"))
    line = F.concat_ws(";", "c_custkey", name, F.lit("left out"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(";"), F.col("c_acctbal").cast("decimal(18, 2)")))))
    titles = F.explode(F.array(*(F.struct(F.lit(i - 3).cast("long").alias("at"), F.lit(t).alias("value")) for i, t in enumerate(("Registry", "", " No;Name;Other;Kind ;Balance;;")))))
    heads = c.select("c_nationkey").distinct().select("c_nationkey", titles.alias("x")).select("c_nationkey", "x.at", "x.value")
    rows = heads.unionByName(c.select("c_nationkey", F.col("c_custkey").alias("at"), line.alias("value")))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "at").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return files.read_csv(spark, path, _HEADERS).drop("path")


# a catalog for each nation, of its suppliers and customers
@query("""SELECT n AS nation, raw, area, type, is_active FROM (SELECT s_nationkey AS n, s_name AS raw, CASE WHEN s_suppkey % 3 = 0 THEN 'russian' ELSE 'international' END AS area, 'UL' AS type, s_acctbal > 0 AS is_active FROM supplier
UNION ALL SELECT c_nationkey, c_name || ', "' || c_mktsegment || '"', CASE WHEN c_custkey % 3 = 0 THEN 'russian' ELSE 'international' END, 'FL', c_acctbal > 0 FROM customer)""")
def catalog_explode(spark, d):
    side = lambda t, n, key, name, bal, kind: _t(spark, d, t).select(F.col(n).alias("nation"), F.concat(key, F.lit(". "), name).alias("raw"), F.when(F.col(key) % 3 == 0, "russian").otherwise("international").alias("area"), F.when(F.col(bal) > 0, "all").otherwise("excluded").alias("state"), F.lit(kind).alias("kind"))
    names = side("supplier", "s_nationkey", "s_suppkey", "s_name", "s_acctbal", "UL").unionByName(side("customer", "c_nationkey", "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')), "c_acctbal", "FL"))
    listed = lambda area, state, kind: F.collect_list(F.when((F.col("area") == area) & (F.col("state") == state) & (F.col("kind") == kind), F.col("raw"))).alias(f"names{kind}")
    parts = names.groupBy("nation").agg(*(listed(a, s, k).alias(f"{a}_{s}_{k}") for a in ("international", "russian") for s in ("all", "excluded") for k in ("FL", "UL")))
    tree = F.struct(*(F.struct(*(F.struct(*(F.col(f"{a}_{s}_{k}").alias(f"names{k}") for k in ("FL", "UL"))).alias(s) for s in ("all", "excluded"))).alias(a) for a in ("international", "russian")))
    return parts.select("nation", F.to_json(tree).alias("json")).select("nation", F.explode(registry.catalog_rows(F.col("json"))).alias("x")).select("nation", "x.*")


_STEMS = [("widget", "thing", "widg"), ("ring", "thing", "ring"), ("red", "color", "re"), ("blue", "color", "blu"), ("small", "", "smal")]


@query(f"""WITH l AS (SELECT * FROM {_sql_values(_STEMS, "word, lemma, stem", "s")}), t AS (SELECT p_partkey AS o, trim(p_name) AS term FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) = 1),
w AS (SELECT o, term, unnest(regexp_extract_all(lower(term), '[a-zA-Zа-яёА-ЯЁ]+(?:-[a-zA-Zа-яёА-ЯЁ]+)*')) AS word, generate_subscripts(regexp_extract_all(lower(term), '[a-zA-Zа-яёА-ЯЁ]+(?:-[a-zA-Zа-яёА-ЯЁ]+)*'), 1) AS i FROM t),
m AS (SELECT o, term, list(coalesce(nullif(lemma, ''), word) ORDER BY i) AS le, list(coalesce(nullif(stem, ''), word) ORDER BY i) AS st FROM w LEFT JOIN l USING (word) GROUP BY o, term),
k AS (SELECT o, term, CASE WHEN len(le) > 1 THEN 'phrase' ELSE 'word' END AS kind, unnest(['lemma', 'lemma', 'stem', 'stem']) AS "by", unnest([false, true, false, true]) AS sorted, unnest([le, list_sort(le), st, list_sort(st)]) AS ks FROM m)
SELECT kind, "by", sorted, array_to_string(ks, ' ')[1:3] AS bucket, array_to_string(ks, ' ') AS key, arg_min(term, o) AS info, count(*) AS n FROM k WHERE kind = 'phrase' OR NOT sorted GROUP BY kind, "by", sorted, ks""")
def term_index(spark, d):
    return lists.term_index(_t(spark, d, "part").withColumnRenamed("p_name", "term"), spark.createDataFrame(_STEMS, "word string, lemma string, stem string"), F.col("p_partkey"))
