"""Queries over values that whole tables give: names, entries, dates and boxes made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, registry, text
from ..operators import lists, match, ocr, spans
from .catalog import _KEYS, _W, _lexicon, _sql_values, _t, query

#: Letters for letters: the texts' invented words become words of Russian letters.
_LATIN, _RUSSIAN = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопщрстувшчыз"
_CY = f"translate(lower(text), '{_LATIN}', '{_RUSSIAN}')"


def _russian(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), _LATIN, _RUSSIAN).alias("text"))


# Words


@query(r"""SELECT word, nullif(regexp_extract(lower(word), '[a-zA-Zа-яёА-ЯЁ]+(?:-[a-zA-Zа-яёА-ЯЁ]+)*'), '') AS clean, regexp_matches(word, '[а-яА-ЯёЁ]') AS cyrillic, regexp_matches(word, '^[a-zA-Zа-яА-ЯёЁ\s\-]+$') AS letters
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents UNION SELECT unnest(string_split(""" + _CY + ", ' ')) FROM documents)")
def clean_word(spark, d):
    pieces = _t(spark, d, "documents").select("text").unionByName(_russian(spark, d).select("text")).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return pieces.select("word", text.clean_word(F.col("word")).alias("clean"), text.is_cyrillic(F.col("word")).alias("cyrillic"), text.letters_only(F.col("word")).alias("letters"))


# pairs of neighbouring words, with what the lexicon says of each
@query(rf"""WITH {_W}, e AS (SELECT w, unnest(range(1, len(w))) AS i FROM w), q AS (SELECT DISTINCT w[i] AS x, w[i + 1] AS y FROM e),
k AS (SELECT x, y, list_extract(map_extract({_KEYS}, x), 1) AS a, list_extract(map_extract({_KEYS}, y), 1) AS b FROM q)
SELECT x, y, x = y OR coalesce(a = b, false) AS equal, x = y OR split_part(a, '|', 1) IS NOT DISTINCT FROM split_part(b, '|', 1) OR split_part(a, '|', 2) IS NOT DISTINCT FROM split_part(b, '|', 2) AS alike FROM k""")
def token_equal(spark, d):
    words = _t(spark, d, "documents").select(text.words(F.col("text")).alias("w"))
    pairs = words.select(F.explode(text.neighbours(F.col("w"), 2)).alias("p")).select(F.col("p.w0").alias("x"), F.col("p.w1").alias("y")).distinct()
    known = _lexicon(spark).where("lemma <> ''")
    side = lambda s: F.broadcast(known.select(F.col("word").alias(s), F.struct("lemma", "stem").alias(f"{s}_")))  # noqa: E731  (a dozen words)
    rows = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left")
    token = lambda s: F.struct(F.col(s).alias("text"), F.col(f"{s}_.lemma").alias("lemma"), F.col(f"{s}_.stem").alias("stem"), F.lit("word").alias("type"))
    return rows.select("x", "y", text.token_equal(token("x"), token("y")).alias("equal"), text.sequence_equal(F.array(token("x")), F.array(token("y"))).alias("alike"))


# Values


@query("SELECT p_partkey, raw, CASE WHEN regexp_matches(trim(raw), '^#?[0-9a-fA-F]{6}$') THEN '#' || lower(right(trim(raw), 6)) END AS color FROM (SELECT p_partkey, ['', '#', ' #', 'x'][p_size % 4 + 1] || CASE WHEN p_partkey % 2 = 0 THEN upper(h) ELSE h END AS raw FROM (SELECT *, md5(p_name || p_partkey)[1:5 + p_partkey % 3] AS h FROM part))")
def hex_color(spark, d):
    digits = F.substring(F.md5(F.concat("p_name", "p_partkey")), F.lit(1), (F.col("p_partkey") % 3 + 5).cast("int"))
    raw = F.concat(F.get(F.array(*map(F.lit, ("", "#", " #", "x"))), (F.col("p_size") % 4).cast("int")), F.when(F.col("p_partkey") % 2 == 0, F.upper(digits)).otherwise(digits))
    return _t(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("color", text.hex_color(F.col("raw")))


#: Kinds of agents by key.
_KINDS = {"low": "5-low", "urgent": " 1-URGENT", "medium": "3-Medium"}


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 <> 4 THEN o_custkey END AS number,
CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'urgent' WHEN '3-MEDIUM' THEN 'medium' END AS kind,
CASE o_orderkey % 4 WHEN 0 THEN [o_orderpriority] WHEN 1 THEN ['a,b', o_custkey::VARCHAR] WHEN 2 THEN ['c', o_orderstatus] END AS domains FROM orders""")
def normalize_value(spark, d):
    date = lambda f: F.date_format("o_orderdate", f)
    said = F.get(F.array(date("dd.MM.yyyy"), F.concat(F.lit(" "), date("yyyy-MM-dd")), date("dd/MM/yyyy"), date("MM-yyyy"), F.lit("31.02.2000")), (F.col("o_orderkey") % 5).cast("int"))
    number = F.get(F.array(F.col("o_custkey").cast("string"), F.concat("o_custkey", F.lit(".75")), F.concat(F.lit(" "), "o_custkey", F.lit(" ")), F.concat("o_custkey", F.lit("e0")), F.lit("n/a")), (F.col("o_orderkey") % 5).cast("int"))
    names_said = F.get(F.array(F.concat(F.lit(" "), "o_orderpriority"), F.concat(F.lit("a,b ; ;"), "o_custkey"), F.concat(F.lit(",c , "), "o_orderstatus"), F.lit("  ")), (F.col("o_orderkey") % 4).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(text.any_date(said), "yyyy-MM-dd").alias("day"), registry.whole_number(number).alias("number"), registry.label_key(F.col("o_orderpriority"), {k: v.strip() for k, v in _KINDS.items()}).alias("kind"), registry.domains(names_said).alias("domains"))


@query("SELECT DISTINCT p_name AS phrase FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 49)")
def exclude_list(spark, d):
    p = _t(spark, d, "part")
    return lists.excluded(p.select(F.col("p_name").alias("phrase")), p.where("p_size > 49").select(F.upper("p_name").alias("phrase"))).distinct()


_BOX = "l_orderkey, l_linenumber, l_linenumber::BIGINT * 3 AS a, l_linenumber::BIGINT * 3 + l_quantity::BIGINT AS b, l_suppkey % 60 AS c, l_suppkey % 60 + l_partkey % 20 AS d"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN greatest(a, c) <= least(b, d) THEN greatest(a, c) END AS s, CASE WHEN greatest(a, c) <= least(b, d) THEN least(b, d) END AS e, least(a, c) AS hull_s, greatest(b, d) AS hull_e FROM (SELECT {_BOX} FROM lineitem)")
def interval_intersect(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "bigint(l_linenumber) * 3 AS a", "bigint(l_linenumber) * 3 + bigint(l_quantity) AS b", "l_suppkey % 60 AS c", "l_suppkey % 60 + l_partkey % 20 AS d")
    (s, e), (hs, he) = spans.intersection(*map(F.col, "abcd")), spans.hull(*map(F.col, "abcd"))
    return rows.select("l_orderkey", "l_linenumber", s.alias("s"), e.alias("e"), hs.alias("hull_s"), he.alias("hull_e"))


# Registry entries


@query("SELECT o_orderkey, 'ИМЯ ' || o_orderpriority AS name FROM orders")
def strip_number(spark, d):
    raw = F.concat(F.get(F.array(F.lit(""), F.lit(" "), F.lit("\t ")), (F.col("o_orderkey") % 3).cast("int")), "o_orderkey", F.lit("."), F.repeat(F.lit(" "), (F.col("o_orderkey") % 4).cast("int")), F.lit("ИМЯ "), "o_orderpriority")
    return _t(spark, d, "orders").select("o_orderkey", registry.strip_number(raw).alias("name"))


# with other names and a date, with a date alone, or the name alone
@query("""SELECT o_orderkey, 'ЛИЦО ' || o_custkey AS main, CASE WHEN o_orderkey % 3 = 0 THEN ['Имя ' || o_orderstatus, o_custkey::VARCHAR] END AS additional,
CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS birth, CASE WHEN o_orderkey % 3 < 2 THEN 'г. Город ' || o_custkey END AS place FROM orders""")
def ru_names(spark, d):
    date = F.concat(F.lit(", "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" г.р. , г. Город "), "o_custkey", F.lit(";"))
    more = F.concat(F.lit("*, (Имя "), "o_orderstatus", F.lit(";  ;"), "o_custkey", F.lit(" )"))
    raw = F.concat("o_orderkey", F.lit(". ЛИЦО "), "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(more, date)).when(F.col("o_orderkey") % 3 == 1, date).otherwise(""))
    rows = _t(spark, d, "orders").select("o_orderkey", registry.strip_number(raw).alias("raw"))
    name = registry.person_name(F.col("raw"))
    return rows.select("o_orderkey", name["main"].alias("main"), F.when(F.size(name["additional"]) > 0, name["additional"]).alias("additional"), F.date_format(registry.birth_date(F.col("raw")), "yyyy-MM-dd").alias("birth"), registry.birth_place(F.col("raw")).alias("place"))


@query("SELECT c_custkey, c_name AS main, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS alias, CASE WHEN c_custkey % 2 = 0 THEN 'QDi.' || c_nationkey END AS code FROM customer")
def intl_names(spark, d):
    raw = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  ("), "c_mktsegment", F.lit(")"))).otherwise(" "), F.lit(", "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("(QDi."), "c_nationkey", F.lit(")"))).otherwise("no code"))
    name = registry.org_name(raw)
    return _t(spark, d, "customer").select("c_custkey", name["main"].alias("main"), name["alias"].alias("alias"), registry.sanction_code(raw).alias("code"))


# a plain name, one before a star, one before a bracket, and one that can't be parsed
@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ООО ' || c_mktsegment WHEN 1 THEN 'Союз «' || c_nationkey || '»' WHEN 2 THEN 'Фонд ' || c_nationkey ELSE '' END AS main,
CASE c_custkey % 4 WHEN 1 THEN 'Лига|' || c_mktsegment WHEN 2 THEN c_mktsegment ELSE '' END AS more, c_custkey % 4 IN (0, 3) AS problem FROM customer""")
def ru_org_names(spark, d):
    variants = [
        F.concat(F.lit("ООО "), "c_mktsegment", F.lit(" ;*")),
        F.concat(F.lit("Союз «"), "c_nationkey", F.lit("»* (Лига; "), "c_mktsegment", F.lit("), г. Город;")),
        F.concat(F.lit("Фонд "), "c_nationkey", F.lit(" ("), "c_mktsegment", F.lit("), с. Село")),
        F.concat(F.lit("«"), "c_mktsegment", F.lit("»")),
    ]
    n = registry.org_names_ru(F.concat("c_custkey", F.lit(". "), F.get(F.array(*variants), (F.col("c_custkey") % 4).cast("int"))))
    return _t(spark, d, "customer").select("c_custkey", n["main"].alias("main"), F.array_join(n["additional"], "|").alias("more"), n["parsing_problem"].alias("problem"))


def _capital(c):
    """A word of Russian letters from a Latin one, in capitals at its start only."""
    return F.initcap(F.translate(F.lower(c), _LATIN, _RUSSIAN))


_CAP = f"upper(translate(lower(c_mktsegment), '{_LATIN}', '{_RUSSIAN}')[1]) || translate(lower(c_mktsegment), '{_LATIN}', '{_RUSSIAN}')[2:]"
_FULL = f"{_CAP} || ' Иван Петрович'"


@query(f"""SELECT c_custkey, unnest(list_concat([{_FULL} || ':full_name', {_CAP} || ':surname'], CASE WHEN c_custkey % 2 = 0 THEN [c_name || ':text', 'Ваня:text'] ELSE [] END)) AS term FROM customer WHERE c_custkey % 3 <> 2""")
def fio_terms(spark, d):
    name = F.concat(_capital(F.col("c_mktsegment")), F.lit(" Иван Петрович"))
    raw = F.when(F.col("c_custkey") % 3 == 2, F.lower("c_name")).otherwise(F.concat(F.lit("  "), name, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' "'), "c_name", F.lit(', Ваня, "'))).otherwise("")))
    return _t(spark, d, "customer").select("c_custkey", F.explode(registry.full_name_terms(raw)).alias("x")).select("c_custkey", F.concat_ws(":", "x.text", "x.type").alias("term"))


@query(f"""SELECT c_custkey, text, type FROM (SELECT c_custkey, {_FULL} AS text, 'full_name' AS type FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, {_CAP}, 'surname' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, c_name, 'text' FROM customer WHERE c_custkey % 3 < 2)""")
def combined_terms(spark, d):
    title = F.concat(F.lit("«"), "c_name", F.lit("»"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(_capital(F.col("c_mktsegment")), F.lit(" Иван Петрович "), title)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" Фонд поддержки "), title)).otherwise(title)
    return _t(spark, d, "customer").select("c_custkey", F.explode(registry.combined_terms(raw)).alias("x")).select("c_custkey", "x.*")


# Names



def _case_sql(gender: str) -> str:
    """The first form by case of surname s, an array, as a cascade of regular expressions."""
    quoted = lambda some: "[" + ", ".join(f"'{x}'" for x in some) + "]"
    # the first form is the surname as it is
    ends = lambda pattern, drop, endings: f"WHEN regexp_matches(s, '{pattern}$') THEN list_prepend(s, list_transform({quoted(endings[1:])}, lambda x: s[1:length(s) - {drop}] || x))"
    same = "[s, s, s, s, s, s]"
    out = []
    for s, cases in names.EXCEPTIONS[gender].items():
        out.append(f"WHEN s = '{s}' THEN {quoted(c.split()[0] for c in (cases if len(cases) > 1 else cases * 6))}")
    out.append(f"WHEN regexp_matches(s, '(иа|[{names.VOWELS}]а|{'|'.join(names.FIXED_ENDINGS)})$') THEN {same}")
    if gender == "f":
        out += [ends("яя", 2, names.ADJECTIVE_F_SOFT), ends("ая", 2, names.ADJECTIVE_F), f"WHEN regexp_matches(s, '[бвгджзклмнпрстфхцчшщьй]$') THEN {same}"]
    else:
        out += [ends("[сц]к[ио]й", 2, names.ADJECTIVE_SKY), ends("ий", 2, names.ADJECTIVE_SOFT), ends("[оы]й", 2, names.ADJECTIVE), ends("ь", 1, names.SOFT), ends("й", 1, names.SOFT)]
    out += [ends("я", 1, names.END_YA), ends("[гкхжчшщц]а", 1, names.END_A_VELAR), ends("а", 1, names.END_A)]
    if gender == "m":
        out += [ends("(ов|ев|ин|ын)", 0, names.HARD_OV), ends("[бвгджзклмнпрстфхцчшщ]", 0, names.HARD)]
    return "CASE " + " ".join(out) + f" ELSE {same} END"


_SURNAMES = rf"SELECT DISTINCT unnest(regexp_extract_all({_CY}, '[а-я]+')) AS s FROM documents"


# every word that the texts give in Russian letters, taken for a surname
@query(f"SELECT s AS surname, array_to_string({_case_sql('m')}, ' ') AS male, array_to_string({_case_sql('f')}, ' ') AS female FROM ({_SURNAMES})")
def decline_surname(spark, d):
    words = _russian(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[а-я]+"), F.lit(0))).alias("surname")).distinct()
    return words.select("surname", *(F.array_join(names.surname_forms(F.col("surname"), g), " ").alias(label) for g, label in (("m", "male"), ("f", "female"))))


_SOUGHT = [(0, "Ин"), (1, "Тхе"), (2, "Анд"), (3, "Ун"), (4, "Дер"), (5, "Еин"), (6, "Ла"), (7, "Бы-Нц"), (8, "Унд")]


# words and pairs of words whose forms, of both genders, begin with the surname's first three letters
@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all({_CY}, '[\\p{{L}}\\p{{N}}_]+-[\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
f AS (SELECT DISTINCT surname, part[1] AS form FROM (SELECT surname, unnest(list_concat(list_zip({_case_sql('m')}), list_zip({_case_sql('f')}))) AS part FROM (SELECT surname, lower(surname) AS s FROM {_sql_values(_SOUGHT[:7] + _SOUGHT[8:], 'i, surname', 'v')}))
  UNION SELECT 'Бы-Нц', 'бы-нц' || x FROM (VALUES (''), ('а'), ('у'), ('ом'), ('е')) e(x))
SELECT doc_id, surname, form, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(w) AS form FROM p) JOIN f USING (form) WHERE form[1:3] = lower(surname)[1:3] GROUP BY ALL""")
def surname_match(spark, d):
    sought = spark.createDataFrame([(i, "names", s, "surname") for i, s in _SOUGHT], "ord long, list_key string, phrase string, type string")
    found = match.search_all(_russian(spark, d), sought)
    return found.groupBy("doc_id", F.col("phrase").alias("surname"), "form").agg(F.count(F.lit(1)).alias("n"))


_FIRST, _LAST = ["Иван", "Анна", "Ким", "Владимир", "Дмитрий", "Илья"], ["Иванович", "Сергеевна", "Ильинична", "Кузьмич", "", "Петрова"]


@query("""SELECT c_custkey, CASE WHEN l IN (0, 3) THEN 'm' WHEN l IN (1, 2) THEN 'f' WHEN f IN (3, 4) THEN 'm' WHEN f IN (1, 5) THEN 'f' ELSE 'm' END AS gender FROM (SELECT c_custkey, c_custkey % 6 AS f, c_nationkey % 6 AS l FROM customer)""")
def gender_detect(spark, d):
    pick = lambda some, c: F.get(F.array(*map(F.lit, some)), (F.col(c) % 6).cast("int"))
    name = F.concat_ws(" ", _capital(F.col("c_mktsegment")), pick(_FIRST, "c_custkey"), pick(_LAST, "c_nationkey"))
    return _t(spark, d, "customer").select("c_custkey", names.gender(name).alias("gender"))


# Recognised words

_OCR = """SELECT CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE l_orderkey::VARCHAR END AS page, CASE WHEN l_suppkey % 2 = 0 THEN '5' ELSE (l_suppkey % 6)::VARCHAR END AS level, (l_quantity::BIGINT - 3)::VARCHAR AS conf, CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE ' ' || l_returnflag || l_linenumber || ' ' END AS word FROM lineitem"""


@query(f"SELECT try_cast(page AS BIGINT) AS page, try_cast(level AS INTEGER) AS level, try_cast(conf AS DOUBLE) AS conf, trim(word) AS word FROM ({_OCR}) WHERE page <> 'x' AND try_cast(conf AS DOUBLE) >= 0 AND (level <> '5' OR try_cast(conf AS DOUBLE) >= 10) AND trim(word) <> ''")
def ocr_clean(spark, d):
    raw = _t(spark, d, "lineitem").selectExpr("CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE string(l_orderkey) END AS page", "CASE WHEN l_suppkey % 2 = 0 THEN '5' ELSE string(l_suppkey % 6) END AS level", "string(bigint(l_quantity) - 3) AS conf", "CASE WHEN l_partkey % 7 = 0 THEN '  ' ELSE concat(' ', l_returnflag, l_linenumber, ' ') END AS word")
    return ocr.cleaned(raw, ["page", "level"], {"page": "bigint", "level": "int", "conf": "double"})


# each item is a line of one word or two; a third of the last ones end in a hyphen
_LINES = """SELECT l_orderkey AS page, 1 AS block, l_suppkey % 2 AS par, l_linenumber AS line, unnest(CASE WHEN l_partkey % 4 = 0 THEN [1, 2] ELSE [1] END) AS word_num, l_partkey, l_quantity::INTEGER AS conf, l_extendedprice::INTEGER AS x FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1"""


@query(f"""WITH r AS ({_LINES}), w AS (SELECT page, block, par, line, word_num, 'w' || l_partkey || CASE WHEN (l_partkey % 4 <> 0 OR word_num = 2) AND l_partkey % 3 <> 1 THEN '-' ELSE '' END AS text, conf, x + word_num * 50 AS l, 10 + l_partkey % 9 AS wd, 8 + l_partkey % 5 AS ht FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY block, par, line, word_num) AS i FROM w),
o AS (SELECT a.*, b.text AS t2, b.conf AS c2, b.l AS l2, b.wd AS w2, b.ht AS h2, coalesce(ends_with(a.text, '-') AND b.par = a.par AND b.line = a.line + 1 AND b.word_num = 1, false) AS opens FROM n a LEFT JOIN n b ON b.page = a.page AND b.i = a.i + 1),
g AS (SELECT *, i - row_number() OVER (PARTITION BY page, opens ORDER BY i) AS run FROM o),
j AS (SELECT *, opens AND row_number() OVER (PARTITION BY page, opens, run ORDER BY i) % 2 = 1 AS joins FROM g),
k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY page ORDER BY i), false) AS gone FROM j)
SELECT page, par, line, word_num, CASE WHEN joins THEN text[1:length(text) - 1] || t2 ELSE text END AS text, CASE WHEN joins THEN least(conf, c2) ELSE conf END AS conf, CASE WHEN joins THEN l2 + w2 - l ELSE wd END AS width, CASE WHEN joins THEN greatest(ht, h2) ELSE ht END AS height FROM k WHERE NOT gone""")
def ocr_dehyphen(spark, d):
    items = lists.one_each(_t(spark, d, "lineitem"), F.struct("l_orderkey", "l_linenumber"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    rows = items.withColumn("word_num", F.explode(F.expr("CASE WHEN l_partkey % 4 = 0 THEN array(1, 2) ELSE array(1) END")))
    words = rows.selectExpr(
        "l_orderkey AS page", "1 AS block", "l_suppkey % 2 AS par", "l_linenumber AS line", "word_num",
        "concat('w', l_partkey, CASE WHEN (l_partkey % 4 <> 0 OR word_num = 2) AND l_partkey % 3 <> 1 THEN '-' ELSE '' END) AS text",
        "int(rint(l_quantity)) AS conf", "int(rint(l_extendedprice)) + word_num * 50 AS left", "10 + l_partkey % 9 AS width", "8 + l_partkey % 5 AS height",
    )
    return spans.join_hyphenated(words).select("page", "par", "line", "word_num", "text", "conf", "width", "height")


# a page for each order: its picture is turned by a quarter, scaled or mirrored, and moved; its items are words
_WORDS = """l_orderkey AS page, CASE WHEN l_suppkey % 5 = 0 THEN 4 ELSE 5 END AS level, concat('w', l_partkey) AS text, CASE WHEN l_partkey % 9 <> 0 THEN concat(l_returnflag, l_linestatus) END AS lemma, l_quantity AS conf,
l_extendedprice / 40 AS l, l_discount * 8000 AS t, l_quantity * 6 - 6 AS w, 10 + l_partkey % 30 AS h"""
_PAGES = """o_orderkey AS page, CASE o_orderkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 WHEN 2 THEN -1.5 ELSE 1e-4 END AS a, CASE o_orderkey % 4 WHEN 1 THEN 1.0 ELSE 0.0 END AS b, CASE o_orderkey % 4 WHEN 1 THEN -1.0 ELSE 0.0 END AS c,
CASE o_orderkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE 1e-4 END AS d, o_custkey / 10.0 AS e, CASE WHEN o_orderkey % 3 = 0 THEN -20.0 ELSE 35.5 END AS f, CASE WHEN o_orderkey % 4 = 2 THEN -1700.0 ELSE -500.0 END AS px0, -900.0 AS py0, CASE WHEN o_orderkey % 7 = 0 THEN -5000.0 ELSE 1200.0 END AS px1, 900.0 AS py1"""
_TAKEN = """l_orderkey AS page, l_discount * 9000 - 400 AS x0, l_extendedprice / 90 - 700 AS y0, l_discount * 9000 - 400 + l_quantity * 3 AS x1, l_extendedprice / 90 - 700 + l_partkey % 50 AS y1"""


@query(f"""WITH w AS (SELECT row_number() OVER () AS id, {_WORDS} FROM lineitem), g AS (SELECT {_PAGES} FROM orders), k AS (SELECT {_TAKEN} FROM lineitem),
i AS (SELECT w.*, g.*, a * d - b * c AS det FROM w JOIN g USING (page) WHERE level = 5 AND w > 0 AND h > 0 AND lemma IN ('AF', 'RF') AND abs(a * d - b * c) >= 1e-6),
q AS (SELECT *, unnest([l, l + w, l, l + w]) - e AS x, unnest([t, t, t + h, t + h]) - f AS y FROM i),
r AS (SELECT id, page, text, lemma, conf, px0, py0, px1, py1, min((d * x - c * y) / det) AS x0, min((a * y - b * x) / det) AS y0, max((d * x - c * y) / det) AS x1, max((a * y - b * x) / det) AS y1 FROM q GROUP BY ALL),
s AS (SELECT id, page, text, lemma, conf, CASE WHEN px0 < px1 THEN greatest(x0, px0) ELSE x0 END AS x0, CASE WHEN px0 < px1 THEN greatest(y0, py0) ELSE y0 END AS y0, CASE WHEN px0 < px1 THEN least(x1, px1) ELSE x1 END AS x1, CASE WHEN px0 < px1 THEN least(y1, py1) ELSE y1 END AS y1 FROM r),
z AS (SELECT * FROM s WHERE x1 - x0 >= 1e-3 AND y1 - y0 >= 1e-3)
SELECT page, text, lemma, conf, x0, y0, x1, y1 FROM z WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page = z.page AND k.x0 < k.x1 AND k.y0 < k.y1
AND least(z.x1 + greatest(1, (z.x1 - z.x0) * 0.05), k.x1) - greatest(z.x0 - greatest(1, (z.x1 - z.x0) * 0.05), k.x0) > 1e-3 AND least(z.y1 + greatest(1, (z.y1 - z.y0) * 0.1), k.y1) - greatest(z.y0 - greatest(1, (z.y1 - z.y0) * 0.1), k.y0) > 1e-3)""")
def ocr_candidates(spark, d):
    select = lambda name, columns: _t(spark, d, name).selectExpr(*_columns(columns))
    words = select("lineitem", _WORDS).withColumnsRenamed({"l": "left", "t": "top", "w": "width", "h": "height"})
    found = ocr.candidates(words, spark.createDataFrame([("AF",), ("RF",), ("RF",)], "lemma string"), select("orders", _PAGES), select("lineitem", _TAKEN))
    return found


def _columns(listed: str) -> list[str]:
    """The expressions of a select list, in which commas also stand within brackets."""
    out, depth = [""], 0
    for ch in listed:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out
