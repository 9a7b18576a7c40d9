"""Registry records as forms show them, and as forms give them back; notes on matches; tasks as lists show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry, text

TERM_TYPES = ["text", "surname", "full_name"]
_DAY = "yyyy-MM-dd"
_TERMS = "array<struct<text:string,type:string>>"


def _day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, _DAY), F.lit(""))


def form_day(c: Column) -> Column:
    """The date that the first ten characters of a form's field are, as yyyy-mm-dd; null if they are none."""
    return F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit(_DAY)).cast("date")


def terms_from_form(texts: Column, types: Column) -> Column:
    """array<struct<text, type>> of a form's two lists, pair by pair as far as both go: texts trimmed, blank ones left out;
    a type that isn't one of TERM_TYPES becomes text."""
    n = F.least(F.size(texts), F.size(types))
    pairs = F.zip_with(F.slice(texts, F.lit(1), n), F.slice(types, F.lit(1), n), lambda t, k: F.struct(F.trim(F.coalesce(t, F.lit(""))).alias("text"), F.when(F.trim(k).isin(TERM_TYPES), F.trim(k)).otherwise("text").alias("type")))
    return F.when(n >= 0, F.filter(pairs, lambda x: x["text"] != "")).otherwise(F.array().cast(_TERMS))


def terms_for_form(terms: Column) -> Column:
    """Terms with type text where they have none."""
    return F.transform(F.coalesce(terms, F.array().cast(_TERMS)), lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["type"], F.lit("text")).alias("type")))


def agent_to_form(records: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and, of records (agent_type, registry_number, full_name, include_date, exclude_date, domain_name,
    search_terms), what a form shows: texts, empty where there is nothing."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    status = registry.status_label(F.col("include_date"), F.col("exclude_date"))
    return records.select(
        *keep,
        blank("agent_type").alias("agent_type"),
        blank("registry_number").alias("number"),
        blank("full_name").alias("full_name"),
        status.alias("status_label"),
        _day(F.col("include_date")).alias("date_included"),
        _day(F.col("exclude_date")).alias("date_excluded"),
        F.coalesce(F.array_join("domain_name", "\n"), F.lit("")).alias("domain"),
        terms_for_form(F.col("search_terms")).alias("search_terms"),
    )


def agent_from_form(forms: DataFrame, keep: list[str], agent_types: list[str]) -> DataFrame:
    """The columns of keep and the record that a form (agent_type, number, full_name, date_included, date_excluded, domain,
    terms_text, terms_type) makes of old_agent_type's: its type only if it is one of agent_types, a number only of digits,
    domains parted by white space; what can't be read is null."""
    digits = F.trim("number")
    domains = F.filter(F.split("domain", r"\s+"), lambda x: x != "")
    return forms.select(
        *keep,
        F.when(F.col("agent_type").isin(agent_types), F.col("agent_type")).otherwise(F.col("old_agent_type")).alias("agent_type"),
        F.when(digits.rlike(r"^\d+$"), digits).try_cast("long").alias("registry_number"),
        F.nullif(F.trim("full_name"), F.lit("")).alias("full_name"),
        form_day(F.col("date_included")).alias("include_date"),
        form_day(F.col("date_excluded")).alias("exclude_date"),
        F.when(F.size(domains) > 0, domains).alias("domain_name"),
        terms_from_form(F.col("terms_text"), F.col("terms_type")).alias("search_terms"),
    )


def listed_from_form(forms: DataFrame, keep: list[str], types: list[str], person: str, org: str, home: str) -> DataFrame:
    """The columns of keep and type, birth_date, birth_place, company_region of a record (old_type, area, old_birth_date,
    old_birth_place, old_company_region) after a form (type, birth_date, birth_place, company_region; null: not in the form):
    birth fields change for persons of the home area, the region for organisations of it, and others stay."""
    kind = F.when(F.trim("type").isin(types), F.trim("type")).otherwise(F.col("old_type"))
    born, placed = (kind == person) & (F.col("area") == home), (kind == org) & (F.col("area") == home)
    at = lambda when, c, new: F.when(when & F.col(c).isNotNull(), new).otherwise(F.col(f"old_{c}")).alias(c)
    day = F.try_to_timestamp(F.trim("birth_date"), F.lit(_DAY)).cast("date")
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    return forms.select(*keep, kind.alias("type"), at(born, "birth_date", day), at(born, "birth_place", said("birth_place")), at(placed, "company_region", said("company_region")))


# What notes say.
USER_LIST, PATTERN = "Список пользователя", "Шаблон"


def annotated(matches: DataFrame, titles: dict[str, str], agents: str, person: str) -> DataFrame:
    """matches (kind, phrase, original, list_key, agent: struct<agent_type, full_name, birth_date, include_date, exclude_date,
    include_reason>) with title, content and shown. A list's title is that in titles, of no list that of the user's; a note's
    content is the phrase as it was given, or else itself; of the list `agents` what is known of the agent, nothing if none is
    known, and of a pattern its name in quotes. shown is what a search shows of it. Missing values are shown as None."""
    regex = F.coalesce(F.col("kind") == "regex", F.lit(False))
    title = F.when(regex, PATTERN).when(F.col("list_key").isNull(), USER_LIST).otherwise(F.coalesce(*(F.when(F.col("list_key") == k, t) for k, t in titles.items()), F.lit("")))
    a = F.col("agent")
    said = lambda label, c: F.concat(F.lit(label), F.coalesce(a[c].cast("string"), F.lit("None")))
    status = F.when(a["include_date"].isNotNull() & (a["exclude_date"].isNull() | (a["include_date"] > a["exclude_date"])), "Числится").otherwise("Снят")
    lines = [F.concat(F.lit("Иноагент (Статус: "), status, F.lit(")")), said("", "full_name"), F.when(a["agent_type"] == person, said("Дата рождения: ", "birth_date")), F.lit(""), F.lit("Деятельность: нет"), said("В реестре с: ", "include_date"), F.lit(""), said("Основание: ", "include_reason")]
    known = F.when(a.isNotNull(), F.array_join(F.array(*lines), "\n")).otherwise("")
    given = F.coalesce(F.nullif(F.col("original"), F.lit("")), F.col("phrase"))
    content = F.when(regex, F.concat(F.lit("«"), "phrase", F.lit("»"))).when(F.col("list_key") == agents, known).otherwise(given)
    return matches.withColumn("title", title).withColumn("content", content).withColumn("shown", F.when(regex, F.concat(F.lit('"'), "phrase", F.lit('"'))).otherwise(F.col("phrase")))


# States of tasks and how they are shown.
STATES = {"PENDING": "Ожидание", "PROCESSING": "Обработка", "COMPLETED": "Завершено"}


def task_list(tasks: DataFrame, ttl_seconds: int) -> DataFrame:
    """task_id, state, label, created_at, expires_at, seconds, size and how these are shown (took, size_label, created, expires)
    of tasks (task_id, fields: map<string, string>). A field that isn't there is looked for in result_data_json; a state that
    isn't known is PENDING, a missing label a dash, a time that can't be read null, a processing time below 0 none. A task
    expires ttl_seconds after it was made."""
    field = lambda name: F.nullif(F.try_element_at("fields", F.lit(name)), F.lit(""))
    kept = lambda path: F.get_json_object(field("result_data_json"), f"$.{path}")
    state, created = field("state"), text.iso_time(F.coalesce(field("created_at"), kept("created_at")))
    size = F.coalesce(F.trim(field("source_file_size_bytes")).try_cast("long"), F.trim(kept("source_file_size_bytes")).try_cast("long"))
    took = kept("processing_time").try_cast("double")
    rows = tasks.select(
        "task_id",
        F.when(state.isin(list(STATES)), state).otherwise("PENDING").alias("state"),
        F.coalesce(field("source_filename"), F.nullif(kept("source_filename"), F.lit("")), F.lit("—")).alias("label"),
        created.alias("created_at"),
        F.when(took >= 0, took).alias("seconds"),
        size.alias("size"),
    )
    rows = rows.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    dash = lambda c: F.coalesce(c, F.lit("—"))
    return rows.withColumns({"took": dash(F.when(F.col("seconds").isNotNull(), F.format_string("%.2f с", "seconds"))), "size_label": dash(text.file_size_label(F.col("size"))), "created": text.msk_time(F.col("created_at")), "expires": text.msk_time(F.col("expires_at"))})


def page_range(pages: DataFrame, ranges: DataFrame, key: str, page: str) -> DataFrame:
    """The rows of pages whose page (from 1) lies in the range (key, start, end) of their key; ends beyond the last page count as
    that page. `problem` of ranges that hold no page stands in a row of its own, with null pages: there are no pages, a bound is
    below 1, the start is behind the end, or behind the last page."""
    last = pages.groupBy(key).agg(F.max(page).alias("_last"))
    asked = ranges.join(last, key, "left")
    problem = (
        F.when(F.col("_last").isNull(), "no pages").when((F.col("start") < 1) | (F.col("end") < 1), "below 1").when(F.col("start") > F.col("end"), "start behind end").when(F.col("start") > F.col("_last"), "out of range")
    )
    told = asked.withColumn("problem", problem)
    good = told.where("problem is null").select(key, F.col("start").alias("_a"), F.least("end", "_last").alias("_b"), "problem")
    found = pages.join(good, key).where(F.col(page).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return found.unionByName(told.where("problem is not null").select(key, "problem"), allowMissingColumns=True)
