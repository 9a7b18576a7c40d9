"""Column functions that take registry entries apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\d+\.\s*", "")


def before_comma(c: Column) -> Column:
    return F.trim(F.split(c, ",", 2)[0])


def org_name(c: Column) -> Column:
    """struct(main, alias) of `Name (Alias), ...`."""
    name = before_comma(c)
    alias = F.nullif(F.regexp_extract(name, r"^(.*?)\s*\((.*)\)\s*$", 2), F.lit(""))
    return F.struct(F.when(alias.isNull(), name).otherwise(F.regexp_extract(name, r"^(.*?)\s*\((.*)\)\s*$", 1)).alias("main"), alias.alias("alias"))


def sanction_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\w+?\.\d+)", 1), F.lit(""))


def birth_date(c: Column) -> Column:
    parts = [F.regexp_extract(c, r"(\d{2})\.(\d{2})\.(\d{4})\s*г\.р\.", i) for i in (1, 2, 3)]
    return F.try_to_timestamp(F.concat_ws("-", parts[2], parts[1], parts[0]), F.lit("yyyy-MM-dd")).cast("date")


def birth_place(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"\d{2}\.\d{2}\.\d{4}\s*г\.р\.\s*,\s*([\p{L}\p{N}_.\s]+)", 1)), F.lit(""))


def person_name(c: Column) -> Column:
    """struct(main, additional): before `*` or else the first comma, all of it if there is neither; `(a; b)` behind."""
    main = F.when(F.instr(c, "*") > 0, F.substring_index(c, "*", 1)).otherwise(F.substring_index(c, ",", 1))
    inner = F.regexp_extract(c, r"\*?\s*,?\s*\(([^)]*)\)", 1)
    more = F.filter(F.transform(F.split(inner, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(main).alias("main"), more.alias("additional"))


def surname_of(c: Column) -> Column:
    return F.split(F.trim(c), " ")[0]


def search_terms(main: Column, additional: Column, person: Column, russian: Column) -> Column:
    """array<struct<text, type>>, the first of equal ones: full names (and surnames, if Russian) of persons, or texts."""
    names = F.filter(F.concat(F.array(main), F.coalesce(additional, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    of = lambda kind, get=lambda x: x: F.transform(names, lambda x: F.struct(get(x).alias("text"), F.lit(kind).alias("type")))
    full = F.when(russian, F.flatten(F.transform(names, lambda x: F.array(F.struct(x.alias("text"), F.lit("full_name").alias("type")), F.struct(surname_of(x).alias("text"), F.lit("surname").alias("type")))))).otherwise(of("full_name"))
    return F.array_distinct(F.when(person, full).otherwise(of("text")))


def catalog_rows(c: Column) -> Column:
    """array<struct<raw, area, type, is_active>> of a catalog as JSON text: what its eight lists hold, under international and
    russian, all and excluded, namesFL and namesUL, numbers before names left out. Lists that aren't there, or are something
    else, are empty; a text that isn't JSON gives none."""
    read = F.try_parse_json(c)

    def listed(area: str, state: str, kind: str) -> Column:
        names = F.coalesce(F.try_variant_get(read, f"$.{area}.{state}.names{kind}", "array<string>"), F.array().cast("array<string>"))
        return F.transform(names, lambda x: F.struct(strip_number(x).alias("raw"), F.lit(area).alias("area"), F.lit(kind).alias("type"), F.lit(state == "all").alias("is_active")))

    return F.concat(*(listed(a, s, k) for a in ("international", "russian") for s in ("all", "excluded") for k in ("FL", "UL")))


def status_label(included: Column, excluded: Column) -> Column:
    return F.when(included.isNull(), "—").when(excluded.isNull() | (included > excluded), "Числится").otherwise("Снят")


def full_name_terms(c: Column) -> Column:
    """array<struct<text, type>>: three capitalised Russian words as full name and surname, then nicknames in quotes behind."""
    pattern = r'((?:[А-ЯЁ][а-яё]+\s?){3})(?:"([^"]*)")?'
    name, nick = F.trim(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)
    nicks = F.filter(F.transform(F.split(nick, ","), lambda x: F.trim(x)), lambda x: x != "")
    of = lambda x, kind: F.struct(x.alias("text"), F.lit(kind).alias("type"))
    found = F.concat(F.array(of(name, "full_name"), of(surname_of(name), "surname")), F.transform(nicks, lambda x: of(x, "text")))
    return F.when(name != "", F.array_distinct(found)).otherwise(F.array().cast("array<struct<text:string,type:string>>"))


def org_title(c: Column) -> Column:
    """What stands in quotes behind Russian words."""
    return F.nullif(F.regexp_extract(c, r'(?:[А-я]+\s)+?[«"](.*?)[»"]', 1), F.lit(""))


def combined_terms(c: Column) -> Column:
    """array<struct<text, type>>: full_name_terms(), then org_title() as a text, the first of equal ones."""
    title = org_title(F.trim(c))
    return F.array_distinct(F.concat(full_name_terms(c), F.when(title.isNotNull(), F.array(F.struct(title.alias("text"), F.lit("text").alias("type")))).otherwise(F.array().cast("array<struct<text:string,type:string>>"))))


def whole_number(c: Column) -> Column:
    """A number as text, cut to a whole one; null if it isn't one."""
    number = F.trim(c).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number).cast("long")


def label_key(c: Column, labels: dict[str, str]) -> Column:
    """The key of the first of labels (key: label) that equals the trimmed text in any case; null if none does."""
    return F.coalesce(*(F.when(F.lower(F.trim(c)) == label.lower(), key) for key, label in labels.items()))


def domains(c: Column) -> Column:
    """The parts between semicolons, or else commas, trimmed and without empty ones; the text alone if that leaves none; null
    for a blank text."""
    t = F.trim(c)
    parts = F.when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t != "", F.when(F.size(kept) > 0, kept).otherwise(F.array(t)))


def org_names_ru(c: Column) -> Column:
    """struct(main, additional, parsing_problem) of a numbered entry: a plain name up to closing signs, or else what stands
    before `*`, or before `(`; only the latter two have additional names, from `(a; b),`, and count as parsed."""
    raw, word = strip_number(c), r"[\s\p{L}\p{N}_\-`]+"
    plain = F.regexp_extract(raw, rf"^({word})[\s*,;]+$", 1)
    lead = F.regexp_extract(raw, rf"^{word}", 0)
    starred, bracket = (plain == "") & raw.contains("*"), (plain == "") & ~raw.contains("*") & raw.contains("(") & (lead != "")
    found = starred | bracket
    inner = F.regexp_extract(raw, r"\((.*?)\),", 1)
    more = F.when(found & (inner != ""), F.transform(F.split(inner, ";"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.trim(F.when(plain != "", plain).when(starred, F.substring_index(raw, "*", 1)).when(bracket, lead).otherwise("")).alias("main"), more.alias("additional"), (~found).alias("parsing_problem"))


def term_slots(terms: Column, n: int = 6) -> Column:
    """The first n terms, empty texts after the last."""
    return F.slice(F.concat(F.coalesce(terms, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)


def has_terms(terms: Column) -> Column:
    return F.coalesce(F.size(terms), F.lit(0)) > 0
