"""Forms of Russian names, for the dictionary side of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASES = ["nom", "gen", "dat", "acc", "ins", "pre"]

# Endings by case, in the order of CASES.
ADJECTIVE = ["ый", "ого", "ому", "ого", "ым", "ом"]
ADJECTIVE_SKY = ["ий", "ого", "ому", "ого", "им", "ом"]
ADJECTIVE_SOFT = ["ий", "его", "ему", "его", "им", "ем"]
ADJECTIVE_F = ["ая", "ой", "ой", "ую", "ой", "ой"]
ADJECTIVE_F_SOFT = ["яя", "ей", "ей", "юю", "ей", "ей"]
HARD = ["", "а", "у", "а", "ом", "е"]
HARD_OV = ["", "а", "у", "а", "ым", "е"]
SOFT = ["ь", "я", "ю", "я", "ем", "е"]
END_A = ["а", "ы", "е", "у", "ой", "е"]
END_A_VELAR = ["а", "и", "е", "у", "ой", "е"]
END_YA = ["я", "и", "е", "ю", "ей", "е"]

# Endings of surnames that don't decline, and particles, which don't either.
FIXED_ENDINGS = ["енко", "ко", "ых", "их", "аго", "яго", "ово", "е", "и", "о", "у", "ы", "э", "ю"]
VOWELS = "аеёиоуыэюя"
PARTICLES = ["де", "фон", "ван", "дер", "да", "дель", "ди", "ду", "ле", "ла"]

# Surnames with forms of their own, by case; a single one stands for all cases.
EXCEPTIONS = {
    "m": {
        "гайдай": ["гайдай", "гайдая", "гайдаю", "гайдая", "гайдаем", "гайдае"],
        "заяц": ["заяц", "заяца зайца", "заяцу зайцу", "заяца зайца", "заяцем зайцем", "заяце зайце"],
        "топчий": ["топчий", "топчего топчия", "топчему топчию", "топчего топчия", "топчим топчием", "топчем топчие"],
        **{s: [s] for s in ("дюма", "золя", "гавальда", "ли", "шоу", "гюго")},
    },
    "f": {s: [s] for s in ("дюма", "золя", "гавальда", "ли", "шоу", "гюго")},
}


def _normal(c: Column) -> Column:
    return F.lower(F.translate(F.trim(c), "Ёё", "Ее"))


def _simple(s: Column, gender: str, y: Column, foreign_ov_in: Column, fixed_a: Column) -> Column:
    """The paradigm of a normalised surname of one part: an array of CASES, each an array of variants."""

    def ends(drop: int, *paradigms: list[str]) -> Column:
        stem = s.substr(F.lit(1), F.char_length(s) - drop)
        cases = zip(*paradigms, strict=True)
        # the first form is the surname as it is
        return F.array(F.array(s), *(F.array_distinct(F.array(*(F.concat(stem, F.lit(e)) for e in case))) for case in list(cases)[1:]))

    same = F.array(*[F.array(s)] * 6)
    rules: list[tuple[Column, Column]] = []
    for name, cases in EXCEPTIONS[gender].items():
        rules.append((s == name, F.array(*(F.array(*map(F.lit, case.split())) for case in (cases if len(cases) > 1 else cases * 6)))))
    rules += [(s.rlike(f"иа$|[{VOWELS}]а$|({'|'.join(FIXED_ENDINGS)})$") | fixed_a, same)]
    adjective = F.when(s.rlike("ий$"), ends(2, ADJECTIVE_SOFT)).otherwise(ends(2, ADJECTIVE))
    both = F.when(s.rlike("ий$"), F.zip_with(ends(2, ADJECTIVE_SOFT), ends(1, SOFT), F.array_union)).otherwise(F.zip_with(ends(2, ADJECTIVE), ends(1, SOFT), F.array_union))
    if gender == "f":
        rules += [(s.rlike("яя$"), ends(2, ADJECTIVE_F_SOFT)), (s.rlike("ая$"), ends(2, ADJECTIVE_F)), (s.rlike("[бвгджзклмнпрстфхцчшщьй]$"), same)]
    else:
        rules += [(s.rlike("[сц]к[ио]й$"), ends(2, ADJECTIVE_SKY)), (s.rlike("ый$"), ends(2, ADJECTIVE))]
        rules += [(s.rlike("[ио]й$") & (y == "noun"), ends(1, SOFT)), (s.rlike("[ио]й$") & (y == "both"), both), (s.rlike("[ио]й$"), adjective)]
        rules += [(s.rlike("ь$"), ends(1, SOFT)), (s.rlike("й$") & (y == "adjective"), same), (s.rlike("й$") & (y == "both"), F.zip_with(same, ends(1, SOFT), F.array_union)), (s.rlike("й$"), ends(1, SOFT))]
    rules += [(s.rlike("я$"), ends(1, END_YA)), (s.rlike("[гкхжчшщц]а$"), ends(1, END_A_VELAR)), (s.rlike("а$"), ends(1, END_A))]
    if gender == "m":
        rules += [(s.rlike("(ов|ев|ин|ын)$") & ~foreign_ov_in, ends(0, HARD_OV)), (s.rlike("[бвгджзклмнпрстфхцчшщ]$"), ends(0, HARD))]
    (when, then), *more = rules
    out = F.when(when, then)
    for when, then in more:
        out = out.when(when, then)
    return out.otherwise(same)


#: What is known of a surname, or of a part of one, beside its letters.
META = "struct<y_declension:string,foreign_ov_in:boolean,indeclinable_final_a:boolean,override_forms:array<array<string>>>"


def paradigm(c: Column, gender: str, y: Column | None = None, foreign_ov_in: Column | None = None, fixed_a: Column | None = None, override: Column | None = None, hyphen_parts: Column | None = None) -> Column:
    """The forms of a surname by case, normalised: an array of CASES, each an array of variants. Particles before it stay,
    parts joined by hyphens decline each. y says how -й declines where the ending leaves it open: adjective, noun or both;
    foreign_ov_in: -ов and -ин as in foreign names; fixed_a: doesn't decline; override: the forms, whatever the ending, unless
    the surname is one of the EXCEPTIONS. All these are of surnames of one part; hyphen_parts (array of META) has them for
    each part of one with hyphens, and counts only if it has as many entries as there are parts."""
    none = lambda kind: F.lit(None).cast(kind)
    of = lambda x, kind: none(kind) if x is None else x.cast(kind)
    forms = "array<array<string>>"
    whole_meta = F.struct(of(y, "string").alias("y_declension"), of(foreign_ov_in, "boolean").alias("foreign_ov_in"), of(fixed_a, "boolean").alias("indeclinable_final_a"), of(override, forms).alias("override_forms"))
    whole = F.regexp_replace(_normal(c), r"\s+", " ")
    particles = "|".join(PARTICLES)
    lead = F.regexp_extract(whole, rf"^((?:(?:{particles}) )+)\S", 1)
    parts = F.split(whole.substr(F.char_length(lead) + 1, F.char_length(whole)), "-")
    many = F.size(parts) > 1
    given = of(hyphen_parts, f"array<{META}>")
    metas = F.when(~many, F.array(whole_meta)).when(F.size(given) == F.size(parts), given).otherwise(F.array_repeat(none(META), F.size(parts)))

    def one(p: Column, m: Column) -> Column:
        listed = F.array_contains(F.array(*map(F.lit, EXCEPTIONS[gender])), p)
        simple = _simple(p, gender, F.coalesce(m["y_declension"], F.lit("auto")), F.coalesce(m["foreign_ov_in"], F.lit(False)), F.coalesce(m["indeclinable_final_a"], F.lit(False)))
        own = F.transform(m["override_forms"], lambda case: F.transform(case, _normal))
        return F.when(p.isin(PARTICLES) & many, F.array(*[F.array(p)] * 6)).when(own.isNotNull() & ~listed, own).otherwise(simple)

    declined = F.zip_with(parts, metas, one)
    pairs = lambda a, b: F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda z: F.concat(x, F.lit("-"), z)))))
    joined = F.aggregate(F.slice(declined, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(declined, F.lit(0)), lambda acc, part: F.zip_with(acc, part, pairs))
    return F.transform(joined, lambda case: F.transform(case, lambda x: F.concat(lead, x)))


def surname_forms(c: Column, gender: str) -> Column:
    """The six cases of a surname, in order, each by its first variant."""
    return F.transform(paradigm(c, gender), lambda case: F.get(case, F.lit(0)))


def all_surname_forms(c: Column) -> Column:
    """The distinct forms of both genders, all variants."""
    return F.array_distinct(F.flatten(F.concat(paradigm(c, "m"), paradigm(c, "f"))))


def surname_index(surnames: DataFrame) -> DataFrame:
    """form, surname, gender, matched_case from surname and gender (m or f); and, where surnames have them, the columns
    y_declension, foreign_ov_in, indeclinable_final_a, override_forms and hyphen_parts, as paradigm() takes them."""
    more = [F.col(c) if c in surnames.columns else None for c in ("y_declension", "foreign_ov_in", "indeclinable_final_a", "override_forms", "hyphen_parts")]
    cases = F.when(F.col("gender") == "f", paradigm(F.col("surname"), "f", *more)).otherwise(paradigm(F.col("surname"), "m", *more))
    rows = surnames.select("surname", "gender", F.posexplode(cases).alias("_case", "_forms")).select("surname", "gender", F.element_at(F.array(*map(F.lit, CASES)), F.col("_case") + 1).alias("matched_case"), F.explode("_forms").alias("form"))
    return rows.select("form", "surname", "gender", "matched_case")


def gender(full_name: Column) -> Column:
    """m or f, by the ending of the patronymic, or else of the first name; m by default."""
    parts = F.split(F.lower(F.trim(full_name)), r"\s+")
    first, last = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
    return F.when(last.rlike("(ич|ыч)$"), "m").when(last.rlike("(евна|овна|инична)$"), "f").when(first.rlike("(ий|ов|ев|ир)$"), "m").when(first.rlike("[ая]$"), "f").otherwise("m")


def split_full_name(c: Column) -> Column:
    """struct<surname, first, patronymic> of a name of three parts; null of any other."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("surname"), parts[1].alias("first"), parts[2].alias("patronymic")))
