"""Column functions on texts: normalising, tokens, words, windows of words, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
#: White space as Unicode has it.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
TOKEN = rf"{WORD}|{SPACE}+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x85\xa0  -     　]+"
LETTER_RUN = r"[a-zA-Zа-яёА-ЯЁ]+(?:-[a-zA-Zа-яёА-ЯЁ]+)*"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(c: Column) -> Column:
    """ё counts as е; lower case, without white space at the ends."""
    return stripped(F.lower(F.translate(c, "Ёё", "Ее")))


def folded(c: Column) -> Column:
    return F.lower(F.translate(c, "Ёё", "Ее"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(WORD), F.lit(0))


def _let(c: Column, f) -> Column:
    """f of c, with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _running(items: Column, length, start: Column) -> Column:
    """Where each item starts, from start on. The array is copied for each item, so items are few."""
    sums = F.aggregate(items, F.array(start), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + length(t))))
    return F.slice(sums, 1, F.size(items))


def starts(parts: Column) -> Column:
    """Where each of the parts starts in their concatenation; summed by blocks, as one running array over all of a long
    text's parts would be copied for each part. A block has as many parts as there are blocks."""
    total = lambda b: F.aggregate(b, F.lit(0), lambda acc, t: acc + F.char_length(t))
    at = lambda bs: _running(F.transform(bs, total), lambda n: n, F.lit(0))

    def summed(block: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(parts) - 1) / block).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(parts, i * block + 1, block))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, at(bs), lambda b, s: _running(b, F.char_length, s))))

    return _let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(parts))).cast("int")), summed)


def tokens(c: Column) -> Column:
    """array<struct<text, start, type>>: tokens tile the text; start counts characters of the original text."""
    kind = lambda t: F.when(t == " ", "space").when(t.rlike(rf"^{WORD}"), "word").when(t.rlike(rf"^{SPACE}"), "space").otherwise("punct")
    each = lambda t, s: F.struct(folded(t).alias("text"), s.alias("start"), kind(t).alias("type"))
    return _let(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda parts: F.zip_with(parts, starts(parts), each))


def clean_word(c: Column) -> Column:
    """The first run of letters, hyphens inside included; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(stripped(c)), LETTER_RUN, 0), F.lit(""))


def is_cyrillic(c: Column) -> Column:
    return c.rlike("[а-яА-ЯёЁ]")


def windows(items: Column, k: int, key=lambda a: a) -> Column:
    """array<struct<start, gram>> of all runs of k items, joined by a space, none of null; key is applied to the run first."""

    def runs(a: Column) -> Column:
        n = F.size(a) - (k - 1)
        # of too few items the one run that a sequence from 1 to 1 would give goes
        made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct((i - 1).alias("start"), F.array_join(key(F.slice(a, i, k)), " ").alias("gram")))
        return F.slice(made, F.lit(1), F.greatest(n, F.lit(0)))

    return _let(items, runs)


def neighbours(items: Column, k: int) -> Column:
    """array<struct<w0, w1, ...>> of all runs of k items, from slices beside each other; items are named k + 1 times, so a
    column that is computed before."""
    n = F.greatest(F.size(items) - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(items, F.lit(i + 1), n).alias(f"w{i}") for i in range(k)))


def dehyphenate(c: Column) -> Column:
    """Words that a hyphen or soft hyphen splits at the end of a line, joined again."""
    return F.regexp_replace(c, "[-­]\n", "")


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank, without a byte order mark."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "^﻿", ""), r"\R"), stripped), lambda x: x != "")


def file_size_label(n: Column) -> Column:
    label = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))
    return F.when(n.isNotNull(), label)


def msk_time(ts: Column) -> Column:
    """UTC time as Moscow's, three hours on."""
    return F.coalesce(F.concat(F.date_format(ts + F.expr("interval 3 hours"), "dd.MM.yyyy HH:mm"), F.lit(" МСК")), F.lit("—"))


def hex_color(c: Column) -> Column:
    digits = F.regexp_extract(F.trim(c), "^#?([0-9a-fA-F]{6})$", 1)
    return F.when(digits != "", F.concat(F.lit("#"), F.lower(digits)))


def letters_only(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Zа-яА-ЯёЁ\s\-]+$")


def any_date(c: Column) -> Column:
    """A date as dd.mm.yyyy, yyyy-mm-dd or dd/mm/yyyy; null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in ("dd.MM.yyyy", "yyyy-MM-dd", "dd/MM/yyyy")))


def match_kind(words_of_phrase: Column, is_regex: Column) -> Column:
    return F.when(is_regex, "regex").when(F.size(words_of_phrase) > 1, "phrase").otherwise("word")


def hyphen_pairs(c: Column) -> Column:
    """`word-word` from left to right, no word in two of them."""
    return F.regexp_extract_all(folded(c), F.lit(f"{WORD}-{WORD}"), F.lit(0))


def token_at(toks: Column, pos: Column) -> Column:
    """The index of the token that covers a place; tokens tile the text, so it is the last that starts there or before."""
    return F.size(F.filter(toks, lambda t: t["start"] <= pos)) - 1


def token_of(c: Column, pos: Column) -> Column:
    """token_at(tokens(c), pos) without the tokens: the text up to the place has as many tokens as end there or before, and
    one of a token that it cuts."""
    return F.regexp_count(F.substring(c, F.lit(1), (pos + 1).cast("int")), F.lit(TOKEN)) - 1


def token_equal(a: Column, b: Column) -> Column:
    """Tokens (text, lemma, stem) are equal by text, or by lemma and stem where both have them."""
    return (a["text"] == b["text"]) | F.coalesce((a["lemma"] != "") & (a["lemma"] == b["lemma"]) & (a["stem"] != "") & (a["stem"] == b["stem"]), F.lit(False))


def sequence_equal(a: Column, b: Column) -> Column:
    """Token arrays (text, lemma, stem, type) of one length whose tokens agree in type and in text, lemma or stem, place by
    place; two nulls agree."""
    same = F.zip_with(a, b, lambda x, y: (x["type"] == y["type"]) & ((x["text"] == y["text"]) | x["lemma"].eqNullSafe(y["lemma"]) | x["stem"].eqNullSafe(y["stem"])))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: x)


def iso_time(c: Column) -> Column:
    """A time as in ISO 8601, `Z` or an offset at its end; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def run_status(running: Column, last: Column) -> Column:
    return F.when(running, "В работе").when(last.isNull(), "Не проводилось").otherwise("Выполенено")
