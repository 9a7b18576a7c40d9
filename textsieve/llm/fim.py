"""Fill-in-the-middle arrangements of texts, with Spark's own functions only.

A text is cut into units (lines), two cuts drawn from a hash of its id leave a prefix, a middle and a suffix, and the three
stand in another order behind sentinels, so that a model learns to fill the middle in from both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units: lines with their line feed, the last one maybe without.
LINE = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels must not meet: no end of one may begin another, or a text's last characters could read as part of one."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))) or sentinels.count(a) > 1:
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    return sentinels


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n numbers of 32 bits in the sha256 of `seed:id`; a null id counts as empty."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def arranged(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINE, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null
    if plain), output. Of 100 texts `rate` are arranged, of these `spm_rate` of 100 with the suffix first. unit is a pattern
    whose matches tile any text.

    Null and empty texts, and texts that hold a sentinel, stay plain. A text of one unit may be cut before or after it
    only, so that a part is empty. Rows with equal ids are cut alike, null ids as an id of no digits; a repeated row gives
    a repeated row; other columns take no part; an empty table gives none. There is no shuffle, and a row is one text, of
    any length, and its units."""
    prefix, suffix, middle = _checked(sentinels)
    h1, h2, h3, h4 = (F.col(f"_h{i}") for i in range(4))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *(h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(id_col), seed))))
    rows = rows.withColumn("_units", F.regexp_extract_all("_text", F.lit(unit), F.lit(0)))
    rows = rows.withColumn("_n", F.size("_units")).withColumn("_a", F.least(h1 % (F.col("_n") + 1), h2 % (F.col("_n") + 1)).cast("int")).withColumn("_b", F.greatest(h1 % (F.col("_n") + 1), h2 % (F.col("_n") + 1)).cast("int"))
    plain = (F.col("_text") == "") | (h3 % 100 >= rate) | F.contains("_text", F.lit(prefix)) | F.contains("_text", F.lit(suffix)) | F.contains("_text", F.lit(middle))
    part = lambda start, length: F.array_join(F.slice("_units", start + 1, length), "")
    rows = rows.select(
        "doc_id",
        F.col("_n").cast("long").alias("n"),
        "_text",
        F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        part(F.lit(0), F.col("_a")).alias("_p"),
        part(F.col("_a"), F.col("_b") - F.col("_a")).alias("_m"),
        part(F.col("_b"), F.col("_n") - F.col("_b")).alias("_s"),
    )
    moved = F.col("form") != "plain"
    psm, spm = F.concat(F.lit(prefix), "_p", F.lit(suffix), "_s", F.lit(middle), "_m"), F.concat(F.lit(suffix), "_s", F.lit(prefix), "_p", F.lit(middle), "_m")
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.char_length("_p").cast("long")).alias("prefix_chars"),
        F.when(moved, F.char_length("_m").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text")).alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which arranged() made an output; a null output has none."""
    prefix, suffix, middle = _checked(sentinels)
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)  # noqa: E731  (each sentinel stands once)
    after = F.substring_index(output, middle, -1)
    psm = F.concat(between(prefix, suffix), after, between(suffix, middle))
    spm = F.concat(between(prefix, middle), after, between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """arranged() with the hashes of its output and of the text restored from it, in place of the output."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: DuckDB SQL for digests(arranged(documents)).
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
