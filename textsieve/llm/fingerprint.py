"""I-Match fingerprints, with DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: neither those of most documents nor those
of a handful. Each of several randomised subsets of it gives one hash of a document's distinct terms in the subset,
sorted. Subsets are of falling density, so that short and long documents both have subsets that catch a few terms. A text
that has no term in any subset (one of frequent terms only, or one of a large group of copies) has one hash of all its terms
instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: How many subsets hold one of so many terms of the lexicon: sparse ones catch a few terms of long texts, dense ones of
#: short texts.
SUBSETS = {16: 4, 64: 14, 256: 18, 1024: 16, 4096: 8}
#: A lexicon of more terms isn't broadcast but joined by a shuffle. A term takes 8 bytes and 4 for each of its subsets, of
#: which it has one on average: 2 million are some 60 MB.
BROADCAST_TERMS = 2_000_000


def words(text: Column) -> Column:
    """A text's distinct terms: runs of letters and digits, in lower case; also "", which isn't one."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, text_col: str = "text", least_idf: float = 3.0, most_idf: float = 7.6, least_docs: int = 2) -> DataFrame:
    """_term (hash) and _subsets (the numbers of the subsets that hold it, maybe none) of the terms in the band of
    ln(documents / documents with the term). At most (mean distinct terms of a document) * e**most_idf terms, however many
    documents there are. Written to the shared folder."""
    n = docs.count()
    found = docs.select(F.explode(words(F.coalesce(text_col, F.lit("")))).alias("_word")).where("_word <> ''").select(F.xxhash64("_word").alias("_term"))
    counts = found.groupBy("_term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("_df"))
    kept = counts.where((F.col("_df") >= least_docs) & idf.between(least_idf, most_idf))
    of = [one_in for one_in, times in SUBSETS.items() for _ in range(times)]
    # no filter on this column: it would be moved below the counting and run for each word of each text
    held = F.array_compact(F.array(*(F.when(F.pmod(F.xxhash64("_term", F.lit(k)), F.lit(one_in)) == 0, F.lit(k)) for k, one_in in enumerate(of))))
    return written(kept.select("_term", held.alias("_subsets")), "lexicon")


def whole_hash(text: Column, found: Column) -> Column:
    """The hash of all of a text's terms (found: words), or of the text itself if it has none; null for an empty text."""
    terms = F.array_remove(found, "")
    return F.when(F.size(terms) > 0, F.xxhash64(F.sort_array(terms), F.lit("terms"))).when(text != "", F.xxhash64(text, F.lit("text")))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.concat_ws(":", x["subset"].cast("string"), F.lower(F.lpad(F.hex(x["hash"]), 16, "0")))), ".")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that either has terms in; 1 if neither has any."""
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(a["subset"], b["subset"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a["hash"], b["hash"])) / either).cast("double")


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], known: DataFrame, keep: list[str]) -> DataFrame:
    """keys, the columns of keep, and for each name in texts (text column, not null -> name) the sorted array of (subset,
    hash of the text's sorted terms in it), or subset -1 with whole_hash for a text that has no term in any subset. If rows
    are already partitioned by a subset of the keys there is no shuffle: the lexicon is small enough to be broadcast, or
    else is joined by term."""
    flat = rows.select(*keys, F.struct(*keep).alias("_keep"), F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(c).alias("text")) for i, c in enumerate(texts)))).alias("_x"))
    flat = flat.select(*keys, "_keep", F.col("_x.of").alias("_of"), F.col("_x.text").alias("_text"), words(F.col("_x.text")).alias("_found"))
    # one more row for each text, with what belongs to all of it
    flat = flat.select(*keys, "_of", F.struct("_keep", whole_hash(F.col("_text"), F.col("_found")).alias("whole")).alias("_base"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "_found")).alias("_word"))
    flat = flat.where("_word is null or _word <> ''")
    flat = flat.select(*keys, "_of", F.when(F.col("_word").isNull(), F.col("_base")).alias("_base"), F.when(F.col("_word").isNotNull(), F.xxhash64("_word")).alias("_term"))
    if known.count() <= BROADCAST_TERMS:
        met = flat.join(F.broadcast(known), "_term", "left")
    else:
        base = flat.where("_term is null").withColumn("_subsets", F.lit(None).cast("array<int>"))
        met = flat.where("_term is not null").join(known, "_term").unionByName(base)
    met = met.where("_base is not null or size(_subsets) > 0").select(*keys, "_of", "_base", "_term", F.explode_outer("_subsets").alias("_subset"))
    by_subset = met.groupBy(*keys, "_of", "_subset").agg(F.first("_base", ignorenulls=True).alias("_base"), F.sort_array(F.collect_list("_term")).alias("_terms"))
    by_subset = by_subset.select(*keys, "_of", "_base", F.when(F.col("_subset").isNotNull(), F.struct(F.col("_subset").alias("subset"), F.xxhash64("_subset", "_terms").alias("hash"))).alias("_print"))
    mine = lambda i, c: F.when(F.col("_of") == i, F.col(c))
    of_text = [F.sort_array(F.collect_list(mine(i, "_print"))).alias(f"_prints_{i}") for i in range(len(texts))] + [F.first(mine(i, "_base.whole"), ignorenulls=True).alias(f"_whole_{i}") for i in range(len(texts))]
    grouped = by_subset.groupBy(*keys).agg(F.first("_base._keep", ignorenulls=True).alias("_keep"), *of_text)

    def prints(i: int) -> Column:
        whole = F.array(F.struct(F.lit(-1).alias("subset"), F.col(f"_whole_{i}").alias("hash")))
        return F.when((F.size(f"_prints_{i}") == 0) & F.col(f"_whole_{i}").isNotNull(), whole).otherwise(F.col(f"_prints_{i}"))

    return grouped.select(*keys, *(f"_keep.{c}" for c in keep), *(prints(i).alias(name) for i, name in enumerate(texts.values())))


def spans_of(docs: DataFrame, id_col: str, span: int, cells: int = 256) -> Column:
    """A number for each id, rising with it, that about `span` ids share, however ids lie: between each two of `cells` quantiles
    of the ids there are ranges of one width. Where ids crowd within such a cell, one number has all of the cell's at most."""
    fractions = F.array(*(F.lit(i / cells) for i in range(cells)))
    found, top, n = docs.agg(F.percentile_approx(id_col, fractions, F.lit(40 * cells)), F.max(id_col), F.count(id_col)).first()
    lows = sorted(set(found or [0]))
    lows = lows[:: max(1, -(-len(lows) * span // max(n, 1)))]  # fewer cells for few rows
    each = max(1.0, n / len(lows) / span)  # ranges in a cell
    widths = [max(1.0, (high - low) / each) for low, high in zip(lows, [*lows[1:], (top or 0) + 1], strict=True)]
    x = F.col(id_col)
    cell = F.greatest(F.lit(1), F.size(F.filter(F.array(*map(F.lit, lows)), lambda low: low <= x)))
    at = lambda some: F.element_at(F.array(*(F.lit(float(v)) for v in some)), cell)
    within = F.floor((x.cast("double") - at(lows)) / at(widths))
    return cell.cast("long") * (1 << 40) + F.least(F.greatest(within, F.lit(0)), F.lit((1 << 40) - 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", span: int = 1024) -> DataFrame:
    """docs with _span, and a copy of the row that comes next in descending order of the id (after the last: the first)
    where that row lies in another span of ids; such copies have _own false. Within a span, rows sorted by falling id with the
    copies behind them are the rows in order, each followed by its next. Only the greatest id of each span is joined to the rows; spans
    are ranges of about as many ids, dense or not."""
    rows = docs.where(F.col(id_col).isNotNull())
    rows = rows.withColumn("_span", spans_of(rows, id_col, span))
    tops = rows.groupBy("_span").agg(F.max(id_col).alias("_top")).withColumn("_wide", F.floor(F.col("_span") / 4096))
    wide = tops.groupBy("_wide").agg(F.max("_top").alias("_wide_top"), F.max("_span").alias("_last"))
    order = Window.orderBy(F.desc("_wide"))  # one row for each cell and each 4 million ids
    wide = wide.select("_wide", F.coalesce(F.lead("_wide_top").over(order), F.first("_wide_top").over(order)).alias("_after"))
    tops = tops.join(wide, "_wide").select("_span", F.coalesce(F.lead("_top").over(Window.partitionBy("_wide").orderBy(F.desc("_span"))), F.col("_after")).alias("_next"))
    copies = rows.join(tops.withColumnRenamed("_span", "_to"), F.col(id_col) == F.col("_next")).withColumn("_span", F.col("_to")).drop("_to", "_next")
    return rows.withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False)))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """For each row of docs with an id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; the edited text ends in the start of the next document instead of its own second half.

    Null texts count as empty; empty texts have empty fingerprints, which are like each other and no other; rows without an id have no
    place in the order and take no part; of rows with the same id each is followed by the other; other columns take no
    part. Texts are shuffled once, to spans of ids."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = lexicon(docs)
    in_order = Window.partitionBy("_span").orderBy(F.desc("_own"), F.desc("doc_id"), "_row")
    rows = with_next(docs).withColumn("_row", F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.coalesce(F.lead("text").over(in_order), F.lit("")), F.lit(1), half))
    rows = rows.withColumn("_edited", edited).withColumn("_nth", F.row_number().over(in_order)).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.encode("_edited", "UTF-8"), 256))
    marked = fingerprints(rows, ["_span", "_nth"], {"text": "_fp", "_edited": "_edited_fp"}, known, ["doc_id", "_own", "n_chars", "edited_sha256"])
    near_next = likeness(F.col("_fp"), F.lead("_fp").over(Window.partitionBy("_span").orderBy("_nth")))
    return marked.withColumn("near_next", near_next).where("_own").select("doc_id", "n_chars", "edited_sha256", as_text(F.col("_fp")).alias("fingerprint"), as_text(F.col("_edited_fp")).alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), "near_next")
