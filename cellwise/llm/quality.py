"""Operator 10: quality rules with adaptive thresholds, in DataFrame functions only.

The base counts are taken inside the row with array functions; no words are exploded or shuffled.
Each ratio's distribution is kept as an integer histogram whose buckets hold the five leading bits
of the value: a mergeable quantile sketch with a relative error below 1/16, whose parts add up in any
order. The sketch of a (lang, source) is drawn towards that of its language, and this one towards that of
everything, by the weight of ``PRIOR`` documents of the wider group: few documents lean on the others,
many speak for themselves, and nothing is switched at some size. The fences of a group are Tukey's,
``FENCE`` spreads outside its quartiles. The spread is the distance of the quartiles, and at least the
resolution that ``RATIOS`` states for the ratio: where most values are equal, both quartiles meet and
would reject everything else. So each limit moves with its group's quartiles; no value is a cutoff.

Null texts have no words, and fail the base rule. Null lang or source form a group of their own, the same
as empty ones. Very long texts are counted whole. Rows that repeat a doc_id each get a row; equal texts of
a group are judged alike. Other columns are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only

PRIOR, FENCE = 100, 3
#: Ratios that are judged: name -> (numerator, denominator, scale, resolution, has a lower fence).
RATIOS = {
    "word_len": ("word_chars", "n_words", 100, 10, True),
    "symbols": ("n_symbols", "n_words", 1000, 40, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 120, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
}
_BLANK = " \t\n\x0b\x0c\r"


def base_counts(docs: DataFrame) -> DataFrame:
    """The contract's counts; ``docs`` needs doc_id, lang, source and text."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, doc_id="long", lang="string", source="string", text="string")
    rows = rows.withColumn("text", text).withColumn("bare", F.btrim("text", F.lit(_BLANK)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    rows = rows.withColumn("words", F.when(F.length("bare") > 0, F.split("bare", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    after = lambda i, k: F.get("words", i + k)
    hashes = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, after(i, 1), after(i, 2))), 1, F.greatest(F.size("words") - 2, F.lit(1)))
    rows = rows.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > 3, hashes).alias("h"),
    )
    rows = rows.withColumn("ordered", F.sort_array("h"))
    rows = rows.withColumn("again", F.array_distinct(F.filter("ordered", lambda x, i: x.eqNullSafe(F.get("ordered", i - 1)))))
    # Few repeated windows: look each up. Many: sort the windows with their places instead.
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("sorted", F.when(F.size("again") > 16, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get("sorted", j)["h"].eqNullSafe(F.get("sorted", k)["h"])
    many = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get("sorted", j)["i"]))
    rows = rows.withColumn("starts", F.when(F.size("again") > 16, many).when(F.size("again") > 0, few))
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda n, k: n + k,
    )
    return rows.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(0).cast("long")).drop("h", "ordered", "again", "sorted", "starts")


def bucket(value: Column) -> Column:
    """The value with all but its five leading bits cleared."""
    bits = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def ratio(name: str) -> Column:
    over, under, scale, _, _ = RATIOS[name]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * scale / F.col(under))).otherwise(0).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket) -> n, over the rows that pass the base rule."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(ratio(r)).alias("bucket")) for r in RATIOS]))
    return (
        counts.where(~F.col("base_failed")).select("lang_key", "source_key", cells.alias("cell"))
        .groupBy("lang_key", "source_key", "cell.ratio", "cell.bucket").agg(F.count("*").alias("n"))
    )


def _drawn(own: DataFrame, wide: DataFrame, keys: list[str], wide_keys: list[str]) -> DataFrame:
    """Sketches of the groups ``keys``, each with the weight of PRIOR documents of its wider group added.

    Whole numbers: n * (total of the wider sketch) + PRIOR * (n of the wider one). All ratios of a group have one total.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    totals = wide.groupBy(*wide_keys, "ratio").agg(F.sum("n").cast("decimal(38,0)").alias("wide_total"))
    wide = wide.join(totals, [*wide_keys, "ratio"]).withColumnRenamed("n", "wide_n")
    every = own.select(*keys, "ratio").distinct().join(wide, [*wide_keys, "ratio"])
    mixed = every.join(own, [*keys, "ratio", "bucket"], "left")
    return mixed.select(*keys, "ratio", "bucket", (F.coalesce(big("n"), F.lit(0).cast("decimal(38,0)")) * F.col("wide_total") + PRIOR * big("wide_n")).cast("decimal(38,0)").alias("n"))


def fences(cells: DataFrame) -> DataFrame:
    """Per (lang, source) the fences of each ratio, from merged sketches.

    A sketch has a few hundred buckets a ratio at most, whatever the corpus; what is joined and sorted
    here are sketches.
    """
    everything = cells.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    langs = cells.groupBy("lang_key", "ratio", "bucket").agg(F.sum("n").alias("n"))
    groups = _drawn(cells, _drawn(langs, everything, ["lang_key"], []), ["lang_key", "source_key"], ["lang_key"])
    each = Window.partitionBy("lang_key", "source_key", "ratio")
    ranked = groups.withColumn("upto", F.sum("n").over(each.orderBy("bucket"))).withColumn("total", F.sum("n").over(each))
    quart = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    least = F.create_map(*[F.lit(x) for r, (_, _, _, spread, _) in RATIOS.items() for x in (r, spread)])[F.col("ratio")]
    per = ranked.groupBy("lang_key", "source_key", "ratio").agg(quart(1).alias("q1"), quart(3).alias("q3"))
    per = per.withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), least.cast("long")))
    out = []
    for name in RATIOS:
        own = F.col("ratio") == name
        out.append(F.max(F.when(own, F.col("q3") + FENCE * F.col("spread"))).alias(f"{name}_hi"))
        out.append(F.max(F.when(own, F.col("q1") - FENCE * F.col("spread"))).alias(f"{name}_lo"))
    return per.groupBy("lang_key", "source_key").agg(*out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, the base verdict and the adaptive verdict for every row of ``docs``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keyed = base_counts(docs).withColumn("base_failed", failed)
    keyed = keyed.withColumn("lang_key", F.coalesce("lang", F.lit(""))).withColumn("source_key", F.coalesce("source", F.lit("")))
    counts = cut(keyed.drop("lang", "source"), "quality-counts")
    cells = cut(sketches(counts), "quality-sketches")
    # One row a group: its size is read before a way to join it is chosen, and a hot group is split.
    table = cut(fences(cells), "quality-fences")
    rows = counts.join(table, ["lang_key", "source_key"], "left")
    fine = F.lit(True)
    for name, (_, _, _, _, lower) in RATIOS.items():
        fine = fine & F.coalesce(ratio(name) <= F.col(f"{name}_hi"), F.lit(True))
        if lower:
            fine = fine & F.coalesce(ratio(name) >= F.col(f"{name}_lo"), F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"))
