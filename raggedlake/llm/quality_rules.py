"""Quality rules with adaptive thresholds instead of fixed cutoffs.

Each measure's distribution is kept per language and source as a sketch of logarithmic buckets (relative error
ALPHA): a table of (language, source, measure, bucket, count). Sketches merge by adding counts, so the result is
the same for any partitioning and order, and a language's or the whole corpus's sketch is the sum of its
sources'. A measure's limit is its group's median plus REACH times the spread between the median and the lower
QUANTILE, the spread being at least a floor. Median and quantile are weighed means of the group's own and of its
language's, with n and WEIGHT as weights for a group of n documents, and a language's likewise of its own and of the corpus's: so
a small group leans on what is known of the larger one, and no size makes a limit jump. The limits are then joined
to the documents: by broadcast up to GROUPS groups, beyond that by a shuffle with each group dealt out over SALTS parts.

Texts go to Python once a pass, only counts come back, and no text is shuffled or written. The operator makes one pass;
keep_good() makes two, as its limits must be known before the rows pass through.

Defined results: a null text has no words and fails the base rules. Null languages and sources are groups of
their own. Every row gets a verdict of its own, repeated rows too; an empty table gives an empty result. Only
the named columns are read, so further columns may have any name; a column of keep that has the name of a result is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raggedlake.llm.text_stats import LONGS, stats_of, text_stats
from raggedlake.plans.session import materialize, prepare_workers, table

#: Relative error of the sketches.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Values below this are one bucket, which stands for 0.
LEAST_VALUE = 1e-4
QUANTILE, REACH, WEIGHT = 0.1, 6.0, 200
#: Groups whose limits are broadcast (a row of twelve numbers each), and the parts of a group beyond that.
GROUPS, SALTS = 50_000, 16
#: Measure: (expression over the counts, least spread, whether low values are rejected too).
MEASURES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 0.01, False),
    "upper_share": ("n_upper / greatest(word_chars, 1)", 0.05, False),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.05, False),
    "mark_share": ("n_stops / greatest(word_chars, 1)", 0.02, False),
    "digit_share": ("n_digits / greatest(word_chars, 1)", 0.02, False),
    "word_length": ("word_chars / greatest(n_words, 1)", 0.5, True),
}
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES]


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value of 0 or more; 0 below LEAST_VALUE, which buckets start from."""
    return F.when(value < LEAST_VALUE, F.lit(0)).otherwise(F.ceil(F.ln(value / LEAST_VALUE) / math.log(GAMMA)).cast("int") + 1)


def bucket_value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(LEAST_VALUE) * F.pow(F.lit(GAMMA), (b - 1).cast("double")) * 2 / (1 + GAMMA))


def sketch(measured: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, b, n): the mergeable sketch of each measure in each group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in measures])).alias("x")
    return measured.select(*keys, pairs).groupBy(*keys, "x.measure", "x.b").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """(keys, measure, n_docs, one column a point): the value at rank ceil(p * n) of each group's sketch."""
    by = Window.partitionBy(*keys, "measure")
    upto = sketches.withColumn("upto", F.sum("n").over(by.orderBy("b"))).withColumn("n_docs", F.sum("n").over(by))
    cols = [bucket_value(F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n_docs") * p), F.lit(1)), F.col("b")))).alias(name) for name, p in points.items()]
    return upto.groupBy(*keys, "measure", "n_docs").agg(*cols)


def limits(measured: DataFrame, lang: str = "lang", source: str = "source", quantile: float = QUANTILE, reach: float = REACH, weight: float = WEIGHT) -> DataFrame:
    """(lang, source, lo_<measure>, hi_<measure> ...): the limits of each group, one row a group. No null groups."""
    points = {"low": quantile, "mid": 0.5}
    fine = sketch(measured, [lang, source], list(MEASURES))
    by_lang = merge(fine, [lang])
    wide = quantiles(fine, [lang, source], points)
    of_lang = quantiles(by_lang, [lang], points).select(lang, "measure", *(F.col(c).alias(f"{c}_l") for c in ("n_docs", "low", "mid")))
    of_all = quantiles(merge(by_lang, []), [], points).select("measure", *(F.col(c).alias(f"{c}_a") for c in ("low", "mid")))

    def weighed(c: str) -> Column:
        of_language = (F.col("n_docs_l") * F.col(f"{c}_l") + weight * F.col(f"{c}_a")) / (F.col("n_docs_l") + weight)
        return (F.col("n_docs") * F.col(c) + weight * of_language) / (F.col("n_docs") + weight)

    floor = F.element_at(F.create_map(*[F.lit(x) for m, (_, f, _) in MEASURES.items() for x in (m, f)]), F.col("measure"))
    both = F.element_at(F.create_map(*[F.lit(x) for m, (_, _, b) in MEASURES.items() for x in (m, b)]), F.col("measure"))
    rows = wide.join(of_lang, [lang, "measure"]).join(of_all, ["measure"])  # of_all: a row a measure
    rows = rows.withColumn("mid0", weighed("mid")).withColumn("spread", F.greatest(F.col("mid0") - weighed("low"), floor))
    rows = rows.select(lang, source, "measure", (F.col("mid0") + reach * F.col("spread")).alias("hi"), F.when(both, F.col("mid0") - reach * F.col("spread")).otherwise(F.lit(-1.0)).alias("lo"))
    return rows.groupBy(lang, source).agg(*[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in MEASURES for c in ("hi", "lo")])


def group(c: str) -> Column:
    """A group's name that isn't null; no string stands for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def measured(counts: DataFrame) -> DataFrame:
    """Adds the measures and base_failed to counts."""
    rows = counts.withColumns({m: F.expr(e).cast("double") for m, (e, _, _) in MEASURES.items()})
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def group_limits(narrow: DataFrame) -> DataFrame:
    """limits() of the rows that pass the base rules, by _g1 and _g2, written to the shared folder."""
    return materialize(limits(narrow.where(~F.col("base_failed")), "_g1", "_g2"), "limits")


def judged(rows: DataFrame, allowed: DataFrame, groups: int = GROUPS, salts: int = SALTS) -> DataFrame:
    """rows with kept; those of a group without limits (all of it failed the base rules) aren't."""
    keys = ["_g1", "_g2"]
    if allowed.count() <= groups:
        allowed = F.broadcast(allowed)
    else:
        keys = [*keys, "_salt"]
        rows = rows.withColumn("_salt", F.floor(F.rand(1) * salts).cast("int"))
        allowed = allowed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(False))
    return rows.join(allowed, keys, "left").withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row a document: id, counts, base_failed, kept, and the measures; keep names further (small) columns to return."""
    extra = [c for c in dict.fromkeys(keep or []) if c not in (id_col, *RESULTS)]
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), group(lang_col).alias("_g1"), group(source_col).alias("_g2"), *(F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)))
    base = materialize(measured(text_stats(rows, [id_col, "_g1", "_g2", *(f"_x{i}" for i in range(len(extra)))], "_text")), "stats")
    out = judged(base, group_limits(base))
    return out.select(id_col, *RESULTS[:-len(MEASURES)], *MEASURES, *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns."""
    groups = {"_g1": group(lang_col), "_g2": group(source_col)}
    narrow = text_stats(docs.select(F.col(text_col).alias("_text"), *(v.alias(k) for k, v in groups.items())), ["_g1", "_g2"], "_text")
    allowed = group_limits(materialize(measured(narrow), "stats"))
    prepare_workers(docs.sparkSession)
    rows = docs.withColumns(groups).select("_g1", "_g2", F.struct(*docs.columns).alias("_row"), stats_of(F.col(text_col)).alias("_stats"))
    rows = measured(rows.select("_g1", "_g2", "_row", *(F.col(f"_stats.{c}").alias(c) for c in LONGS)))
    return judged(rows, allowed).where("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
