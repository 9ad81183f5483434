"""Quality scores learned from preferences: a Bradley-Terry model over text features.

A preference pair is a document labelled 1 and one labelled 0. The model gives each document the strength
s = w . features and says that the first is preferred with probability sigmoid(s_1 - s_0); w minimises the
logistic loss on feature differences. The cut between good and bad is the quantile of the training documents'
strengths at their share of label 0, and the score is sigmoid(s - cut), so 0.5 lies at the cut.

The fit uses at most SAMPLE labelled rows, those of the smallest hash of their id, and PAIRS random pairs of
them; features and scores cover every document.

Defined results: a null text counts as empty and is scored like an empty one. Without both labels among the
training rows there are no pairs: every score is then 0.5 (or 0.25 or 0.75, if only label 0 or 1 occurs). Null
labels are ignored. Repeated rows get the same score; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.llm.text_stats import LONGS, stats_of, text_stats
from raggedlake.plans.session import materialize, table

SAMPLE, PAIRS, SEED, PENALTY = 20_000, 40_000, 7, 1e-3

FEATURES = {
    "f_len": "least(ln(1 + n_words), 7) / 7",
    "f_empty": "cast(n_words = 0 as double)",
    "f_few": "cast(n_words < 20 as double)",
    "f_symbol": "least(n_symbols / greatest(word_chars, 1), 0.3) * 3",
    "f_symbol_any": "least(n_symbols / greatest(n_words, 1), 0.5) * 2",
    "f_upper": "n_upper / greatest(word_chars, 1)",
    "f_digit": "least(n_digits / greatest(word_chars, 1), 0.3) * 3",
    "f_mark": "least(n_stops / greatest(n_words, 1), 2)",
    "f_repeat": "n_repeat_words / greatest(n_words, 1)",
    "f_dup_line": "n_dup_lines / greatest(n_lines, 1)",
    "f_distinct": "n_distinct / greatest(n_words, 1)",
    "f_distinct_log": "ln(1 + n_distinct) / greatest(ln(1 + n_words), 1)",
    "f_short": "n_short / greatest(n_words, 1)",
    "f_word": "least(word_chars / greatest(n_words, 1), 20) / 10",
    "f_line": "least(ln(1 + n_words / greatest(n_lines, 1)), 6) / 6",
    "f_wide": "n_bytes / greatest(word_chars + n_words, 1)",
}


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and cut of the Bradley-Terry model, by Newton steps on the pairs' feature differences."""
    good, bad = x[y == 1], x[y == 0]
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w, 0.0 if not len(x) else (1.0986 if len(bad) else -1.0986)
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + penalty / 2 * v @ v
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + penalty * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step, t, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    s = np.sort(x @ w)
    k = len(bad)  # the quantile at the share of label 0
    return w, float((s[k - 1] + s[k]) / 2)


def known_labels(labels: DataFrame, parts: int, part: int, sample: int, id_col: str, label_col: str) -> DataFrame:
    """(id, _y): the labels that may be used, at most sample of them."""
    known = labels.select(F.col(id_col), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(id_col, parts, part))
    return known.orderBy(F.xxhash64(id_col), "_y").limit(sample)


def fit(feats: DataFrame, sample: int, id_col: str) -> tuple[np.ndarray, float]:
    """Weights and cut from a table of ids, _y and FEATURES."""
    rows = feats.orderBy(id_col, "_y", *FEATURES).limit(2 * sample).toPandas()
    return fit_pairs(rows[list(FEATURES)].to_numpy(float).reshape(len(rows), len(FEATURES)), rows["_y"].to_numpy())


def score(w: np.ndarray, cut: float, of=F.col) -> Column:
    """The score from feature columns; of makes a column of a feature's name."""
    s = F.lit(-cut)
    for k, v in zip(FEATURES, w):
        s = s + of(k) * float(v)
    return 1 / (1 + F.exp(-s))


def features_of(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    return text_stats(docs, keep, text_col).select(*keep, *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of rows with crc32(id) mod parts = part aren't used."""
    feats = materialize(features_of(docs, [id_col], text_col), "features")
    model = fit(feats.join(F.broadcast(known_labels(labels, parts, part, sample, id_col, label_col)), id_col), sample, id_col)
    out = feats.select(F.col(id_col), F.coalesce(held_out(id_col, parts, part), F.lit(False)).alias("held_out"), score(*model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs whose score is 0.5 or more, with all their columns.

    The texts are read twice, first for the labelled sample alone, and neither shuffled nor written.
    """
    known = known_labels(labels, parts, part, sample, id_col, label_col)
    sampled = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(known), id_col)
    model = fit(features_of(sampled, [id_col, "_y"], "_text"), sample, id_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), stats_of(F.col(text_col)).alias("_stats"))
    rows = rows.select("_row", *(F.col(f"_stats.{c}").alias(c) for c in LONGS))
    return rows.where(score(*model, of=lambda k: F.expr(FEATURES[k]).cast("double")) >= 0.5).select("_row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
