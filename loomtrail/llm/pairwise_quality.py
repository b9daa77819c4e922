"""A quality score from preference pairs: Bradley-Terry strengths that are linear in a document's features.

Features are ratios of counts, made by one projection of built-in functions. A pair is a document labelled 1 and one
labelled 0; the strength's weights minimise the logistic loss of the feature differences of 60,000 pairs drawn at random
from the labelled rows (``pairs``), so the fit does not grow with their square. The threshold is the
quantile of the training strengths at the share of label 0, and a document's score is a logistic function of its
distance from the threshold, at which it is ``CUT``.

Labels come from at most ``most`` rows (those of least hash of doc_id), so the fit on the driver is bounded; labels of
documents whose crc32(doc_id) is divisible by 5 are never used. Documents with several labels count by their mean; null
labels and ids are left out of the fit. With one class of labels or none every strength is 0 and every score ``CUT``.
Null and empty texts have features of 0 and are scored. Rows are scored one by one, so repeated rows and ids are fine;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm.quality_rules import measure, settled

CUT = 0.3
FOLDS = 5

#: Counted matches of each pattern, as a share of the words or the characters.
PATTERNS = {"symbol": r"[#*$%&|<>]", "digit": r"[0-9]", "upper": r"[A-ZÀ-ÖØ-Þ]", "loud": r"[!?]", "comma": r"[.,;:]", "shout": r"[A-ZÀ-ÖØ-Þ]{2,}", "bar": r" \| "}


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the array column ``__q_x``; each feature is a share or the logarithm of a count."""
    names, text = df.columns, F.coalesce(df[text_col].cast("string"), F.lit(""))
    df = df.withColumns({f"__q_{k}": F.regexp_count(text, F.lit(v)).cast("double") for k, v in PATTERNS.items()} | {"__q_kinds": F.size(F.array_distinct(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"))).cast("double")})
    df = measure(df, df[text_col])

    def share(count: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(count) / F.col(of)).otherwise(0.0)

    shares = [share(f"__q_{k}", "__q_n_words") for k in PATTERNS] + [share(f"__q_{c}", f"__q_{of}") for c, of in (("n_stop_words", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("kinds", "n_words"), ("word_chars", "n_words"))]
    x = [F.least(c, F.lit(20.0)) for c in shares] + [F.sqrt(c) for c in shares[:8]] + [F.log1p(F.col("__q_n_words").cast("double"))]
    return df.select(*names, F.array(*[c.cast("double") for c in x]).alias("__q_x"))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, penalty: float = 1e-3, steps: int = 30, seed: int = 5) -> dict:
    """Weights by Newton's method over random pairs of a document labelled 1 and one labelled 0."""
    good, bad = np.flatnonzero(y >= 0.5), np.flatnonzero(y < 0.5)
    if not len(good) or not len(bad):
        return {"w": [0.0] * (x.shape[1] if x.ndim == 2 else 1), "mean": 0.0, "at": 0.0, "scale": 1.0}
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = penalty * w - d.T @ p / pairs
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    at = float(np.quantile(strength, len(bad) / len(y)))
    w = w / np.where(spread > 0, spread, 1.0)
    return {"w": w.tolist(), "mean": float(x.mean(axis=0) @ w), "at": at, "scale": 1.0}


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, label_col: str = "quality") -> dict:
    """The model from a bounded sample of labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "__q_x", "y").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(np.array(rows["__q_x"].tolist(), dtype=float).reshape(len(rows), -1), rows["y"].to_numpy(float))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added (or replaced); the weights are literals of one projection."""
    terms = [F.element_at("__q_x", i + 1) * w for i, w in enumerate(model["w"])]
    strength = sum(terms[1:], terms[0]) - model["mean"] - model["at"]
    odds = strength * model["scale"] + math.log(CUT / (1 - CUT))
    value = settled(1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0)))))
    return features(docs).withColumn(name, value).drop("__q_x")


def predicted(name: str = "score") -> Column:
    return (F.col(name) >= CUT).cast("int")


def kept_rows(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are predicted as good, with their columns, whatever their names but ``__q_...``."""
    return score(docs, model, "__q_score").where(predicted("__q_score") == 1).select(*docs.columns)


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted().alias("predicted"))
