"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int):
    """crc32 of a column's text form, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, by: str | None = None) -> tuple[list[tuple], dict[int, int]]:
    """At most `rows` (label, lang, text) of labelled documents outside the held-out fold, half of each class, and each class's share of all rows.

    The rows with the smallest hash of doc_id are taken, so the sample is the same in every run; their
    texts are whole, whatever their length. Null doc_ids, labels and texts are left out; of rows that
    repeat a doc_id the smallest text is taken.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for k in (0, 1):
        half = usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        picked = half if picked is None else picked.unionByName(half)
    picked = picked.dropDuplicates(["doc_id"])
    lang = F.min(F.coalesce(F.col(by).cast("string"), F.lit(""))) if by else F.lit("")
    texts = docs.where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), lang.alias("lang"), F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["label"], r["lang"], r["text"]) for r in texts.collect())
    return [x[1:] for x in found], counts


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through weighted points (Newton steps, a little ridge)."""
    scale = max(float(np.abs(x).std()), float(np.abs(x).mean()), 1e-9)
    theta = newton(lambda at: platt_sums(x / scale, y, weight, at))
    return float(theta[0] / scale), float(theta[1])


def platt_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of some points' loss; those of all points are their sums."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
    return design.T @ (weight * (p - y)), (design * (weight * p * (1 - p))[:, None]).T @ design


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int = 60) -> np.ndarray:
    theta = np.zeros(2)
    for _ in range(rounds):
        gradient, curve = sums(theta)
        step = np.linalg.solve(curve + 1e-2 * np.eye(2), gradient + 1e-2 * theta)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return theta


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample's classes their shares of all labelled rows."""
    total = sum(counts.values()) or 1
    of = {k: counts.get(k, 0) / total * len(y) / max(1, int((y == k).sum())) for k in (0, 1)}
    return np.where(y == 1, of[1], of[0])
