"""Search by patches: a coarse search on aggregated descriptors, then matching and geometry for the candidates only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import vectors as V
from mosaiq.operators.sequential import ransac
from mosaiq.operators.similarity import knn, residuals, vector_sums


def aggregated(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``image_id, vector``: unit sum of the residuals of an image's descriptors to their nearest centroids."""
    g = vector_sums(residuals(points, "image_id", "vector", centroids), "key", "residual")
    return g.select(F.col("key").alias("image_id"), V.normalise("sum").alias("vector"))


def match(a: np.ndarray, b: np.ndarray, ratio: float = 0.8) -> np.ndarray:
    """Mutual nearest descriptors, (row of a, row of b), whose distance is under ``ratio`` of the second nearest's; with
    one candidate the second is infinitely far."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), int)
    d = np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0))
    best = d.argmin(axis=1)
    first = d[np.arange(len(a)), best]
    second = np.partition(d, 1, axis=1)[:, 1] if len(b) > 1 else np.full(len(a), np.inf)
    ok = (first < ratio * second) & (d.argmin(axis=0)[best] == np.arange(len(a)))
    return np.c_[np.flatnonzero(ok), best[ok]]


def patch_search(queries: DataFrame, gallery: DataFrame, centroids: np.ndarray, k: int = 10, ratio: float = 0.8, least: int = 15) -> DataFrame:
    """``query_image, image_id, matches, inliers, score`` of tables (image_id, x, y, vector): the 4k nearest images by
    their aggregates, mutual matches, a homography; score = inlier share x min(matches / 100, 1). Images with fewer than
    ``least`` matches are left out. An image's key points are few by nature; candidates are 4k for each query image."""
    q = aggregated(queries, centroids).select(F.col("image_id").alias("qid"), F.col("vector").alias("qv"))
    near = knn(q, aggregated(gallery, centroids), 4 * k, gid="image_id").select("qid", "id")
    pts = lambda df, side: df.select("image_id", F.lit(side).alias("side"), *[F.col(c).cast("double") for c in "xy"], F.col("vector").cast("array<double>"))
    a = near.join(pts(queries, 0).withColumnRenamed("image_id", "qid"), "qid")
    b = near.join(pts(gallery, 1).withColumnRenamed("image_id", "id"), "id")

    def verify(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["side", "x", "y"])
        l, r = p[p.side == 0], p[p.side == 1]
        m = match(np.stack(l.vector.to_list()), np.stack(r.vector.to_list()), ratio) if len(l) and len(r) else np.zeros((0, 2), int)
        row = [int(p.qid.iloc[0]), int(p.id.iloc[0]), len(m), 0, 0.0]
        if len(m) >= least:
            _, ok = ransac(l[["x", "y"]].to_numpy()[m[:, 0]], r[["x", "y"]].to_numpy()[m[:, 1]])
            row[3:] = int(ok.sum()), round(float(ok.mean()) * min(len(m) / 100, 1.0), 6)
        return pd.DataFrame([row], columns=["query_image", "image_id", "matches", "inliers", "score"])

    both = a.select("qid", "id", "side", "x", "y", "vector").unionByName(b.select("qid", "id", "side", "x", "y", "vector"))
    out = both.groupBy("qid", "id").applyInPandas(verify, "query_image bigint, image_id bigint, matches bigint, inliers bigint, score double")
    return out.where(F.col("matches") >= least)
