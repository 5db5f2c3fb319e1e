"""Algorithms whose result depends on the order of rows, as kernels within a group.

Each runs over groups that are bounded by nature (the boxes of one image, the faces of one person's gallery): grouped
maps with Arrow batches. Input order never matters: every kernel sorts by its own unique order first. Null scores or
coordinates leave a row out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou_matrix(b: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = b[:, 0], b[:, 1], b[:, 0] + b[:, 2], b[:, 1] + b[:, 3]
    w = np.clip(np.minimum(x2[:, None], x2) - np.maximum(x1[:, None], x1), 0, None)
    h = np.clip(np.minimum(y2[:, None], y2) - np.maximum(y1[:, None], y1), 0, None)
    both = w * h
    area = b[:, 2] * b[:, 3]
    union = area[:, None] + area - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def greedy_keep(close: np.ndarray, most: int | None = None) -> np.ndarray:
    """Rows in order: kept unless close to one that is kept already."""
    free = np.ones(len(close), bool)
    kept = np.zeros(len(close), bool)
    for k in range(len(close)):
        if free[k]:
            kept[k] = True
            free &= ~close[k]
            if most and kept.sum() >= most:
                break
    return kept


def per_group(df: DataFrame, group: str, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` on the columns (numpy arrays) of every group, many groups a call: rows are shuffled by group, sorted, and
    streamed, so small groups cost no call between Spark and Python of their own. ``run`` gives a selection of rows (an
    index array), or that and new values for the last column. Rows with a null are left out."""
    rows = df.select(group, *columns).dropna().repartition(group).sortWithinPartitions(group)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy(zero_copy_only=False)
            if held and held[-1].column(0)[-1].as_py() == g[-1]:
                held.append(b)  # the whole batch goes on with the group that is held
                continue
            cut = int(np.searchsorted(g, g[-1]))
            yield from done([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        yield from done(held)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        cols = [t.column(k).to_numpy() for k in range(t.num_columns)]
        at = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1], True])
        take, values = [], []
        for s, e in zip(at[:-1], at[1:]):
            out = run(*[c[s:e] for c in cols[1:]])
            pick, val = out if isinstance(out, tuple) else (out, None)
            take.append(pick + s)
            values.append(val)
        pick = np.concatenate(take)
        names = [n.split()[0] for n in schema.split(", ")]
        res = [pa.array(cols[t.schema.names.index(n)][pick]) for n in names]
        if values[0] is not None:
            res[-1] = pa.array(np.concatenate(values))
        yield pa.RecordBatch.from_arrays(res, names)

    return rows.mapInArrow(stream, schema)


def _kind(df: DataFrame, *names: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def hard_nms(df: DataFrame, group: str, ident: str, score: str, threshold: float = 0.4) -> DataFrame:
    """``group, ident, score``: boxes x, y, w, h in the order of score; a box whose overlap with a kept one is over the
    threshold is dropped."""

    def run(i, s, x, y, w, h):
        o = np.lexsort((i, -s))
        return o[greedy_keep(iou_matrix(np.stack([x, y, w, h], 1).astype(float)[o]) > threshold)]

    return per_group(df, group, [ident, score, "x", "y", "w", "h"], run, _kind(df, group, ident, score))


def cell_nms(df: DataFrame, group: str, ident: str, width: float, height: float, threshold: float = 0.5, quota: int | None = None) -> DataFrame:
    """``group, ident``: boxes in the order of their cell in a 3 x 3 grid, larger ones first; then greedily as above."""

    def run(i, x, y, w, h):
        col = np.clip(((x + w / 2) / width * 3).astype(int), 0, 2)
        row = np.clip(((y + h / 2) / height * 3).astype(int), 0, 2)
        o = np.lexsort((i, -(w * h), row * 3 + col))
        return o[greedy_keep(iou_matrix(np.stack([x, y, w, h], 1).astype(float)[o]) > threshold, quota)]

    return per_group(df, group, [ident, "x", "y", "w", "h"], run, _kind(df, group, ident))


def soft_nms(df: DataFrame, group: str, ident: str, score: str, start: float = 0.3, floor: float = 0.1) -> DataFrame:
    """``group, ident, score``: the best box is taken; the scores of boxes that overlap it by more than ``start`` are
    lowered by their overlap; boxes under ``floor`` go; and again. Scores have 6 decimals."""

    def run(i, s, x, y, w, h):
        o = np.argsort(i, kind="stable")
        s, over = s[o].astype(float), iou_matrix(np.stack([x, y, w, h], 1).astype(float)[o])
        left = s >= floor
        taken = np.zeros(len(s), bool)
        while left.any():
            k = np.flatnonzero(left)[np.argmax(s[left])]
            taken[k], left[k] = True, False
            hit = left & (over[k] > start)
            s[hit] *= 1 - over[k][hit]
            left &= s >= floor
        return o[taken], np.round(s[taken], 6)

    return per_group(df, group, [ident, score, "x", "y", "w", "h"], run, _kind(df, group, ident) + f", {score} double")


def point_nms(df: DataFrame, group: str, ident: str, score: str, radius: float = 4.0, most: int = 1024) -> DataFrame:
    """``group, ident, score``: points that no strictly better point lies within ``radius`` of; the best ``most``."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values([score, ident], ascending=[False, True])
        xy, s = p[["x", "y"]].to_numpy(float), p[score].to_numpy(float)
        near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= radius**2
        beaten = (near & (s[None, :] > s[:, None])).any(axis=1)
        return p.loc[~beaten, [group, ident, score]].head(most)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, ident, score, "x", "y").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {ident} {kinds[ident]}, {score} {kinds[score]}")


#: Pose buckets of a gallery, in the order in which they fill it.
BUCKETS = ("frontal", "left_profile", "right_profile")


def select_prototypes(df: DataFrame, alike: float = 0.90, most: int = 8) -> DataFrame:
    """``person_id, face_id, prototype_type, place`` of rows (person_id, face_id, quality, kind, vector): in every pose
    bucket by quality, without faces that are alike to a chosen one of the bucket; then the first ``most`` in the order
    of buckets."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in BUCKETS:
            q = p[p.kind == kind].sort_values(["quality", "face_id"], ascending=[False, True])
            if len(q):
                v = np.stack(q.vector.to_list()).astype(float)
                out.append(q[greedy_keep(np.round(v @ v.T, 6) >= alike)])
        r = pd.concat(out).head(most) if out else p.head(0)
        return pd.DataFrame({"person_id": r.person_id, "face_id": r.face_id, "prototype_type": r.kind, "place": np.arange(1, len(r) + 1)})

    cols = df.select("person_id", "face_id", "quality", "kind", "vector").where("person_id is not null and kind is not null and quality is not null")
    return cols.groupBy("person_id").applyInPandas(run, "person_id bigint, face_id bigint, prototype_type string, place bigint")


def fill_prototypes(df: DataFrame, alike: float = 0.90, each: int = 2, most: int = 8) -> DataFrame:
    """As ``select_prototypes``, but alike across buckets too, at most ``each`` from a bucket, and then filled up with
    the best of the rest."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["quality", "face_id"], ascending=[False, True])
        v = np.stack(p.vector.to_list()).astype(float)
        close = np.round(v @ v.T, 6) >= alike
        free, chosen = np.ones(len(p), bool), []
        kinds = p.kind.to_numpy()
        for want, cap in [*((k, each) for k in BUCKETS), (None, most)]:
            for k in range(len(p)):
                if cap <= 0 or len(chosen) >= most:
                    break
                if free[k] and (want is None or kinds[k] == want):
                    chosen.append(k)
                    free &= ~close[k]
                    free[k] = False
                    cap -= 1
        r = p.iloc[chosen]
        return pd.DataFrame({"person_id": r.person_id, "face_id": r.face_id, "prototype_type": r.kind, "place": np.arange(1, len(r) + 1)})

    cols = df.select("person_id", "face_id", "quality", "kind", "vector").where("person_id is not null and kind is not null and quality is not null")
    return cols.groupBy("person_id").applyInPandas(run, "person_id bigint, face_id bigint, prototype_type string, place bigint")


def by_votes(threshold: float, margin: float, k: int) -> Callable:
    """The nearest ``k`` earlier faces vote with their scores; the best three clusters are compared by their best member; the
    first is joined if its score reaches the threshold and leads by the margin."""

    def choose(s: np.ndarray, ids: np.ndarray, own: np.ndarray, quality: np.ndarray, mine: float) -> int | None:
        votes: dict[int, float] = {}
        for j in np.lexsort((ids, -s))[:k]:
            votes[own[j]] = votes.get(own[j], 0.0) + s[j]
        top = sorted(votes, key=lambda c: (-votes[c], c))[:3]
        best = sorted(((s[own == c].max(), -c) for c in top), reverse=True)
        lead = best[0][0] - best[1][0] if len(best) > 1 else np.inf
        return -best[0][1] if best and best[0][0] >= threshold and lead >= margin else None

    return choose


def by_prototypes(threshold: float, margin: float, prototypes: int = 5, low: float = 0.5, penalty: float = 0.05, least: float = 0.1) -> Callable:
    """Clusters whose prototypes (their best faces) reach .8 of the threshold are looked at; of all their faces the one with
    the highest score times quality counts, by its score. Faces of low quality need a higher one, those under ``least``
    stay alone."""

    def choose(s: np.ndarray, ids: np.ndarray, own: np.ndarray, quality: np.ndarray, mine: float) -> int | None:
        if mine < least:
            return None
        best = []
        for c in np.unique(own):
            at = np.flatnonzero(own == c)  # by falling quality
            if s[at[:prototypes]].max() >= 0.8 * threshold:
                best.append((s[at[np.argmax(s[at] * quality[at])]], -c))
        best.sort(reverse=True)
        lead = best[0][0] - best[1][0] if len(best) > 1 else np.inf
        need = threshold + (penalty if mine < low else 0.0)
        return -best[0][1] if best and best[0][0] >= need and lead >= margin else None

    return choose


def by_nearest(threshold: float, k: int = 5) -> Callable:
    """Of the nearest ``k`` earlier faces the first one's cluster, if its score reaches the threshold."""

    def choose(s: np.ndarray, ids: np.ndarray, own: np.ndarray, quality: np.ndarray, mine: float) -> int | None:
        near = np.lexsort((ids, -s))[:k]
        return own[near[0]] if len(near) and s[near[0]] >= threshold else None

    return choose


def online_clusters(df: DataFrame, block: str, choose: Callable) -> DataFrame:
    """``block, face_id, cluster``: faces by falling quality, each sees the earlier ones and joins the cluster that
    ``choose`` gives, or starts one, named by it.

    The result depends on all earlier rows, so a block is one task: blocks must be bounded (a person's album, a day).
    The scalable mode with another meaning is connected components."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(["quality", "face_id"], ascending=[False, True])
        v = np.stack(p.vector.to_list()).astype(float) if len(p) else np.zeros((0, 1))
        ids, quality = p.face_id.to_numpy(), p.quality.to_numpy(float)
        own = np.full(len(p), -1, np.int64)
        for n in range(len(p)):
            got = choose(np.round(v[:n] @ v[n], 6), ids[:n], own[:n], quality[:n], quality[n]) if n else None
            own[n] = ids[n] if got is None else got
        return pd.DataFrame({block: p[block], "face_id": ids, "cluster": own})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(block, "face_id", "quality", "vector").groupBy(block).applyInPandas(run, f"{block} {kinds[block]}, face_id bigint, cluster bigint")


def chain_capture(df: DataFrame, pair: Column, centres: DataFrame, threshold: float = 0.75, alpha: float = 0.1) -> DataFrame:
    """``pair, step, captured, drift`` of rows (face_id, vector): the rows of each ``pair`` come one by one, by id, to a
    cluster that starts with the pair's centre in ``centres`` (pair, vector); a captured one moves the centre. Rows are
    streamed in order: a task holds one centre, however many rows a pair has. Pairs without a centre are left out."""
    starts = centres.select("pair", F.lit(None).cast("bigint").alias("face_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = df.select(pair.cast("bigint").alias("pair"), "face_id", F.col("vector").cast("array<double>").alias("vector")).where("pair is not null and face_id is not null and vector is not null")
    every = starts.unionByName(rows).repartition("pair").sortWithinPartitions("pair", F.asc_nulls_first("face_id"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c0, c, step = None, None, None, 0
        for b in batches:
            out = []
            for p, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                v = np.asarray(v, float)
                if i is None:
                    now, step = p, 0
                    c0 = c = v / np.linalg.norm(v)
                elif p == now:
                    hit = round(float(c @ v), 6) >= threshold
                    if hit:
                        c = (1 - alpha) * c + alpha * v
                        c /= np.linalg.norm(c)
                    step += 1
                    out.append((p, step, hit, round(1 - float(c0 @ c), 6)))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], ["pair", "step", "captured", "drift"])

    return every.mapInArrow(stream, "pair bigint, step bigint, captured boolean, drift double")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """3 x 3 matrix that takes src to dst in least squares; None if it isn't determined."""
    n = len(src)
    if n < 4:
        return None
    x, y, u, v = *src.T, *dst.T
    z, o = np.zeros(n), np.ones(n)
    a = np.r_[np.c_[x, y, o, z, z, z, -u * x, -u * y], np.c_[z, z, z, x, y, o, -v * x, -v * y]]
    h, _, rank, _ = np.linalg.lstsq(a, np.r_[u, v], rcond=None)
    return np.r_[h, 1.0].reshape(3, 3) if rank == 8 else None


def reprojection(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    q = np.c_[src, np.ones(len(src))] @ h.T
    w = np.where(np.abs(q[:, 2:]) < 1e-10, 1.0, q[:, 2:])
    return np.linalg.norm(q[:, :2] / w - dst, axis=1)


def ransac(src: np.ndarray, dst: np.ndarray, rounds: int = 100, pixels: float = 3.0, stop: float = 0.7, seed: int = 1):
    """Inliers of the best homography of four random pairs, refitted to its inliers if that isn't worse."""
    rng = np.random.default_rng(seed)
    best_h, best = None, np.zeros(len(src), bool)
    for _ in range(rounds):
        if len(src) < 4:
            break
        k = rng.choice(len(src), 4, replace=False)
        h = homography(src[k], dst[k])
        if h is None:
            continue
        ok = reprojection(h, src, dst) < pixels
        if ok.sum() > best.sum():
            best_h, best = h, ok
            if ok.mean() >= stop:
                break
    if best.sum() >= 4:
        h = homography(src[best], dst[best])
        if h is not None and (ok := reprojection(h, src, dst) < pixels).sum() >= best.sum():
            best_h, best = h, ok
    return best_h, best


def match_geometry(df: DataFrame, group: str, seed: int = 1) -> DataFrame:
    """``group, matches, inliers`` of point pairs (group, ident, x, y, u, v): RANSAC for each group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values("ident")
        _, ok = ransac(p[["x", "y"]].to_numpy(float), p[["u", "v"]].to_numpy(float), seed=seed)
        return pd.DataFrame({group: p[group].head(1), "matches": [len(p)], "inliers": [int(ok.sum())]}) if len(p) else pd.DataFrame({group: [], "matches": [], "inliers": []})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, "ident", "x", "y", "u", "v").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, matches bigint, inliers bigint")


def grey_figures(pixels: np.ndarray) -> tuple[float, float, float]:
    """Laplacian variance (4 neighbours), entropy of the histogram in bits, variance of the brightness in [0, 1]."""
    g = pixels.astype(float)
    lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] if min(g.shape) >= 3 else np.zeros(1)
    n = np.bincount(pixels.astype(np.uint8).ravel(), minlength=256) / max(1, pixels.size)
    n = n[n > 0]
    return float(lap.var()), float(-(n * np.log2(n)).sum()), float((g / 255).var())
