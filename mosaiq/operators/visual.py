"""Operators on images as pixels or bytes, with hooks for models.

No decoder and no model is needed here: a decoder is any function from bytes to a grey or colour numpy array, a model any
function from arrays to vectors. Both are given by the caller and made once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.operators.sequential import grey_figures
from mosaiq.sources.files import open_file


def image_figures(images: DataFrame, decode: Callable[[bytes], np.ndarray], ident: str = "path") -> DataFrame:
    """``ident, width, height, laplacian, blur_score, entropy, variance, colours, saturation``; figures are null where
    the bytes can't be decoded. Colours are counted up to 200 000."""
    kind = dict(images.dtypes)[ident]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data in zip(b[ident], b["content"]):
                try:
                    a = decode(data)
                except Exception:
                    a = None
                if a is None:
                    out.append((key, *[None] * 8))
                    continue
                rgb = a if a.ndim == 3 else np.repeat(a[..., None], 3, axis=2)
                lap, ent, var = grey_figures(rgb[..., :3].mean(axis=2))
                out.append((key, rgb.shape[1], rgb.shape[0], lap, min(1.0, lap / 100), ent, var, colours(rgb), saturation(rgb)))
            names = [ident, "width", "height", "laplacian", "blur_score", "entropy", "variance", "colours", "saturation"]
            yield pd.DataFrame(out, columns=names)

    schema = f"{ident} {kind}, width int, height int, laplacian double, blur_score double, entropy double, variance double, colours bigint, saturation double"
    return images.select(ident, "content").mapInPandas(run, schema)


def image_sizes(files: DataFrame, measure: Callable[[BinaryIO], tuple[int, int]], path: str = "path") -> DataFrame:
    """All columns of ``files`` and ``width, height``: what ``measure`` says of each file, 0 where it fails or the file
    can't be opened. It gets the opened file, not a row with its bytes, so files may be larger than a task's memory."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for p in b.column(names.index(path)).to_pylist():
                try:
                    with open_file(p) as f:
                        w, h = measure(f)
                    sizes.append((int(w), int(h)))
                except Exception:
                    sizes.append((0, 0))
            ends = [pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], [*names, "width", "height"])

    schema = files.selectExpr("*", "cast(0 as int) as width", "cast(0 as int) as height").schema
    return files.mapInArrow(run, schema)


def colours(rgb: np.ndarray, cap: int = 200_000) -> int:
    p = rgb[..., :3].reshape(-1, 3).astype(np.int64)
    return int(min(cap, len(np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]))))


def saturation(rgb: np.ndarray) -> float:
    """Mean HSL saturation of the pixels that have a colour."""
    p = rgb[..., :3].reshape(-1, 3) / 255.0
    hi, lo = p.max(axis=1), p.min(axis=1)
    on = hi > lo
    if not on.any():
        return 0.0
    light = (hi + lo)[on] / 2
    return float(((hi - lo)[on] / np.maximum(1 - np.abs(2 * light - 1), 1e-9)).mean())


def resize(a: np.ndarray, most: int) -> np.ndarray:
    """Inside ``most`` x ``most``, by the mean over areas; smaller images stay as they are."""
    f = max(a.shape[0], a.shape[1]) / most
    if f <= 1:
        return a
    h, w = max(1, round(a.shape[0] / f)), max(1, round(a.shape[1] / f))
    ys = np.linspace(0, a.shape[0], h + 1).astype(int)
    xs = np.linspace(0, a.shape[1], w + 1).astype(int)
    rows = np.add.reduceat(a.astype(float), ys[:-1], axis=0)
    both = np.add.reduceat(rows, xs[:-1], axis=1)
    n = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    return (both / (n if a.ndim == 2 else n[..., None])).astype(a.dtype)


def embed(rows: DataFrame, column: str, model: Callable[[], Callable[[list], np.ndarray]], keep: list[str], out: str = "embedding", batch: int = 32) -> DataFrame:
    """``keep..., out``: vectors of a model for every row. ``model()`` is called once for each Python worker's task; a
    null value gives a null vector."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for b in batches:
            vectors: list = [None] * len(b)
            some = [k for k, v in enumerate(b[column]) if v is not None]
            for s in range(0, len(some), batch):
                part = some[s : s + batch]
                for k, v in zip(part, f([b[column].iloc[k] for k in part])):
                    vectors[k] = np.asarray(v, np.float32)
            yield b[keep].assign(**{out: vectors})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + f", {out} array<float>"
    return rows.select(*dict.fromkeys([*keep, column])).mapInPandas(run, schema)


def segments(grey: np.ndarray, scale: float = 300.0, least: int = 20) -> np.ndarray:
    """Labels of a graph segmentation: edges between neighbouring pixels in the order of their difference join regions
    whose inner difference they don't exceed by more than scale / size; small regions join a neighbour."""
    h, w = grey.shape
    g = grey.astype(float)
    at = np.arange(h * w).reshape(h, w)
    a = np.r_[at[:, :-1].ravel(), at[:-1].ravel()]
    b = np.r_[at[:, 1:].ravel(), at[1:].ravel()]
    d = np.r_[np.abs(g[:, 1:] - g[:, :-1]).ravel(), np.abs(g[1:] - g[:-1]).ravel()]
    root, size, inner = np.arange(h * w), np.ones(h * w, int), np.zeros(h * w)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(d, kind="stable")
    for small in (False, True):
        for k in order:
            x, y = find(a[k]), find(b[k])
            if x == y:
                continue
            fits = min(size[x], size[y]) < least if small else d[k] <= min(inner[x] + scale / size[x], inner[y] + scale / size[y])
            if fits:
                x, y = min(x, y), max(x, y)
                root[y] = x
                size[x] += size[y]
                inner[x] = max(inner[x], d[k])
    labels = np.array([find(k) for k in range(h * w)])
    return np.unique(labels, return_inverse=True)[1].reshape(h, w)


def regions(grey: np.ndarray, scale: float = 300.0, least: int = 20, apart: float = 20.0) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the segments, larger ones first, without those whose centre is within ``apart`` of a larger
    one's."""
    lab = segments(grey, scale, least)
    boxes = []
    for k in range(lab.max() + 1):
        y, x = np.nonzero(lab == k)
        boxes.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    kept: list[tuple[int, int, int, int]] = []
    for b in sorted(boxes, key=lambda b: (-b[2] * b[3], b)):
        if all(np.hypot(b[0] + b[2] / 2 - k[0] - k[2] / 2, b[1] + b[3] / 2 - k[1] - k[3] / 2) > apart for k in kept):
            kept.append(b)
    return kept


#: Model of a face whose key points are seen from the front (eyes, nose, mouth corners), in units of the
#: distance between the eyes.
FACE_MODEL = np.array([[-0.5, 0.0, 0.0], [0.5, 0.0, 0.0], [0.0, 0.55, 0.55], [-0.38, 1.0, 0.05], [0.38, 1.0, 0.05]])


def head_pose(points: np.ndarray) -> tuple[float, float, float] | None:
    """Yaw, pitch and roll in degrees from five key points, by a scaled orthographic fit; None if the eyes are less than
    a pixel apart or anything isn't finite."""
    p = np.asarray(points, float)
    if p.shape != (5, 2) or not np.isfinite(p).all() or np.linalg.norm(p[1] - p[0]) < 1:
        return None
    m = FACE_MODEL - FACE_MODEL.mean(axis=0)
    a = np.linalg.lstsq(m, p - p.mean(axis=0), rcond=None)[0].T  # 2 x 3
    r1, r2 = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    r3 = np.cross(r1, r2)
    yaw = np.degrees(np.arctan2(r1[2], np.hypot(r1[0], r1[1])))
    pitch = np.degrees(np.arctan2(-r2[2], r3[2]))
    roll = np.degrees(np.arctan2(r2[0], r1[0]))
    return float(yaw), float(pitch), float(roll)
