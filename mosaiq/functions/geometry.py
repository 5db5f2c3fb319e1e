"""Functions of boxes, patches, key points and transforms, as columns. A box is given by x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c).cast("double") for c in "xywh")


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """xyxy to xywh; null when a corner is on the wrong side."""
    ok = (x2 >= x1) & (y2 >= y1)
    return tuple(F.when(ok, v) for v in (x1, y1, x2 - x1, y2 - y1))


def to_corners(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def area(b: Box) -> Column:
    return b[2] * b[3]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid(b: Box) -> Column:
    return (b[2] > 0) & (b[3] > 0) & finite(b[0]) & finite(b[1])


def intersection(a: Box, b: Box) -> Box:
    """Null unless the boxes overlap strictly."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    w = F.least(a[0] + a[2], b[0] + b[2]) - x
    h = F.least(a[1] + a[3], b[1] + b[3]) - y
    ok = (w > 0) & (h > 0)
    return tuple(F.when(ok, v) for v in (x, y, w, h))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without overlap or union."""
    both = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def scaled(b: Box, sx: float | Column, sy: float | Column) -> Box:
    """Scaled about the centre."""
    w, h = b[2] * sx, b[3] * sy
    return b[0] + (b[2] - w) / 2, b[1] + (b[3] - h) / 2, w, h


def clamped(b: Box, width: Column, height: Column) -> Box:
    """Inside the image; width and height at least 1."""
    x, y = F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0))
    w = F.least(F.greatest(b[2], F.lit(1.0)), F.greatest(width - x, F.lit(1.0)))
    h = F.least(F.greatest(b[3], F.lit(1.0)), F.greatest(height - y, F.lit(1.0)))
    return x, y, w, h


def expanded(b: Box, width: Column, height: Column) -> Box:
    """Region of interest: the smaller the box beside the image, the more it grows; then clamped."""
    side = F.least(b[2] / width, b[3] / height)
    f = F.when(side >= 0.5, F.lit(1.0)).when(side >= 0.2, F.lit(1.5)).otherwise(F.lit(2.0))
    return clamped(scaled(b, f, f), width, height)


def with_margin(b: Box, share: float, width: Column, height: Column) -> Box:
    """Crop with a margin on every side, cut at the image's border; null if less than a pixel is left."""
    x1 = F.greatest(b[0] - b[2] * share, F.lit(0.0))
    y1 = F.greatest(b[1] - b[3] * share, F.lit(0.0))
    x2 = F.least(b[0] + b[2] * (1 + share), width)
    y2 = F.least(b[1] + b[3] * (1 + share), height)
    ok = (x2 - x1 >= 1) & (y2 - y1 >= 1)
    return tuple(F.when(ok, v) for v in (x1, y1, x2 - x1, y2 - y1))


#: Width and height of the body in faces, and the share of its height above the face's centre.
BODY = {"head_body": (1.5, 2.0, 0.5), "upper_body": (1.3, 2.5, 0.3)}


def body_box(face: Box, width: Column, height: Column, strategy: str) -> Box:
    """Body region of a face: tight (the face), expanded (a fifth on each side), head_body or upper_body."""
    zero = F.lit(0.0)
    if strategy == "tight":
        return face
    if strategy == "expanded":
        x, y = F.greatest(face[0] - face[2] * 0.2, zero), F.greatest(face[1] - face[3] * 0.2, zero)
        return x, y, F.least(face[2] * 1.4, width), F.least(face[3] * 1.4, height)
    sx, sy, above = BODY[strategy]
    w, h = face[2] * sx, face[3] * sy
    x = F.greatest(face[0] + face[2] / 2 - w / 2, zero)
    y = F.greatest(face[1] + face[3] / 2 - h * above, zero)
    return x, y, F.least(w, width - x), F.least(h, height - y)


def patch_overlap(a: Box, b: Box) -> Column:
    """Overlap of equal patches from the distance of their corners, as a share of their union."""
    ow = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.abs(a[0] - b[0]))
    oh = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.abs(a[1] - b[1]))
    both = ow * oh
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def grid(width: Column, height: Column, size: int, stride: int, most: int | None = None) -> Column:
    """Array of the (x, y) corners of a sliding grid, row by row; one at 0 where the image is smaller."""
    xs = F.sequence(F.lit(0), F.greatest(width.cast("int") - size, F.lit(0)), F.lit(stride))
    ys = F.sequence(F.lit(0), F.greatest(height.cast("int") - size, F.lit(0)), F.lit(stride))
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return F.slice(cells, 1, most) if most else cells


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 matrix given as an array of nine, row by row; a w of about 0 isn't divided by."""
    u, v, w = ((h[3 * k] * x + h[3 * k + 1] * y + h[3 * k + 2]) for k in range(3))
    flat = F.abs(w) < 1e-10
    return F.when(flat, u).otherwise(u / w), F.when(flat, v).otherwise(v / w)


def reprojection_error(h: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    a, b = apply_homography(h, x, y)
    return F.hypot(a - u, b - v)


def centred(x: Column, size: Column) -> Column:
    """A coordinate in [-1, 1]."""
    return F.when(size > 0, 2.0 * x / size - 1.0).otherwise(F.lit(0.0))


def similarity_transform(src: list[tuple[Column, Column]], dst: list[tuple[float, float]]) -> tuple[Column, ...]:
    """Least squares rotation, scale and shift (a, b, tx, ty): x' = a x - b y + tx, y' = b x + a y + ty.

    In closed form over the centred points; null when all source points coincide."""
    n = float(len(src))
    mx, my = sum((p[0] for p in src), F.lit(0.0)) / n, sum((p[1] for p in src), F.lit(0.0)) / n
    ux, uy = sum(p[0] for p in dst) / n, sum(p[1] for p in dst) / n
    var = p_ = q_ = F.lit(0.0)
    for (x, y), (u, v) in zip(src, dst):
        cx, cy = x - mx, y - my
        var = var + cx * cx + cy * cy
        p_ = p_ + cx * (u - ux) + cy * (v - uy)
        q_ = q_ + cx * (v - uy) - cy * (u - ux)
    a, b = F.when(var > 0, p_ / var), F.when(var > 0, q_ / var)
    return a, b, ux - (a * mx - b * my), uy - (b * mx + a * my)
