"""Scores of faces, images, names and codes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def combined(det: Column, area: Column, blur: Column, pose: Column) -> Column:
    """Fixed weights .30 detector, .25 area, .25 blur, .20 pose."""
    return clamp01(0.30 * det + 0.25 * area + 0.25 * blur + 0.20 * pose)


def pose_of_angles(yaw: Column, pitch: Column, roll: Column) -> Column:
    """1 less the mean deviation of the axes beyond 15 degrees, in units of 45."""
    dev = [F.least(F.greatest(F.abs(a) - 15.0, F.lit(0.0)) / 45.0, F.lit(1.0)) for a in (yaw, pitch, roll)]
    return clamp01(1.0 - (dev[0] + dev[1] + dev[2]) / 3.0)


def pose_of_points(le: tuple, re: tuple, lm: tuple, rm: tuple) -> Column:
    """From the tilt of eyes and mouth; each argument is (x, y)."""
    eye = F.abs(re[1] - le[1]) / F.greatest(F.abs(re[0] - le[0]), F.lit(1.0))
    mouth = F.abs(rm[1] - lm[1]) / F.greatest(F.abs(rm[0] - lm[0]), F.lit(1.0))
    return (1.0 - F.least(eye + mouth, F.lit(1.0)) + 1.0 - F.least(eye, F.lit(1.0))) / 2.0


def area_score(w: Column, h: Column, reference: float = 150.0) -> Column:
    return clamp01(F.least(w, h) / reference)


def composite(size: Column, det: Column, align: Column, blur: Column, yaw: Column, pitch: Column, roll: Column) -> Column:
    """Product of the size (up to 120 px), the scores and a penalty for each angle."""

    def penalty(a: Column, full: float, weight: float) -> Column:
        return 1.0 - F.least(F.abs(a) / full, F.lit(1.0)) * weight

    pose = penalty(yaw, 90.0, 0.3) * penalty(pitch, 90.0, 0.2) * penalty(roll, 45.0, 0.1)
    return F.least(size / 120.0, F.lit(1.0)) * det * align * blur * pose


def pose_category(yaw: Column) -> Column:
    a = F.abs(yaw)
    return F.when(a < 30, "NORMAL").when(a < 45, "MODERATE").when(a < 60, "HARD").when(a >= 60, "EXTREME")


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """Name of the first check that is true, in order; null if none is."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])


def assignment_confidence(sim: Column, quality: Column, pose: Column) -> Column:
    return clamp01(0.6 * sim + 0.25 * F.coalesce(quality, F.lit(0.5)) + 0.15 * F.coalesce(pose, F.lit(0.5)))


def weighted_confidence(face: Column, body: Column, face_q: Column, body_q: Column) -> Column:
    """.7 face and .3 body, and up to .2 for the channels' quality; a null quality means that the channel is missing."""
    fq = F.when(face_q.isNotNull(), F.greatest(face_q, F.lit(0.3))).otherwise(0.0)
    bq = F.when(body_q.isNotNull(), F.greatest(body_q, F.lit(0.3))).otherwise(0.0)
    return F.least(F.lit(1.0), 0.7 * face + 0.3 * body + 0.2 * (fq + bq) / 2.0)


def prototype_type(yaw: Column, quality: Column, floor: float = 0.45, side: float = 30.0) -> Column:
    """Pose bucket of a face; a missing yaw is frontal, a quality under the floor gives null."""
    kind = F.when(yaw < -side, "left_profile").when(yaw > side, "right_profile").otherwise("frontal")
    return F.when(quality >= floor, kind)


def weight_of(kind: Column, weights: dict[str, float], other: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(table[kind], F.lit(other))


#: Weights of prototype and region types.
PROTOTYPE_WEIGHTS = {"frontal": 1.0, "left_profile": 0.8, "right_profile": 0.8, "high_quality": 1.2, "general": 0.6}
REGION_WEIGHTS = {"FullImage": 0.85, "SlidingWindow": 1.0}


def image_type(width: Column, height: Column, entropy: Column, saturation: Column, colours: Column, variance: Column) -> Column:
    """Class of an image from its figures, in order; fixed thresholds."""
    aspect = width / F.when(height > 0, height)
    return (
        F.when((width < 256) | (height < 256), "Unknown").when((aspect < 0.4) | (aspect > 2.5), "Screenshot")
        .when(entropy < 4.0, "Anime").when(saturation > 0.65, "Poster").when(colours < 100, "Meme")
        .when((variance < 0.01) & ((aspect < 0.6) | (aspect > 1.8)), "Screenshot").otherwise("Photo")
    )


def low_information(bytes_: Column, pixels: Column, colours: Column) -> Column:
    """Fewer than .05 bytes a pixel, or fewer than .15 and fewer than 100 colours."""
    d = bytes_ / F.greatest(pixels, F.lit(1))
    return (d < 0.05) | ((d < 0.15) & (colours < 100))


def version_name(v: Column) -> Column:
    return F.when(F.instr(v, "@") > 0, F.substring_index(v, "@", 1)).otherwise(v)


def version_number(v: Column) -> Column:
    return F.regexp_extract(v, "^[^@]*@(.*)$", 1)


#: Extensions of images and their types.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heic", "heif": "image/heif",
}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([A-Za-z0-9]+)$", 1))


def mime(path: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[extension(path)], F.lit("application/octet-stream"))


def fetch_k(k: int, times: int, least: int) -> int:
    """How many rows to fetch so that ``k`` are left after several are dropped."""
    return min(2**31 - 1, max(max(k, 1) * max(times, 1), max(least, 1)))


def fetch_k_of(k: Column, times: Column, least: Column) -> Column:
    """The same of columns."""
    one = F.lit(1).cast("bigint")
    return F.least(F.lit(2**31 - 1).cast("bigint"), F.greatest(F.greatest(k, one) * F.greatest(times, one), least, one))


def stable_id(*parts: Column) -> Column:
    """Non-negative 60-bit id from the parts: the first 15 digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def fusion(emb: Column, inlier: Column, iou: Column, points: Column, a: float = 0.5, b: float = 0.3, c: float = 0.2) -> Column:
    """Embedding, inlier share and overlap; the embedding alone without key points."""
    return F.when(points > 0, a * emb + b * inlier + c * iou).otherwise(emb)


def evidence_level(face: Column, body: Column) -> Column:
    return F.when(face & body, "DUAL").when(face, "FACE").when(body, "BODY").otherwise("NONE")


def json_kind(json: Column, kinds: list[str], field: str) -> tuple[Column, Column]:
    """Tag and field of an externally tagged enum: {"Tag": {"field": 1}}."""
    tag = F.coalesce(*[F.when(F.get_json_object(json, f"$.{k}").isNotNull(), F.lit(k)) for k in kinds])
    value = F.coalesce(*[F.get_json_object(json, f"$.{k}.{field}") for k in kinds])
    return tag, value
