"""Queries of the functions of vectors, boxes, scores and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import geometry as G
from mosaiq.functions import quality as Q
from mosaiq.functions import vectors as V
from mosaiq.plans import fixtures as X
from mosaiq.plans.registry import Registry
from mosaiq.session import read

R = Registry()
queries = lambda: R.functions
oracle_sql = lambda: R.sql


def rnd(c, name):
    return F.round(c, 6).alias(name)


def box_cols(b, prefix=""):
    return [rnd(c, prefix + n) for c, n in zip(b, ("x", "y", "w", "h"))]


NEXT = "p as (select a.face_id, b.face_id as other, a.vector as a, b.vector as b, a.raw as ra, b.raw as rb from faces a join faces b on b.face_id = a.face_id + 1)"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"


def neighbours(spark, d):
    f = X.faces(spark, d)
    a = f.selectExpr("face_id", "vector as a", "raw as ra")
    b = f.selectExpr("face_id - 1 as face_id", "face_id as other", "vector as b", "raw as rb")
    return a.join(b, "face_id")


def _pair(name, spark_col, sql):
    R.add(name, lambda s, d: neighbours(s, d).select("face_id", rnd(spark_col(), "value")), f"with {X.FACES}, {NEXT} select face_id, round({sql}, 6) as value from p")


D, NA, NB = DOT.format("ra", "rb"), NORM.format("ra"), NORM.format("rb")
SQ = "list_sum(list_transform(list_zip(ra, rb), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_pair("v01_cosine01", lambda: V.cosine01("ra", "rb"), f"greatest(0.0, least(1.0, {D} / greatest({NA} * {NB}, 1e-6)))")
_pair("v02_dot", lambda: V.dot("ra", "rb"), D)
_pair("v03_cosine", lambda: V.cosine("ra", "rb"), f"case when {NA} * {NB} = 0 then 0 else {D} / ({NA} * {NB}) end")
_pair("v04_l2", lambda: V.l2("ra", "rb"), f"sqrt({SQ})")
_pair("v05_squared_l2", lambda: V.squared_l2("ra", "rb"), SQ)
_pair("v06_norm", lambda: V.norm("ra"), NA)
_pair("v08_score_of_distance", lambda: V.score_of_distance(V.l2("a", "b")), "greatest(0.0, least(1.0, 1.0 - sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))))")
_pair("v24_prototype_drift", lambda: V.l2("a", "b"), "sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")


def _vec(name, spark_vec, sql_vec):
    R.add(
        name,
        lambda s, d: neighbours(s, d).select("face_id", F.posexplode(spark_vec()).alias("pos", "v")).select("face_id", "pos", rnd(F.col("v"), "v")),
        f"with {X.FACES}, {NEXT}, m as (select face_id, {sql_vec} as m from p), u as (select face_id, generate_subscripts(m, 1) - 1 as pos, unnest(m) as v from m) select face_id, cast(pos as int) as pos, round(v, 6) as v from u",
    )


def _unit_sql(v, eps="0"):
    return f"list_transform({v}, lambda x: x / greatest({NORM.format(v)}, {eps}))"


_vec("v07_normalise", lambda: V.normalise("ra"), _unit_sql("ra"))
_vec("v07_normalise_eps", lambda: V.normalise("ra", 1e-6), _unit_sql("ra", "1e-6"))
MID = "list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2)"
_vec("v12_centroid_merge", lambda: V.merge_centroid("a", "b"), _unit_sql(MID, "1e-6"))
RUN = "list_transform(list_zip(a, b), lambda z: (z[1] * 3 + z[2]) / 4)"
_vec("v13_running_mean", lambda: V.running_mean("a", F.lit(3.0), "b"), _unit_sql(RUN))
DRIFT = "list_transform(list_zip(a, b), lambda z: z[1] * 0.9 + z[2] * 0.1)"
_vec("v14_exponential_drift", lambda: V.drifted("a", "b"), _unit_sql(DRIFT))


@R.query(f"with {X.FACES}, {NEXT} select face_id, 'cosine' as metric, round({D} / ({NA} * {NB}), 6) as value from p union all select face_id, 'inner_product', round({D}, 6) from p union all select face_id, 'euclidean', round(-sqrt({SQ}), 6) from p")
def v09_metrics(s, d):
    n = neighbours(s, d)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), V.similarity("ra", "rb", m).alias("v")) for m in ("cosine", "inner_product", "euclidean")])
    return n.select("face_id", F.explode(each).alias("z")).select("face_id", "z.metric", rnd(F.col("z.v"), "value"))


@R.query("select len(embedding) as n, count(*) as rows from embeddings where len(embedding) = 64 group by 1")
def v15_dimension_check(s, d):
    e = read(s, d, "embeddings").select(F.size(V.checked("embedding", 64)).cast("bigint").alias("n"))
    return e.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))


@R.query("select vec_id, cast(256 as bigint) as n_bytes, true as same from embeddings")
def v16_bytes_round_trip(s, d):
    e = read(s, d, "embeddings").withColumn("b", V.to_bytes("embedding"))
    return e.select("vec_id", F.length("b").cast("bigint").alias("n_bytes"), (V.from_bytes("b", 64) == F.col("embedding")).alias("same"))


# boxes: a face and the next one
BOXES = "b as (select a.face_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y \"by\", b.w bw, b.h bh from faces a join faces b on b.face_id = a.face_id + 1)"


def boxes(s, d):
    f = X.faces(s, d)
    a = f.selectExpr("face_id", "x as ax", "y as ay", "w as aw", "h as ah")
    b = f.selectExpr("face_id - 1 as face_id", "x as bx", "y as `by`", "w as bw", "h as bh")
    return a.join(b, "face_id")


def A():
    return tuple(F.col("a" + c) for c in "xywh")


def B():
    return tuple(F.col("b" + c) for c in "xywh")


def _boxes(name, cols, sql):
    R.add(name, lambda s, d: boxes(s, d).select("face_id", *cols()), f"with {X.FACES}, {BOXES} select face_id, {sql} from b")


INTER = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, \"by\" + bh) - greatest(ay, \"by\"))"
OVER = "least(ax + aw, bx + bw) > greatest(ax, bx) and least(ay + ah, \"by\" + bh) > greatest(ay, \"by\")"
_boxes("g01_corners", lambda: [*box_cols(G.from_corners(*G.to_corners(A())))], "ax as x, ay as y, round(aw, 6) as w, round(ah, 6) as h")
_boxes("g02_area", lambda: [rnd(G.area(A()), "area"), G.valid(A()).alias("valid")], "aw * ah as area, (aw > 0 and ah > 0 and isfinite(ax) and isfinite(ay)) as valid")
_boxes("g03_intersection", lambda: box_cols(G.intersection(A(), B())), f"case when {OVER} then greatest(ax, bx) end as x, case when {OVER} then greatest(ay, \"by\") end as y, case when {OVER} then least(ax + aw, bx + bw) - greatest(ax, bx) end as w, case when {OVER} then least(ay + ah, \"by\" + bh) - greatest(ay, \"by\") end as h")
_boxes("g04_iou", lambda: [rnd(G.iou(A(), B()), "iou")], f"round({INTER} / (aw * ah + bw * bh - {INTER}), 6) as iou")
_boxes("g05_scaled", lambda: box_cols(G.scaled(A(), 1.5, 2.0)), "ax - aw * 0.25 as x, ay - ah * 0.5 as y, aw * 1.5 as w, ah * 2 as h")


def _clamp_sql(x, y, w, h, W="480", H="360"):
    return f"round(greatest({x}, 0), 6) as x, round(greatest({y}, 0), 6) as y, round(least(greatest({w}, 1), greatest({W} - greatest({x}, 0), 1)), 6) as w, round(least(greatest({h}, 1), greatest({H} - greatest({y}, 0), 1)), 6) as h"


FX = "case when least(aw / 480, ah / 360) >= 0.5 then 1.0 when least(aw / 480, ah / 360) >= 0.2 then 1.5 else 2.0 end"
_boxes("g06_expanded", lambda: box_cols(G.expanded(A(), F.lit(480.0), F.lit(360.0))), _clamp_sql(f"(ax + (aw - aw * {FX}) / 2)", f"(ay + (ah - ah * {FX}) / 2)", f"(aw * {FX})", f"(ah * {FX})"))
_boxes("g07_clamped", lambda: box_cols(G.clamped((A()[0] - 50, A()[1] - 20, A()[2], A()[3]), F.lit(280.0), F.lit(200.0))), _clamp_sql("(ax - 50)", "(ay - 20)", "aw", "ah", "280", "200"))
_boxes("g08_crop_margin", lambda: box_cols(G.with_margin(A(), 0.1, F.lit(480.0), F.lit(360.0))), "round(greatest(ax - aw * 0.1, 0), 6) as x, round(greatest(ay - ah * 0.1, 0), 6) as y, round(least(ax + aw * 1.1, 480) - greatest(ax - aw * 0.1, 0), 6) as w, round(least(ay + ah * 1.1, 360) - greatest(ay - ah * 0.1, 0), 6) as h")
_boxes("g09_body_expanded", lambda: box_cols(G.body_box(A(), F.lit(480.0), F.lit(360.0), "expanded")), "round(greatest(ax - aw * 0.2, 0), 6) as x, round(greatest(ay - ah * 0.2, 0), 6) as y, round(least(aw * 1.4, 480), 6) as w, round(least(ah * 1.4, 360), 6) as h")
for _s, (_a, _b, _c) in G.BODY.items():
    _x, _y = f"greatest(ax + aw / 2 - aw * {_a} / 2, 0)", f"greatest(ay + ah / 2 - ah * {_b} * {_c}, 0)"
    _boxes(f"g09_{_s}", lambda s=_s: box_cols(G.body_box(A(), F.lit(480.0), F.lit(360.0), s)), f"round({_x}, 6) as x, round({_y}, 6) as y, round(least(aw * {_a}, 480 - {_x}), 6) as w, round(least(ah * {_b}, 360 - {_y}), 6) as h")
PX, PY = "greatest(0, least(aw, bw) - abs(ax - bx))", "greatest(0, least(ah, bh) - abs(ay - \"by\"))"
_boxes("g10_patch_overlap", lambda: [rnd(G.patch_overlap(A(), B()), "overlap")], f"round({PX} * {PY} / (aw * ah + bw * bh - {PX} * {PY}), 6) as overlap")


def _grid(name, size, stride, most):
    lim = f"qualify row_number() over (partition by image_id order by yy, xx) <= {most}" if most else ""
    R.add(
        name,
        lambda s, d: read(s, d, "images").select("image_id", "width", "height").where("width > 0 and height > 0").distinct()
        .select("image_id", F.explode(G.grid(F.col("width"), F.col("height"), size, stride, most)).alias("g")).select("image_id", "g.x", "g.y"),
        f"""with i as (select distinct image_id, width, height from images where width > 0 and height > 0),
        c as (select image_id, width, height, unnest(range(0, cast(greatest(width - {size}, 0) as bigint) + 1, {stride})) as xx from i),
        g as (select image_id, xx, unnest(range(0, cast(greatest(height - {size}, 0) as bigint) + 1, {stride})) as yy from c)
        select image_id, cast(xx as int) as x, cast(yy as int) as y from g {lim}""",
    )


_grid("g11_roi_grid", 1024, 512, None)
_grid("g12_patch_grid", 512, 256, 50)
HOM = [1.1, 0.02, 3.0, -0.01, 0.95, -2.0, 0.0001, -0.0002, 1.0]
HU, HV, HW = "(1.1 * ax + 0.02 * ay + 3.0)", "(-0.01 * ax + 0.95 * ay - 2.0)", "(0.0001 * ax - 0.0002 * ay + 1.0)"
_boxes("g13_homography", lambda: [rnd(c, n) for c, n in zip(G.apply_homography(F.array(*[F.lit(v) for v in HOM]), A()[0], A()[1]), "uv")] + [rnd(G.reprojection_error(F.array(*[F.lit(v) for v in HOM]), A()[0], A()[1], B()[0], B()[1]), "error")], f"round({HU} / {HW}, 6) as u, round({HV} / {HW}, 6) as v, round(sqrt(power({HU} / {HW} - bx, 2) + power({HV} / {HW} - \"by\", 2)), 6) as error")
_boxes("g19_centred", lambda: [rnd(G.centred(A()[0], F.lit(480.0)), "u"), rnd(G.centred(A()[1], F.lit(360.0)), "v")], "round(2 * ax / 480 - 1, 6) as u, round(2 * ay / 360 - 1, 6) as v")


@R.query(f"with {X.FACES}, {BOXES} select cast(count(*) as bigint) as inliers from b where sqrt(power(ax - bx, 2) + power(ay - \"by\", 2)) < 20")
def g16_distance_inliers(s, d):
    near = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < 20
    return boxes(s, d).where(near).agg(F.count(F.lit(1)).alias("inliers"))


#: The five points of an aligned 112 x 112 face.
ALIGNED = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]
POINTS = [("x + 0.30 * w", "y + 0.35 * h"), ("x + 0.70 * w", "y + 0.36 * h"), ("x + 0.52 * w", "y + 0.55 * h"), ("x + 0.35 * w", "y + 0.78 * h"), ("x + 0.68 * w", "y + 0.77 * h")]


def _align_sql():
    ux, uy = sum(p[0] for p in ALIGNED) / 5, sum(p[1] for p in ALIGNED) / 5
    mx = "(" + " + ".join(f"({p[0]})" for p in POINTS) + ") / 5"
    my = "(" + " + ".join(f"({p[1]})" for p in POINTS) + ") / 5"
    var = " + ".join(f"power(({a}) - mx, 2) + power(({b}) - my, 2)" for a, b in POINTS)
    p = " + ".join(f"(({a}) - mx) * ({u - ux}) + (({b}) - my) * ({v - uy})" for (a, b), (u, v) in zip(POINTS, ALIGNED))
    q = " + ".join(f"(({a}) - mx) * ({v - uy}) - (({b}) - my) * ({u - ux})" for (a, b), (u, v) in zip(POINTS, ALIGNED))
    return f"""with {X.FACES}, m as (select *, {mx} as mx, {my} as my from faces), s as (select face_id, mx, my, ({p}) / ({var}) as a, ({q}) / ({var}) as b from m)
    select face_id, round(a, 6) as a, round(b, 6) as b, round({ux} - (a * mx - b * my), 4) as tx, round({uy} - (b * mx + a * my), 4) as ty from s"""


@R.query(_align_sql())
def g17_similarity_transform(s, d):
    f = X.faces(s, d)
    src = [(F.expr(a), F.expr(b)) for a, b in POINTS]
    a, b, tx, ty = G.similarity_transform(src, ALIGNED)
    return f.select("face_id", rnd(a, "a"), rnd(b, "b"), F.round(tx, 4).alias("tx"), F.round(ty, 4).alias("ty"))


def _face(name, cols, sql, where=""):
    R.add(name, lambda s, d: (X.faces(s, d).where(where) if where else X.faces(s, d)).select("face_id", *cols()), f"with {X.FACES} select face_id, {sql} from faces" + (f" where {where}" if where else ""))


c = F.col
POSE = "(1 - (" + " + ".join(f"least(greatest(abs({a}) - 15, 0) / 45.0, 1)" for a in ("yaw", "pitch", "roll")) + ") / 3.0)"
COMP = "(least(face_size / 120, 1) * det * quality * blur * (1 - least(abs(yaw) / 90, 1) * 0.3) * (1 - least(abs(pitch) / 90, 1) * 0.2) * (1 - least(abs(roll) / 45, 1) * 0.1))"
K = "yaw is not null"


def comp():
    return Q.composite(c("face_size"), c("det"), c("quality"), c("blur"), c("yaw"), c("pitch"), c("roll"))


_face("f01_combined_quality", lambda: [rnd(Q.combined(c("det"), Q.area_score(c("w"), c("h")), c("blur"), Q.pose_of_angles(c("yaw"), c("pitch"), c("roll"))), "q")], f"round(greatest(0, least(1, 0.3 * det + 0.25 * greatest(0, least(1, least(w, h) / 150)) + 0.25 * blur + 0.2 * {POSE})), 6) as q", K)
_face("f02_pose_of_angles", lambda: [rnd(Q.pose_of_angles(c("yaw"), c("pitch"), c("roll")), "pose")], f"round({POSE}, 6) as pose", K)
_face("f03_pose_of_points", lambda: [F.round(Q.pose_of_points((c("x"), c("y")), (c("x") + c("w") * 0.4, c("y") + c("roll")), (c("x"), c("y") + c("h")), (c("x") + c("w") * 0.4, c("y") + c("h") + c("roll") / 2))  , 9).alias("pose")], "round((1 - least(abs(roll) / greatest(w * 0.4, 1) + abs(roll / 2) / greatest(w * 0.4, 1), 1) + 1 - least(abs(roll) / greatest(w * 0.4, 1), 1)) / 2, 9) as pose")
_face("f04_area_score", lambda: [rnd(Q.area_score(c("w"), c("h")), "area")], "round(greatest(0, least(1, least(w, h) / 150)), 6) as area")
_face("f05_eye_distance", lambda: [rnd(F.hypot(c("w") * 0.4, c("roll")), "eye")], "round(sqrt(power(w * 0.4, 2) + power(roll, 2)), 6) as eye")
_face("f08_composite_quality", lambda: [rnd(comp(), "q")], f"round({COMP}, 6) as q", K)
_face("f10_pose_category", lambda: [Q.pose_category(c("yaw")).alias("category")], "case when abs(yaw) < 30 then 'NORMAL' when abs(yaw) < 45 then 'MODERATE' when abs(yaw) < 60 then 'HARD' when abs(yaw) >= 60 then 'EXTREME' end as category")
_face("f11_first_failure", lambda: [Q.first_failure([(c("face_size") < 60, "size"), (c("det") < 0.3, "detection"), (F.abs("yaw") > 45, "yaw"), (F.abs("pitch") > 40, "pitch"), (c("blur") < 0.3, "blur"), (F.round(comp(), 6) < 0.05, "composite")]).alias("reason")], f"case when face_size < 60 then 'size' when det < 0.3 then 'detection' when abs(yaw) > 45 then 'yaw' when abs(pitch) > 40 then 'pitch' when blur < 0.3 then 'blur' when round({COMP}, 6) < 0.05 then 'composite' end as reason")
_face("f12_quality_weight", lambda: [rnd(F.when(c("quality") < 0.45, 0.0).otherwise(0.5 + 0.5 * F.least(c("quality") / 0.45, F.lit(2.0))), "weight")], "round(case when quality < 0.45 then 0.0 else 0.5 + 0.5 * least(quality / 0.45, 2) end, 6) as weight")
_face("f13_assignment_confidence", lambda: [rnd(Q.assignment_confidence(c("det"), F.when(c("face_id") % 3 > 0, c("quality")), F.when(c("face_id") % 4 > 0, c("blur"))), "confidence")], "round(0.6 * det + 0.25 * coalesce(case when face_id % 3 > 0 then quality end, 0.5) + 0.15 * coalesce(case when face_id % 4 > 0 then blur end, 0.5), 6) as confidence")
_face("f14_weighted_confidence", lambda: [rnd(Q.weighted_confidence(c("det"), c("blur"), F.when(c("face_id") % 3 > 0, c("quality")), F.when(c("face_id") % 4 > 0, c("quality"))), "confidence")], "round(least(1, 0.7 * det + 0.3 * blur + 0.2 * (case when face_id % 3 > 0 then greatest(quality, 0.3) else 0 end + case when face_id % 4 > 0 then greatest(quality, 0.3) else 0 end) / 2), 6) as confidence")
_face("f15_prototype_type", lambda: [Q.prototype_type(c("yaw"), c("quality")).alias("kind")], "case when quality >= 0.45 then case when yaw < -30 then 'left_profile' when yaw > 30 then 'right_profile' else 'frontal' end end as kind")
_face("f16_prototype_weight", lambda: [rnd(Q.weight_of(Q.prototype_type(c("yaw"), c("quality")), Q.PROTOTYPE_WEIGHTS, 0.0), "weight")], "case when quality >= 0.45 then case when yaw < -30 or yaw > 30 then 0.8 else 1.0 end else 0.0 end::double as weight")
_face("f25_fusion", lambda: [rnd(Q.fusion(c("det"), c("blur"), c("quality"), F.col("face_id") % 3), "score")], "round(case when face_id % 3 > 0 then 0.5 * det + 0.3 * blur + 0.2 * quality else det end, 6) as score")
_face("f26_region_weight", lambda: [rnd(c("det") * Q.weight_of(F.when(c("face_id") % 5 == 0, "FullImage").otherwise("SlidingWindow"), Q.REGION_WEIGHTS, 1.0), "score")], "round(det * case when face_id % 5 = 0 then 0.85 else 1.0 end, 6) as score")
_face("f27_strength", lambda: [F.when(c("quality") >= 0.5, "strong").when(c("quality") >= 0.25, "weak").otherwise("rejected").alias("strength")], "case when quality >= 0.5 then 'strong' when quality >= 0.25 then 'weak' else 'rejected' end as strength")
_face("f28_evidence_level", lambda: [Q.evidence_level(c("face_id") % 3 > 0, c("face_id") % 4 > 0).alias("level")], "case when face_id % 3 > 0 and face_id % 4 > 0 then 'DUAL' when face_id % 3 > 0 then 'FACE' when face_id % 4 > 0 then 'BODY' else 'NONE' end as level")
_face("f17_image_type", lambda: [Q.image_type(c("w") * 4, c("h") * 3, c("det") * 8, c("blur"), c("face_size") * 3, c("quality") / 30).alias("kind")], "case when w * 4 < 256 or h * 3 < 256 then 'Unknown' when w * 4 / (h * 3) < 0.4 or w * 4 / (h * 3) > 2.5 then 'Screenshot' when det * 8 < 4 then 'Anime' when blur > 0.65 then 'Poster' when face_size * 3 < 100 then 'Meme' when quality / 30 < 0.01 and (w * 4 / (h * 3) < 0.6 or w * 4 / (h * 3) > 1.8) then 'Screenshot' else 'Photo' end as kind")


@R.query("select distinct image_id, (size / greatest(width * height, 1)::double < 0.05 or (size / greatest(width * height, 1)::double < 0.15 and object_count < 100)) as low from images where width is not null and height is not null")
def f19_low_information(s, d):
    i = read(s, d, "images").where("width is not null and height is not null")
    return i.select("image_id", Q.low_information(c("size"), c("width") * c("height"), c("object_count")).alias("low")).distinct()


@R.query("select model_version, split_part(model_version, '@', 1) as name, case when contains(model_version, '@') then substr(model_version, instr(model_version, '@') + 1) else '' end as version, count(*) as n from face_features where model_version is not null group by 1")
def f20_model_version(s, d):
    g = read(s, d, "face_features").where("model_version is not null").groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))
    return g.select("model_version", Q.version_name(c("model_version")).alias("name"), Q.version_number(c("model_version")).alias("version"), "n")


_BASE = "regexp_extract(replace(path, chr(92), '/'), '[^/]*$')"


@R.query(f"select distinct image_id, {_BASE} as name, lower(regexp_extract({_BASE}, '\\.([A-Za-z0-9]+)$', 1)) as ext, case lower(regexp_extract({_BASE}, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in Q.MIME.items()) + " else 'application/octet-stream' end as mime from images where path is not null")
def f21_f30_names_and_types(s, d):
    i = read(s, d, "images").where("path is not null")
    return i.select("image_id", Q.base_name(c("path")).alias("name"), Q.extension(c("path")).alias("ext"), Q.mime(c("path")).alias("mime")).distinct()


@R.query("select distinct person_id, face_count, body_count, cast(least(2147483647, greatest(greatest(coalesce(face_count, 0), 1) * greatest(coalesce(body_count, 0), 1), 20)) as bigint) as fetch from persons")
def f22_fetch_k(s, d):
    p = read(s, d, "persons").select("person_id", "face_count", "body_count").distinct()
    return p.withColumn("fetch", Q.fetch_k_of(F.coalesce("face_count", F.lit(0)), F.coalesce("body_count", F.lit(0)), F.lit(20)))


@R.query("select distinct image_id, cast('0x' || md5('image|' || image_id)[1:15] as bigint) as id from images")
def f23_stable_ids(s, d):
    return read(s, d, "images").select("image_id", Q.stable_id(F.lit("image"), c("image_id")).alias("id")).distinct()


@R.query("select doc_id, sha256(text) as hash from documents where text is not null")
def f24_content_hash(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", F.sha2(c("text").cast("binary"), 256).alias("hash"))


@R.query("select event_id, event_type as kind, json_extract_string(props, '$.k') as k from events")
def f29_json_field(s, d):
    """Tag and field of an externally tagged enum, made of the event's type and properties."""
    e = read(s, d, "events").withColumn("json", F.concat(F.lit('{"'), "event_type", F.lit('":'), "props", F.lit("}")))
    tag, k = Q.json_kind(c("json"), ["view", "signup", "click", "error", "purchase"], "k")
    return e.select("event_id", tag.alias("kind"), k.alias("k"))


@R.query("select distinct image_id, coalesce(hash, path) as asset from images")
def f32_asset_or_path(s, d):
    return read(s, d, "images").select("image_id", F.coalesce("hash", "path").alias("asset")).distinct()
