"""Queries on measured poses: interpolation, transforms through a fixed frame, pose errors, and rigid transforms.

The records are the poses of every other frame from the fourth on, the oracle is the pose of each frame. Rotations are planar, so that the SQL can
work on angles where the queries work on quaternions and matrices.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe.functions import geometry as G
from sweepframe.operators import metrics as M
from sweepframe.operators import poses as P
from sweepframe.operators.sweeps import history_index
from sweepframe.plans.fixtures import FRAME, POSES, frames, poses
from sweepframe.registry import query

FR = "drive_id, frame_index"
BUCKET = 2_000_000_000


def asof(name: str, records: str) -> str:
    """SQL of {name} AS (...) rows of target (drive_id, frame_index, ts_ns) with the record before (0) and at or after (1) each."""
    cols = ", ".join(f"r.{c} AS {c}{{k}}" for c in ("ts_ns", "tx", "ty", "tz", "turn"))
    return f"""{name}_p AS (SELECT t.*, {cols.format(k=0)} FROM target t ASOF LEFT JOIN {records} r ON t.drive_id = r.drive_id AND t.ts_ns > r.ts_ns),
{name}_b AS (SELECT t.*, {cols.format(k=1)} FROM {name}_p t ASOF LEFT JOIN {records} r ON t.drive_id = r.drive_id AND t.ts_ns <= r.ts_ns),
{name} AS (SELECT *, {", ".join(f"CASE WHEN ts_ns1 = ts_ns THEN {c}1 ELSE {c}0 + (ts_ns - ts_ns0)::DOUBLE / (ts_ns1 - ts_ns0) * ({c}1 - {c}0) END AS {c}" for c in ("tx", "ty", "tz", "turn"))} FROM {name}_b)"""


BASE = f"""{POSES}, oracle AS (SELECT {FR}, ts_ns, tx AS otx, ty AS oty, tz AS otz, yaw * 5 AS oturn FROM poses), target AS (SELECT {FR}, ts_ns FROM poses),
rec AS (SELECT drive_id, ts_ns, tx, ty, tz, yaw * 5 AS turn FROM poses WHERE frame_index % 2 = 0 AND frame_index >= 4),
mount AS (SELECT drive_id, ts_ns, 1.2::DOUBLE + 0.001::DOUBLE * frame_index AS tx, 0.1::DOUBLE AS ty, 1.7::DOUBLE AS tz, 0.1::DOUBLE AS turn FROM poses WHERE frame_index % 3 = 0),
{asof("base", "rec")}"""
VARIANTS = f"""{BASE}, v AS (
SELECT {FR}, ts_ns, 'synchronised' AS variant, tx1 AS tx, ty1 AS ty, tz1 AS tz, turn1 AS turn, ts_ns1 AS rec_at FROM base WHERE ts_ns1 = ts_ns
UNION ALL SELECT {FR}, ts_ns, 'previous', tx0, ty0, tz0, turn0, ts_ns0 FROM base WHERE ts_ns0 IS NOT NULL
UNION ALL SELECT {FR}, ts_ns, 'nearest', CASE WHEN n0 THEN tx0 ELSE tx1 END, CASE WHEN n0 THEN ty0 ELSE ty1 END, CASE WHEN n0 THEN tz0 ELSE tz1 END, CASE WHEN n0 THEN turn0 ELSE turn1 END, CASE WHEN n0 THEN ts_ns0 ELSE ts_ns1 END
  FROM (SELECT *, ts_ns1 IS NULL OR coalesce(ts_ns - ts_ns0 <= ts_ns1 - ts_ns, false) AS n0 FROM base) WHERE ts_ns0 IS NOT NULL OR ts_ns1 IS NOT NULL
UNION ALL SELECT {FR}, ts_ns, 'interpolated', tx, ty, tz, turn, CASE WHEN ts_ns1 = ts_ns THEN ts_ns END FROM base WHERE tx IS NOT NULL),
e AS (SELECT v.*, tx - otx AS ex, ty - oty AS ey, tz - otz AS ez, abs(turn - oturn) AS angle, otx, oty, otz, oturn, sqrt((tx - otx) ** 2 + (ty - oty) ** 2 + (tz - otz) ** 2) AS norm,
  greatest(abs(cos(turn) - cos(oturn)), abs(sin(turn) - sin(oturn))) AS rot, greatest(abs(tx - otx), abs(ty - oty), abs(tz - otz)) AS trans FROM v JOIN oracle USING (drive_id, frame_index))"""


def with_quaternion(df):
    """tx, ty, tz, turn as a record of a transform."""
    q = {"qw": F.cos(F.col("turn") / 2), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(F.col("turn") / 2)}
    return df.withColumns(q).select("drive_id", *(["frame_index"] if "frame_index" in df.columns else []), "ts_ns", *P.PLACE, *P.TURN)


def turning(s, d):
    return poses(s, d).withColumn("turn", F.col("yaw") * 5)


def records(s, d):
    return with_quaternion(turning(s, d).where("frame_index % 2 = 0 and frame_index >= 4").drop("frame_index"))


def mount(s, d):
    return with_quaternion(frames(s, d).where("frame_index % 3 = 0").select("drive_id", "ts_ns", (F.col("frame_index") * 0.001 + 1.2).alias("tx"), F.lit(0.1).alias("ty"), F.lit(1.7).alias("tz"), F.lit(0.1).alias("turn")))


def oracle(s, d):
    p = with_quaternion(turning(s, d))
    return p.select(*FRAME, P.pose_of([F.col(c) for c in P.PLACE], [F.col(c) for c in P.TURN]).alias("oracle"))


def variants(s, d):
    """One row per frame and variant with candidate and oracle transforms."""
    v = P.pose_variants(frames(s, d).select(*FRAME, "ts_ns"), records(s, d), ["drive_id"], "ts_ns", BUCKET)
    names = ("synchronised", "previous", "nearest", "interpolated")
    v = v.select(*FRAME, "ts_ns", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.col(n).alias("candidate")) for n in names))).alias("v")).select(*FRAME, "ts_ns", "v.*")
    return v.where("candidate is not null").join(oracle(s, d), FRAME)


def errors(s, d):
    return P.pose_errors(variants(s, d), "candidate", "oracle")


def seen(m, digits=6):
    """x, y, z and the rotation's cosine and sine of a planar transform, rounded."""
    return [(F.round(F.col(m)[k], digits) + 0.0).alias(n) for n, k in (("x", 3), ("y", 7), ("z", 11), ("c", 0), ("s", 4))]


@query("jn_8_interpolated", f"WITH {BASE} SELECT {FR}, round(tx, 6) + 0 AS x, round(ty, 6) + 0 AS y, round(tz, 6) + 0 AS z, round(cos(turn), 6) + 0 AS c, round(sin(turn), 6) + 0 AS s FROM base")
def jn_8(s, d):
    return P.pose_variants(frames(s, d).select(*FRAME, "ts_ns"), records(s, d), ["drive_id"], "ts_ns", BUCKET).select(*FRAME, *seen("interpolated"))


LOOKUP = f"""{BASE}, {asof("arm", "mount")},
world AS (SELECT b.drive_id, b.frame_index, b.tx + cos(b.turn) * a.tx - sin(b.turn) * a.ty AS x, b.ty + sin(b.turn) * a.tx + cos(b.turn) * a.ty AS y, b.tz + a.tz AS z, b.turn + a.turn AS t FROM base b JOIN arm a USING (drive_id, frame_index)),
h AS (SELECT c.drive_id, c.frame_index, CAST(k AS INT) AS history_rank, c.x AS cx, c.y AS cy, c.z AS cz, c.t AS ct, s.x - c.x AS dx, s.y - c.y AS dy, s.z - c.z AS dz, s.t AS st FROM world c, range(0, 4) r(k) JOIN world s ON s.drive_id = c.drive_id AND s.frame_index = c.frame_index - k),
ok AS (SELECT *, bool_and(dx IS NOT NULL) OVER (PARTITION BY {FR}) AS accepted FROM h)"""


def lookups(s, d):
    stamps = frames(s, d).select(*FRAME, "ts_ns")
    return P.history_transforms(history_index(stamps, 3), stamps, [records(s, d), mount(s, d)], BUCKET)


@query("jn_11_transform_lookup", f"WITH {LOOKUP} SELECT {FR}, history_rank, round(cos(ct) * dx + sin(ct) * dy, 6) + 0 AS x, round(cos(ct) * dy - sin(ct) * dx, 6) + 0 AS y, round(dz, 6) + 0 AS z, round(cos(st - ct), 6) + 0 AS c, round(sin(st - ct), 6) + 0 AS s FROM ok WHERE accepted")
def jn_11(s, d):
    return lookups(s, d).where("accepted").select(*FRAME, "history_rank", *seen("relative"))


@query("stm_5_transform_rejections", f"WITH {LOOKUP} SELECT {FR}, max(history_rank) AS depth, bool_and(accepted) AS published, count(*) FILTER (dx IS NULL) AS missing FROM ok GROUP BY ALL")
def stm_5(s, d):
    # A missing transform rejects the output of this frame; the frame stays in the history of later ones.
    return lookups(s, d).groupBy(*FRAME).agg(F.max("history_rank").alias("depth"), F.bool_and("accepted").alias("published"), F.count_if(F.col("relative").isNull()).alias("missing"))


@query("agg_42_pose_errors", f"WITH {VARIANTS} SELECT variant, drive_id, count(*) AS n, round(avg(norm), 6) AS mean, round(quantile_cont(norm, 0.95), 6) AS p95, round(max(norm), 6) AS max, round(min(ex), 6) + 0 AS low_x, round(max(ex), 6) + 0 AS high_x, round(max(angle), 5) AS max_angle, round(max(greatest(rot, trans)), 6) AS largest, arg_min(frame_index, {{'e': -round(norm, 6), 'i': frame_index}}) AS worst FROM e GROUP BY variant, drive_id")
def agg_42(s, d):
    return errors(s, d).groupBy("variant", "drive_id").agg(
        F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean"), F.round(F.percentile("norm", F.lit(0.95)), 6).alias("p95"), F.round(F.max("norm"), 6).alias("max"),
        (F.round(F.min("ex"), 6) + 0.0).alias("low_x"), (F.round(F.max("ex"), 6) + 0.0).alias("high_x"), F.round(F.max("angle"), 5).alias("max_angle"), F.round(F.max("largest"), 6).alias("largest"),
        F.min_by("frame_index", F.struct(-F.round("norm", 6), "frame_index")).alias("worst"),
    )


@query("agg_43_gate", f"WITH {VARIANTS} SELECT variant, count(*) AS n, count(*) FILTER (rec_at = ts_ns) AS exact, max(norm) <= 0.6 AS translation_ok, max(angle) <= 0.09 AS rotation_ok, max(norm) <= 0.6 AND max(angle) <= 0.09 AS passed FROM e GROUP BY variant")
def agg_43(s, d):
    g = errors(s, d).groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("candidate") == F.col("oracle")).alias("exact"), (F.max("norm") <= 0.6).alias("translation_ok"), (F.max("angle") <= 0.09).alias("rotation_ok"))
    return g.withColumn("passed", F.col("translation_ok") & F.col("rotation_ok"))


@query("agg_44_correlation", f"""WITH {VARIANTS}, w AS (SELECT drive_id, frame_index, norm, sqrt((otx - lag(otx) OVER o) ** 2 + (oty - lag(oty) OVER o) ** 2 + (otz - lag(otz) OVER o) ** 2) / ((ts_ns - lag(ts_ns) OVER o) / 1e9::DOUBLE) AS speed, (ts_ns - rec_at) / 1e9::DOUBLE AS late
  FROM e WHERE variant = 'previous' WINDOW o AS (PARTITION BY drive_id ORDER BY frame_index)) SELECT drive_id, round(corr(speed * late, norm), 6) AS r, CAST(NULL AS DOUBLE) AS constant FROM w GROUP BY drive_id""")
def agg_44(s, d):
    from pyspark.sql.window import Window

    b = P.bracket(frames(s, d).select(*FRAME, "ts_ns"), records(s, d), ["drive_id"], "ts_ns", [], BUCKET).select(*FRAME, ((F.col("ts_ns") - F.col("prev_ts")) / 1e9).alias("late"))
    o = Window.partitionBy("drive_id").orderBy("frame_index")
    at = [F.col("oracle")[k] for k in (3, 7, 11)]
    w = errors(s, d).where("variant = 'previous'").join(b, FRAME)
    step = F.sqrt(sum(((c - F.lag(c).over(o)) ** 2 for c in at[1:]), (at[0] - F.lag(at[0]).over(o)) ** 2))
    w = w.withColumn("expected", step / ((F.col("ts_ns") - F.lag("ts_ns").over(o)) / 1e9) * F.col("late")).withColumn("one", F.lit(1.0)).where("expected is not null")
    return w.groupBy("drive_id").agg(F.round(M.correlation("expected", "norm"), 6).alias("r"), M.correlation("expected", "one").alias("constant"))


@query("agg_45_transform_comparison", f"WITH {VARIANTS} SELECT variant, drive_id, round(max(rot), 6) AS rotation, round(max(trans), 6) AS translation, min(frame_index) FILTER (greatest(rot, trans) > 1e-9) AS first_difference, min(frame_index) FILTER (greatest(rot, trans) > 0.02) AS first_material FROM e GROUP BY variant, drive_id")
def agg_45(s, d):
    u = variants(s, d).select(*FRAME, "variant", F.posexplode(F.zip_with("candidate", "oracle", lambda a, b: F.abs(a - b))).alias("k", "e"))
    turn, move = F.col("k").isin(0, 1, 2, 4, 5, 6, 8, 9, 10), F.col("k").isin(3, 7, 11)
    return u.groupBy("variant", "drive_id").agg(
        F.round(F.max(F.when(turn, F.col("e"))), 6).alias("rotation"), F.round(F.max(F.when(move, F.col("e"))), 6).alias("translation"),
        F.min(F.when(F.col("e") > 1e-9, F.col("frame_index"))).alias("first_difference"), F.min(F.when(F.col("e") > 0.02, F.col("frame_index"))).alias("first_material"),
    )


@query("agg_50_controlled_points", f"""WITH {VARIANTS}, q AS (SELECT drive_id, point, ex + (cos(turn) - cos(oturn)) * px - (sin(turn) - sin(oturn)) * py AS dx, ey + (sin(turn) - sin(oturn)) * px + (cos(turn) - cos(oturn)) * py AS dy, ez AS dz
  FROM e, (VALUES ('ahead', 20::DOUBLE, 0::DOUBLE), ('left', 0::DOUBLE, 20::DOUBLE), ('near', 1::DOUBLE, -1::DOUBLE)) v(point, px, py) WHERE variant = 'interpolated')
SELECT drive_id, point, count(*) AS n, round(max(dx) - min(dx), 6) AS x, round(max(dy) - min(dy), 6) AS y, round(max(dz) - min(dz), 6) AS z FROM q GROUP BY drive_id, point""")
def agg_50(s, d):
    at = F.array(*(F.struct(F.lit(n).alias("point"), F.lit(x).alias("px"), F.lit(y).alias("py")) for n, x, y in (("ahead", 20.0, 0.0), ("left", 0.0, 20.0), ("near", 1.0, -1.0))))
    q = variants(s, d).where("variant = 'interpolated'").withColumn("p", F.explode(at))
    moved = [G.apply(F.col(c), F.col("p.px"), F.col("p.py"), F.lit(0.0)) for c in ("candidate", "oracle")]
    q = q.select("drive_id", "p.point", *((a - b).alias(f"d{n}") for n, a, b in zip("xyz", *moved, strict=True)))
    return q.groupBy("drive_id", "point").agg(F.count("*").alias("n"), *(F.round(F.max(f"d{n}") - F.min(f"d{n}"), 6).alias(n) for n in "xyz"))


@query("agg_51_pose_variants", f"WITH {VARIANTS} SELECT variant, count(*) AS n, round(avg(norm), 6) AS mean, round(median(norm), 6) AS median, round(max(norm), 6) AS max, round(avg(angle), 5) AS mean_angle FROM e GROUP BY variant")
def agg_51(s, d):
    return errors(s, d).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean"), F.round(F.median("norm"), 6).alias("median"), F.round(F.max("norm"), 6).alias("max"), F.round(F.avg("angle"), 5).alias("mean_angle"))


@query("win_9_relative_poses", f"""WITH {VARIANTS}, d AS (SELECT variant, drive_id, delta, frame_index - lag(frame_index, delta) OVER o AS gap, turn, oturn, lag(turn, delta) OVER o AS t0, lag(oturn, delta) OVER o AS o0,
  tx - lag(tx, delta) OVER o AS dx, ty - lag(ty, delta) OVER o AS dy, tz - lag(tz, delta) OVER o AS dz, otx - lag(otx, delta) OVER o AS ox, oty - lag(oty, delta) OVER o AS oy, otz - lag(otz, delta) OVER o AS oz
  FROM e, (VALUES (1), (2), (5), (10)) v(delta) WINDOW o AS (PARTITION BY variant, drive_id, delta ORDER BY frame_index)),
r AS (SELECT *, cos(t0) * dx + sin(t0) * dy - cos(o0) * ox - sin(o0) * oy AS rx, cos(t0) * dy - sin(t0) * dx - cos(o0) * oy + sin(o0) * ox AS ry, dz - oz AS rz, abs((turn - t0) - (oturn - o0)) AS a FROM d WHERE gap = delta)
SELECT variant, CAST(delta AS INT) AS delta, count(*) AS n, round(avg(sqrt(rx * rx + ry * ry + rz * rz)), 6) AS mean, round(max(sqrt(rx * rx + ry * ry + rz * rz)), 6) AS max, round(max(a), 5) AS max_angle FROM r GROUP BY variant, delta""")
def win_9(s, d):
    r = P.relative_poses(variants(s, d), ["variant", "drive_id"], "frame_index", ["candidate", "oracle"], [1, 2, 5, 10])
    return P.pose_errors(r, "candidate", "oracle").groupBy("variant", "delta").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean"), F.round(F.max("norm"), 6).alias("max"), F.round(F.max("angle"), 5).alias("max_angle"))


TURNS = f"{POSES}, t AS (SELECT *, yaw * 5 AS turn FROM poses)"


@query("geo_14_storage_transforms", f"WITH {TURNS}, k AS (SELECT *, 1 + (frame_index % 4) * 3e-7::DOUBLE AS k FROM t) SELECT {FR}, abs(k * k - 1) <= 1e-6 AS valid, CASE WHEN abs(k * k - 1) <= 1e-6 THEN round(cos(turn), 4) + 0 END AS a00, CASE WHEN abs(k * k - 1) <= 1e-6 THEN round(sin(turn), 4) + 0 END AS a01, CASE WHEN abs(k * k - 1) <= 1e-6 THEN round(-(cos(turn) * tx + sin(turn) * ty), 3) + 0 END AS b0, CASE WHEN abs(k * k - 1) <= 1e-6 THEN round(-(cos(turn) * ty - sin(turn) * tx), 3) + 0 END AS b1 FROM k")
def geo_14(s, d):
    k = (F.col("frame_index") % 4) * 3e-7 + 1
    q = with_quaternion(turning(s, d)).withColumn("m", G.storage_transform(*(F.col(c) * k for c in P.TURN), [F.col(c) for c in P.PLACE]))
    return q.select(*FRAME, F.col("m").isNotNull().alias("valid"), *((F.round(F.col("m")[f][i].cast("double"), n) + 0.0).alias(f"{f}{c}") for f, i, c, n in (("a", 0, "00", 4), ("a", 1, "01", 4), ("b", 0, "0", 3), ("b", 1, "1", 3))))


@query("geo_15_rotation_angles", f"WITH {TURNS}, a AS (SELECT {FR}, turn - lag(turn) OVER (PARTITION BY drive_id ORDER BY frame_index) AS a FROM t) SELECT {FR}, round(a, 6) AS radians, round(degrees(a), 4) AS degrees FROM a WHERE a < 1")
def geo_15(s, d):
    from pyspark.sql.window import Window

    o = oracle(s, d).withColumn("before", F.lag("oracle").over(Window.partitionBy("drive_id").orderBy("frame_index"))).where("before is not null")
    o = o.withColumn("a", G.rotation_angle(G.compose(G.inverse_entries(F.col("before")), F.col("oracle")))).where("a < 1")
    return o.select(*FRAME, F.round("a", 6).alias("radians"), F.round(F.degrees("a"), 4).alias("degrees"))


@query("geo_17_axis_rotations", f"""WITH {TURNS}, x AS (SELECT *, 1::DOUBLE AS x, 2 * cos(turn) - 3 * sin(turn) AS y, 2 * sin(turn) + 3 * cos(turn) AS z FROM t), y AS (SELECT * REPLACE (cos(turn) * x + sin(turn) * z AS x, cos(turn) * z - sin(turn) * x AS z) FROM x),
z AS (SELECT * REPLACE (cos(turn) * x - sin(turn) * y AS x, sin(turn) * x + cos(turn) * y AS y) FROM y) SELECT {FR}, round(x + tx, 5) + 0 AS x, round(y + ty, 5) + 0 AS y, round(z + tz, 5) + 0 AS z, 1.0::DOUBLE AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z FROM z""")
def geo_17(s, d):
    zero, turn = [F.lit(0.0)] * 3, F.col("turn")
    steps = turning(s, d).select(*FRAME, *(G.rigid(G.rotation(a, turn), zero).alias(f"r{a}") for a in "xy"), G.rigid(G.rotation("z", turn), [F.col(c) for c in P.PLACE]).alias("rz"))
    m = steps.select(*FRAME, G.compose(F.col("ry"), F.col("rx")).alias("yx"), "rz").select(*FRAME, G.compose(F.col("rz"), F.col("yx")).alias("m"))
    there = m.select(*FRAME, G.inverse(F.col("m")).alias("i"), *(c.alias(n) for n, c in zip("xyz", G.apply(F.col("m"), F.lit(1.0), F.lit(2.0), F.lit(3.0)), strict=True)))
    back = G.apply(F.col("i"), F.col("x"), F.col("y"), F.col("z"))
    return there.select(*FRAME, *((F.round(n, 5) + 0.0).alias(n) for n in "xyz"), *(F.round(c, 6).alias(f"back_{n}") for n, c in zip("xyz", back, strict=True)))


@query("geo_18_rigid_validation", f"WITH {POSES} SELECT {FR}, CASE frame_index % 4 WHEN 1 THEN 'scaled' WHEN 2 THEN 'mirrored' WHEN 3 THEN 'last row' ELSE 'sound' END AS kind, frame_index % 4 = 0 AS rigid FROM poses")
def geo_18(s, d):
    k = F.col("frame_index") % 4
    kind = F.when(k == 1, "scaled").when(k == 2, "mirrored").when(k == 3, "last row").otherwise("sound")

    def spoiled(x, i):
        # A scaled rotation, a reflected third axis, a last row that isn't (0, 0, 0, 1).
        return F.when((k == 1) & (i < 12) & (i % 4 < 3), x * 1.001).when((k == 2) & (i < 12) & (i % 4 == 2), -x).when((k == 3) & (i == 12), F.lit(0.5)).otherwise(x)

    return oracle(s, d).select(*FRAME, kind.alias("kind"), F.transform("oracle", spoiled).alias("m")).select(*FRAME, "kind", G.is_rigid(F.col("m")).alias("rigid"))


@query("geo_19_calibration_chains", f"""WITH {TURNS}, v AS (SELECT *, cos(turn) * (tx - 0.5) + sin(turn) * (ty + 0.25) AS vx, cos(turn) * (ty + 0.25) - sin(turn) * (tx - 0.5) AS vy, tz - 0.75 AS vz, cos(turn) * (ty - 0.5) + sin(turn) * (-tx + 0.25) AS mx, cos(turn) * (-tx + 0.25) - sin(turn) * (ty - 0.5) AS my,
  cos(turn) * tx - sin(turn) * ty + 0.5 AS lx, sin(turn) * tx + cos(turn) * ty - 0.25 AS ly, tz + 0.75 AS lz FROM t)
SELECT {FR}, round(vx, 5) + 0 AS imu_x, round(vy, 5) + 0 AS imu_y, round(vz, 5) + 0 AS imu_z, round(mx, 5) + 0 AS model_x, round(my, 5) + 0 AS model_y,
  round(cos(0.01) * (-ly) + sin(0.01) * (lx - 0.3), 5) + 0 AS camera_x, round(-lz - 0.1, 5) + 0 AS camera_y, round(cos(0.01) * (lx - 0.3) - sin(0.01) * (-ly), 5) + 0 AS camera_z FROM v""")
def geo_19(s, d):
    imu_to_velo = G.rigid(G.rotation("z", F.col("turn")), [F.lit(0.5), F.lit(-0.25), F.lit(0.75)])
    velo_to_camera = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 0, 0, 0, -1, -0.1, 1, 0, 0, -0.3, 0, 0, 0, 1)))
    chains = G.calibration_chains(F.col("imu_to_velo"), velo_to_camera, G.rigid(G.rotation("y", F.lit(0.01)), [F.lit(0.0)] * 3))
    c = turning(s, d).withColumn("imu_to_velo", imu_to_velo).select(*FRAME, *P.PLACE, *(v.alias(k) for k, v in chains.items()))
    at = {k: G.apply(F.col(k), *(F.col(t) for t in P.PLACE)) for k in chains}
    named = [("imu", "velo_to_imu", "xyz"), ("model", "model_to_imu", "xy"), ("camera", "camera_from_imu", "xyz")]
    return c.select(*FRAME, *((F.round(at[k]["xyz".index(a)], 5) + 0.0).alias(f"{n}_{a}") for n, k, axes in named for a in axes))
