"""Joint arrays, world coordinates, angles and contacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridegrid.functions.numbers import clip, finite, norm2, norm3, wrap_deg

# Joint indices of the pose model, statuses and gates.
L_SHOULDER, R_SHOULDER = 5, 6
L_HIP, R_HIP = 9, 10
L_KNEE, R_KNEE = 11, 12
L_ANKLE, R_ANKLE = 13, 14
L_BIG_TOE, L_SMALL_TOE, L_HEEL = 15, 16, 17
R_BIG_TOE, R_SMALL_TOE, R_HEEL = 18, 19, 20
LEFT_FOOT = (13, 15, 16, 17)
RIGHT_FOOT = (14, 18, 19, 20)
FEET = (13, 14, 15, 16, 17, 18, 19, 20)
CONTACT_MARGIN_M = 0.055
ABSENT_STATUSES = (
    "subject_not_initialized", "subject_lost", "subject_absent", "no_output", "masked",
)


@dataclass(frozen=True)
class Vec:
    """Three coordinate columns; null coordinates mean a missing point."""

    x: Column
    y: Column
    z: Column

    def __add__(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, k) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    @property
    def norm(self) -> Column:
        return norm3(self.x, self.y, self.z)

    @property
    def present(self) -> Column:
        return self.x.isNotNull() & self.y.isNotNull() & self.z.isNotNull()

    def map(self, fn) -> "Vec":
        return Vec(fn(self.x), fn(self.y), fn(self.z))

    def where(self, cond: Column) -> "Vec":
        return self.map(lambda c: F.when(cond, c))

    def or_else(self, o: "Vec") -> "Vec":
        return Vec(
            *[
                F.when(self.present, a).otherwise(b)
                for a, b in zip((self.x, self.y, self.z), (o.x, o.y, o.z))
            ]
        )

    def named(self, name: str) -> dict[str, Column]:
        return {f"{name}_x": self.x, f"{name}_y": self.y, f"{name}_z": self.z}

    @staticmethod
    def cols(name: str) -> "Vec":
        return Vec(F.col(f"{name}_x"), F.col(f"{name}_y"), F.col(f"{name}_z"))


def cam_to_world(x: Column, y: Column, z: Column) -> Vec:
    return Vec(-z, x, -y)


def hand_to_world(x: Column, y: Column, z: Column) -> Vec:
    return Vec(x, z, -y)


def cam_to_display(x: Column, y: Column, z: Column, centre_x, centre_z) -> Vec:
    """World point recentred on the display anchor."""
    return Vec(-z + centre_z, x - centre_x, -y)


def parse_joints(joints: Column) -> Column:
    """First three finite values of every joint, null if any joint lacks them."""
    ok = F.forall(
        joints,
        lambda j: F.coalesce(
            (F.size(j) >= 3) & F.forall(F.slice(j, 1, 3), lambda v: finite(v)), F.lit(False)
        ),
    )
    return F.when(ok, F.transform(joints, lambda j: F.slice(j, 1, 3)))


def parse_triplet(arr: Column, default: Column | None = None) -> Column:
    ok = (F.size(arr) >= 3) & F.forall(F.slice(arr, 1, 3), lambda v: finite(v))
    picked = F.when(F.coalesce(ok, F.lit(False)), F.slice(arr, 1, 3))
    return picked if default is None else F.coalesce(picked, default)


def joint_world(joints: Column, j: int, present: Column | None = None) -> Vec:
    """World point of one joint; null where absent, short or not finite."""
    raw = F.get(joints, F.lit(j))
    x, y, z = (F.get(raw, F.lit(i)) for i in range(3))
    ok = finite(x) & finite(y) & finite(z)
    if present is not None:
        ok = ok & present
    return cam_to_world(x, y, z).where(ok)


def midpoint(a: Vec, b: Vec) -> Vec:
    return (a + b) * 0.5


def mean_of(points: list[Vec]) -> Vec:
    """Mean of the points that are present, null if none is."""
    n = sum((F.when(p.present, 1.0).otherwise(0.0) for p in points), F.lit(0.0))

    def axis(name: str) -> Column:
        s = sum(
            (F.when(p.present, getattr(p, name)).otherwise(0.0) for p in points), F.lit(0.0)
        )
        return F.when(n > 0, s / n)

    return Vec(axis("x"), axis("y"), axis("z"))


def with_points(df, ids, joints: str = "joints", present: Column | None = None):
    """Add world points ``w<j>_x/_y/_z`` of the joints, each computed once."""
    cols = {}
    for j in ids:
        cols.update(joint_world(F.col(joints), j, present).named(f"w{j}"))
    return df.withColumns(cols)


def point(j: int) -> Vec:
    """World point added by ``with_points``."""
    return Vec.cols(f"w{j}")


def with_root(df, joints: str = "joints", camera_comp: str = "camera_comp"):
    """Hip midpoint (one hip is enough), else joint 0, else the camera shift."""
    df = with_points(df, (L_HIP, R_HIP, 0), joints)
    camera = cam_to_world(*[F.get(F.col(camera_comp), F.lit(i)) for i in range(3)])
    df = df.withColumns({**mean_of([point(L_HIP), point(R_HIP)]).named("hips"), **camera.named("cam")})
    root = Vec.cols("hips").or_else(point(0)).or_else(Vec.cols("cam"))
    return _drop_points(df.withColumns(root.named("root")), (L_HIP, R_HIP, 0), "hips", "cam")


def _drop_points(df, ids, *names: str):
    gone = [f"w{j}_{a}" for j in ids for a in "xyz"] + [f"{n}_{a}" for n in names for a in "xyz"]
    return df.drop(*gone)


def with_foot_contact(df, joints: str = "joints", min_joints: int = 21):
    """Add left_down, right_down, support and the XY of the supporting feet."""
    df = with_points(df, FEET, joints)
    sides = {"l": LEFT_FOOT, "r": RIGHT_FOOT}
    df = df.withColumns(
        {f"_{s}z": F.least(*[point(j).z for j in ids]) for s, ids in sides.items()}
    )
    enough = F.coalesce(F.size(joints), F.lit(0)) >= min_joints
    floor = F.least("_lz", "_rz")
    down = lambda s: F.coalesce(enough & (F.col(f"_{s}z") <= floor + CONTACT_MARGIN_M), F.lit(False))
    df = df.withColumns({"left_down": down("l"), "right_down": down("r")})
    l, r = F.col("left_down"), F.col("right_down")
    df = df.withColumn(
        "support", F.when(l & r, "both").when(l, "left").when(r, "right").otherwise("none")
    )
    means = {"left": LEFT_FOOT, "right": RIGHT_FOOT, "both": FEET}
    for a in ("x", "y"):
        df = df.withColumn(
            f"support_{a}",
            F.coalesce(
                *[
                    F.when(F.col("support") == n, getattr(mean_of([point(j) for j in ids]), a))
                    for n, ids in means.items()
                ]
            ),
        )
    return _drop_points(df, FEET).drop("_lz", "_rz")


def with_foot_centre(df, joints: str = "joints"):
    """Add the mean foot positions ``lfoot`` and ``rfoot``."""
    df = with_points(df, FEET, joints)
    for name, ids in (("lfoot", LEFT_FOOT), ("rfoot", RIGHT_FOOT)):
        df = df.withColumns(mean_of([point(j) for j in ids]).named(name))
    return _drop_points(df, FEET)


def angle_between(a: Vec, centre: Vec, b: Vec) -> Column:
    """Angle in degrees at ``centre``; null for rays shorter than 1e-9."""
    u, v = a - centre, b - centre
    nu, nv = u.norm, v.norm
    cos = clip(u.dot(v) / (nu * nv), -1.0, 1.0)
    return F.when((nu >= 1e-9) & (nv >= 1e-9), F.degrees(F.acos(cos)))


def segment_pitch(start: Vec, end: Vec) -> Column:
    d = end - start
    return F.when(d.present, F.degrees(F.atan2(d.x, d.z)))


def body_axis_angle(joints: Column) -> Column:
    """Heading of the hip axis, or of the shoulder axis where hips are unusable."""

    def heading(left: int, right: int) -> Column:
        d = joint_world(joints, right) - joint_world(joints, left)
        return F.when(norm2(d.x, d.y) >= 1e-6, F.atan2(d.y, d.x))

    return F.coalesce(heading(L_HIP, R_HIP), heading(L_SHOULDER, R_SHOULDER))


def trunk_lean(hips: Vec, shoulders: Vec) -> Column:
    t = shoulders - hips
    return F.when(t.norm > 0, F.degrees(F.acos(clip(t.z / t.norm, -1.0, 1.0))))


def with_body_up(df, joints: str = "joints", present: Column | None = None):
    """Add ``up_x/_y/_z``: unit vector from the feet (or hips) to the shoulders."""
    ids = (L_HIP, R_HIP, L_SHOULDER, R_SHOULDER, *FEET)
    df = with_points(df, ids, joints, present)
    hips = midpoint(point(L_HIP), point(R_HIP))
    shoulders = midpoint(point(L_SHOULDER), point(R_SHOULDER))
    df = df.withColumns({**hips.named("_h"), **shoulders.named("_s")})
    df = df.withColumns(mean_of([point(j) for j in FEET]).named("_f"))
    trunk = Vec.cols("_s") - Vec.cols("_h")
    full = Vec.cols("_s") - Vec.cols("_f")
    df = df.withColumns({**trunk.named("_t"), **full.named("_u")})
    t, u = Vec.cols("_t"), Vec.cols("_u")
    df = df.withColumn("_full", u.present & (u.norm > 1e-5))
    pick = Vec(*[F.when(F.col("_full"), a).otherwise(b) for a, b in zip(u, t)])
    df = df.withColumns(pick.named("_p"))
    p = Vec.cols("_p")
    df = df.withColumn(
        "_n", F.when(t.present & (p.norm > 1e-5) & (F.size(joints) >= 15), p.norm)
    )
    df = df.withColumns((p * (1.0 / F.col("_n"))).named("up"))
    return _drop_points(df, ids, "_h", "_s", "_f", "_t", "_u", "_p").drop("_full", "_n")


def tilt_deg(up: Vec) -> Column:
    return F.degrees(F.acos(clip(up.z, -1.0, 1.0)))


def upright_weight(tilt: Column) -> Column:
    """Share of the tilt to take out: small lean fully, a posture not at all."""
    return (
        F.when(tilt.isNull() | (tilt < 2.0), 0.0)
        .when(tilt <= 25.0, 1.0)
        .when(tilt >= 50.0, 0.0)
        .otherwise(1.0 - (tilt - 25.0) / 25.0)
    )


def sole_pitch(toe: Vec, heel: Vec) -> Column:
    """Pitch of the sole in radians; null where the foot is seen end-on."""
    v = toe - heel
    flat = norm2(v.x, v.y)
    return F.when(flat >= 0.05, F.atan2(v.z, flat))


SAGITTAL_JOINTS = (9, 10, 11, 12, 13, 14, 15, 17, 18, 20)


def with_sagittal_angles(df, prefix: str = "w"):
    """Add hip, knee and ankle angles in the subject's own sagittal plane.

    Reads world points ``<prefix><j>_x/_y/_z`` (already filtered) and adds
    ``hip_left`` ... ``ankle_right`` in degrees.
    """
    p = {j: Vec.cols(f"{prefix}{j}") for j in SAGITTAL_JOINTS}
    axis = p[R_HIP] - p[L_HIP]
    toes = ((L_BIG_TOE, L_HEEL, "l"), (R_BIG_TOE, R_HEEL, "r"))
    df = df.withColumns(
        {
            "_n": norm2(axis.x, axis.y),
            **{f"_{s}n": norm2((p[t] - p[h]).x, (p[t] - p[h]).y) for t, h, s in toes},
        }
    )
    cols = {"_ux": axis.x / F.col("_n"), "_uy": axis.y / F.col("_n")}
    for toe, heel, s in toes:
        d = p[toe] - p[heel]
        ok = d.present & (F.col(f"_{s}n") > 1e-6)
        cols[f"_{s}x"] = F.when(ok, d.x / F.col(f"_{s}n"))
        cols[f"_{s}y"] = F.when(ok, d.y / F.col(f"_{s}n"))
    df = df.withColumns(cols)
    both = F.col("_lx").isNotNull() & F.col("_rx").isNotNull()
    df = df.withColumns(
        {
            f"_f{a}": F.when(both, (F.col(f"_l{a}") + F.col(f"_r{a}")) / 2.0).otherwise(
                F.coalesce(f"_l{a}", f"_r{a}")
            )
            for a in "xy"
        }
    )
    along = F.col("_fx") * F.col("_ux") + F.col("_fy") * F.col("_uy")
    df = df.withColumn("_along", along)
    df = df.withColumns({f"_g{a}": F.col(f"_f{a}") - F.col("_along") * F.col(f"_u{a}") for a in "xy"})
    df = df.withColumn("_g", norm2(F.col("_gx"), F.col("_gy")))
    usable = (F.col("_n") >= 1e-6) & (F.col("_g") >= 1e-6) & axis.present
    df = df.withColumns({f"_e{a}": F.when(usable, F.col(f"_g{a}") / F.col("_g")) for a in "xy"})

    def pitch(v: Vec) -> Column:
        return F.degrees(F.atan2(v.z, v.x * F.col("_ex") + v.y * F.col("_ey")))

    for side, hip, knee, ankle, toe, heel in (
        ("left", L_HIP, L_KNEE, L_ANKLE, L_BIG_TOE, L_HEEL),
        ("right", R_HIP, R_KNEE, R_ANKLE, R_BIG_TOE, R_HEEL),
    ):
        leg = p[hip].present & p[knee].present & p[ankle].present
        df = df.withColumns(
            {
                "_thigh": F.when(leg, pitch(p[knee] - p[hip])),
                "_shank": F.when(leg, pitch(p[ankle] - p[knee])),
                "_sole": pitch(p[toe] - p[heel]),
            }
        )
        thigh, shank = F.col("_thigh"), F.col("_shank")
        df = df.withColumns(
            {
                f"hip_{side}": wrap_deg(thigh + 90.0),
                f"knee_{side}": wrap_deg(thigh - shank),
                f"ankle_{side}": wrap_deg(F.col("_sole") - (shank + 90.0)),
            }
        )
    return df.drop(
        "_n", "_ln", "_rn", "_ux", "_uy", "_lx", "_ly", "_rx", "_ry", "_fx", "_fy", "_along",
        "_gx", "_gy", "_g", "_ex", "_ey", "_thigh", "_shank", "_sole",
    )


def centre_of_mass(joints: Column) -> Vec:
    """Unweighted mean of all joints."""
    n = F.size(joints)

    def axis(i: int) -> Column:
        s = F.aggregate(joints, F.lit(0.0), lambda acc, j: acc + F.get(j, F.lit(i)))
        return F.when(n > 0, s / n)

    return cam_to_world(axis(0), axis(1), axis(2))


def lowest_joint(joints: Column, ids: tuple[int, ...] | None = None) -> Column:
    """Lowest height over the feet (or any ids), or over the whole body."""
    if ids is None:
        return F.array_min(F.transform(joints, lambda j: -F.get(j, F.lit(1))))
    low = F.least(*[joint_world(joints, j).z for j in ids])
    return F.when(F.size(joints) >= 15, low)


def with_centroid(df, ids: tuple[int, ...] = (5, 6, 9, 10, 11, 12, 13, 14), joints: str = "joints"):
    """Add ``centroid``: mean of the named joints, or of all where none is usable."""
    df = with_points(df, ids, joints)
    df = df.withColumns(
        {**mean_of([point(j) for j in ids]).named("_m"), **centre_of_mass(F.col(joints)).named("_c")}
    )
    df = df.withColumns(Vec.cols("_m").or_else(Vec.cols("_c")).named("centroid"))
    return _drop_points(df, ids, "_m", "_c")


def lerp_joints(a: Column, b: Column, t: Column) -> Column:
    """Joint arrays blended by ``t``; ``a`` where the shapes differ."""
    mixed = F.zip_with(
        a, b, lambda p, q: F.zip_with(p, q, lambda u, v: u + (v - u) * t)
    )
    return F.when(b.isNotNull() & (F.size(a) == F.size(b)), mixed).otherwise(a)


def subject_present(explicit: Column, is_lost: Column, status: Column) -> Column:
    gone = F.coalesce(is_lost, F.lit(False)) | F.coalesce(
        status.isin(*ABSENT_STATUSES), F.lit(False)
    )
    return F.coalesce(explicit, ~gone)


def record_status(present: Column, identity_status: Column) -> dict[str, Column]:
    return {
        "inference_status": F.when(present, "ok")
        .when(identity_status == "absent", "subject_absent")
        .otherwise("subject_lost"),
        "tracking_status": F.coalesce(
            identity_status, F.when(present, "tracked").otherwise("subject_lost")
        ),
    }


def meaningful_root(present: Column, root: Vec) -> Column:
    return F.coalesce(present & (root.norm > 1e-4), F.lit(False))


def joint_label(joint_id: Column) -> Column:
    # Names of the exported joints.
    names = {
        5: "left_shoulder", 6: "right_shoulder", 9: "left_hip", 10: "right_hip",
        11: "left_knee", 12: "right_knee", 13: "left_ankle", 14: "right_ankle",
        15: "left_big_toe", 16: "left_small_toe", 17: "left_heel",
        18: "right_big_toe", 19: "right_small_toe", 20: "right_heel",
    }
    expr = F.concat(F.lit("joint"), F.lpad(joint_id.cast("string"), 2, "0"))
    for j, name in reversed(names.items()):
        expr = F.when(joint_id == j, name).otherwise(expr)
    return expr


def signal_joint(signal_id: Column) -> Column:
    """Joint a signal refers to: a body part in its id, else ``joint.N.``."""
    # Body parts searched in this order.
    parts = (
        ("shoulder.left", 5), ("shoulder.right", 6), ("hip.left", 9), ("hip.right", 10),
        ("knee.left", 11), ("knee.right", 12), ("ankle.left", 13), ("ankle.right", 14),
        ("toe.left", 15), ("toe.right", 18), ("heel.left", 17), ("heel.right", 20),
    )
    number = F.regexp_extract(signal_id, r"^joint\.(\d+)\.", 1)
    expr = F.when(number != "", number.cast("int"))
    for text, j in reversed(parts):
        expr = F.when(signal_id.contains(text), j).otherwise(expr)
    return expr


def signal_group(unit: Column, signal_id: Column) -> Column:
    """Plot group of a signal from its unit and id."""
    return (
        F.when(unit == "deg", "angles")
        .when((unit == "m/s") & signal_id.endswith(".vz"), "verticalSpeed")
        .when(unit == "m/s^2", "acceleration")
        .when((unit == "m") & signal_id.contains("distance"), "distance")
        .when(
            (unit == "m") & ~signal_id.contains("delta") & ~signal_id.endswith(".speed"),
            "position",
        )
        .when(unit == "m/s", "speed")
        .when(unit == "deg/s", "rotation")
    )
