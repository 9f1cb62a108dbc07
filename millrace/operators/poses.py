"""A temporal graph of frames: edge histories, as-of reads with interpolation, and composition along the tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ordering import highest_before, known, last_known, matched
from ..functions.rotations import interpolate, inverse, multiply, slerp_pose

MODES = ("previous", "nearest", "linear", "extrapolate", "slerp", "extrapolate_slerp")


def accepted(df: DataFrame, edge: list[str], at: str, order: list[str], bucket: Column) -> DataFrame:
    """The updates that a history accepts, in arrival ``order``: each must be later than all accepted before it on its edge.

    That is the running maximum of the times. ``bucket`` is coarser than the arrival order (see ordering).
    """
    rows = highest_before(df, edge, order, bucket, F.col(at), "most_")
    return rows.where(F.col("most_").isNull() | (F.col(at) > F.col("most_"))).drop("most_")


def recent(df: DataFrame, edge: list[str], at: str, size: int = 1024) -> DataFrame:
    """The last ``size`` samples of each edge."""
    w = Window.partitionBy(*edge).orderBy(F.desc(at))
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= size).drop("rank_")


def newest(df: DataFrame, edge: list[str], at: str, value: str, valid: str) -> DataFrame:
    """(edge, at, value, valid): the latest sample of each edge, a disconnected one included (``valid`` is false)."""
    return df.groupBy(*edge).agg(F.max_by(F.struct(at, value, valid), at).alias("s_")).select(*edge, "s_.*")


def reads(asked: DataFrame, history: DataFrame, edge: list[str], at: str, value: str, bucket: Callable[[Column], Column], version_bucket: Callable[[Column], Column], mode: str = "linear", id_col: str = "id") -> DataFrame:
    """(edge, id, at, value): each asked time's value of its edge; null where the edge has none then.

    ``history`` (edge, at, value, version, valid) is in order: versions rise with times. ``asked`` (edge, id, at, version): samples
    of later versions are not seen. At or before the asked time the last sample counts; if it is a disconnection there is no
    value. A next sample that is disconnected or not seen is left out, and then reads are as after the last one.
    Extrapolation goes on from the last two samples, and needs them. Values are numbers, or poses (see rotations): ``linear`` and
    ``extrapolate`` take their rotations along the arc and their translations along the line, the ``slerp`` forms go along the screw motion. ``bucket`` and ``version_bucket`` make a time and a
    version coarser (see ordering).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    sample = F.struct(F.col(at).alias("t"), F.col(value).alias("x"), F.col("version").alias("v"), F.col("valid").alias("ok"))
    own = history.select(*edge, F.col(at).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast("long").alias("id_"), F.col("version").alias("see_"), sample.alias("got_"))
    if mode.startswith("extrapolate"):
        own = _previous(own, edge, bucket(F.col("t_"))).select(*edge, "t_", "side_", F.lit(None).cast("long").alias("id_"), "see_", F.struct("got_.*", F.col("before_").alias("b")).alias("got_"))
    kind = own.schema["got_"].dataType
    ask = asked.select(*edge, F.col(at).alias("t_"), F.lit(1).alias("side_"), F.col(id_col).cast("long").alias("id_"), F.col("version").alias("see_"), F.lit(None).cast(kind).alias("got_"))
    both = own.unionAll(ask)
    order = ["t_", "side_", "id_"]
    # as versions rise with times, the last sample seen is the last one up to the asked time and up to the version's own time
    axis = both.withColumn("n_", F.when(F.col("side_") == 0, F.col("t_")))
    axis = last_known(axis, edge, ["see_", *order], version_bucket(F.col("see_")), F.col("n_"), "end_").drop("n_")
    nothing = F.lit(-(1 << 62)).cast(dict(axis.dtypes)["t_"])
    read_at = F.when(F.col("side_") == 0, F.col("t_")).when(F.col("end_").isNull(), nothing).otherwise(F.least("t_", "end_"))
    rows = axis.withColumn("asked_", F.col("t_")).withColumn("t_", read_at).drop("end_")
    rows = known(rows, edge, order, bucket(F.col("t_")), last=(F.col("got_"), "p_"), next_=(F.col("got_"), "n_")).where("side_ = 1")
    t, p = F.col("asked_"), F.col("p_")
    seen = F.when((F.col("n_.v") <= F.col("see_")) & F.col("n_.ok") & (F.col("n_.t") > t), F.col("n_"))
    rows = rows.withColumn("n_", seen)
    n = F.col("n_")
    if mode == "previous":
        x = p["x"]
    elif mode == "nearest":
        x = F.when(n.isNotNull() & (n["t"] - t < t - p["t"]), n["x"]).otherwise(p["x"])
    else:
        if isinstance(kind["x"].dataType, StructType):
            between_ = slerp_pose if "slerp" in mode else interpolate
        else:
            between_ = lambda a, b, share: a + (b - a) * share
        line = between_(p["x"], n["x"], (t - p["t"]) / (n["t"] - p["t"]))
        after = p["x"]
        if mode.startswith("extrapolate"):
            b = p["b"]
            onward = between_(b["x"], p["x"], (t - b["t"]) / (p["t"] - b["t"]))
            after = F.when(t == p["t"], p["x"]).when(b.isNotNull() & b["ok"], onward)
        x = F.when(n.isNotNull(), line).otherwise(after)
    return rows.select(*edge, F.col("id_").alias("id"), t.alias("at"), F.when(p["ok"], x).alias("value"))


def _previous(own: DataFrame, edge: list[str], bucket: Column) -> DataFrame:
    """``own`` with ``before_``, the sample before each."""
    df = own.withColumn("bucket_", bucket)
    back = Window.partitionBy(*edge, "bucket_").orderBy("t_")
    ends = df.groupBy(*edge, "bucket_").agg(F.max_by("got_", "t_").alias("end_"))
    ends = ends.withColumn("base_", F.last("end_").over(Window.partitionBy(*edge).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))).drop("end_")
    return df.withColumn("own_", F.lag("got_").over(back)).transform(lambda d: matched(d, ends, [*edge, "bucket_"])).withColumn("before_", F.coalesce("own_", "base_")).drop("own_", "base_", "bucket_")


def to_root(frames: DataFrame, combine=multiply) -> DataFrame:
    """(frame, root, depth, pose): each frame's pose in its root, for a tree given as (frame, parent, pose); roots have a null parent and no pose.

    Doubling: each round joins a frame's path with its end's path, so the deepest frame takes about log2(depth) joins. Rounds end
    when no path has a parent beyond its end. Frames in or below a cycle have no root: their paths go round for ever, which shows
    by a path longer than there are frames, and raises an error. A parent that is no frame is a root.
    """
    now = frames.select("frame", F.coalesce("parent", "frame").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"), "pose")
    n = now.count()
    while True:
        up = now.where("depth > 0").select(F.col("frame").alias("root"), F.col("root").alias("to_"), F.col("pose").alias("more_"), F.col("depth").alias("add_"))
        now = now.join(up, "root", "left").select("frame", F.coalesce("to_", "root").alias("root"), (F.col("depth") + F.coalesce("add_", F.lit(0))).alias("depth"), F.when(F.col("add_").isNull(), F.col("pose")).otherwise(combine(F.col("more_"), F.col("pose"))).alias("pose"), F.col("add_").isNotNull().alias("moved_"))
        now = _kept(now)
        moved, deepest = now.agg(F.bool_or("moved_"), F.max("depth")).first()
        if (deepest or 0) > n:
            raise ValueError("the frames have a cycle")
        now = now.drop("moved_")
        if not moved:
            return now.withColumn("depth", F.col("depth").cast("int"))


def in_cycles(frames: DataFrame) -> DataFrame:
    """(frame): the frames that are their own ancestors, of (frame, parent) with one row a frame.

    Doubling: after as many steps as there are frames, a path has ended or is on a cycle, and every frame of a cycle is the end of one.
    """
    now = _kept(frames.where("frame is not null and parent is not null").select("frame", "parent"))
    for _ in range(now.count().bit_length()):
        up = now.select(F.col("frame").alias("parent"), F.col("parent").alias("up_"))
        now = _kept(now.join(up, "parent").select("frame", F.col("up_").alias("parent")))
        if now.isEmpty():
            break
    return now.select(F.col("parent").alias("frame")).distinct()


def tree_edges(edges: DataFrame, order: str) -> DataFrame:
    """``edges`` (lhs, rhs, ``order``, ...) with ``accepted``: false for an edge between frames that earlier accepted ones connect already.

    An edge given again, either way round, is as it was the first time; an edge of a frame with itself is not accepted, nor is one with a null end. ``order``
    is unique. The accepted edges are the least spanning forest by ``order``, so the forest's components may grow side by side (Borůvka): each
    takes its least edge to another one, and about log2(frames) rounds find all.
    """
    ends = (F.least("lhs", "rhs").alias("a"), F.greatest("lhs", "rhs").alias("b"))
    valid = edges.where("lhs is not null and rhs is not null and lhs <> rhs")
    open_ = _kept(valid.groupBy(*ends).agg(F.min(order).alias("at_")).select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), "at_"))
    taken = open_.select("a", "b").limit(0)
    while not open_.isEmpty():
        ways = open_.select("x", "y", "at_", "a", "b").unionAll(open_.select("y", "x", "at_", "a", "b"))
        best = _kept(ways.groupBy("x").agg(F.min_by(F.struct("y", "a", "b"), "at_").alias("to_")).select("x", "to_.*"))
        taken = _kept(taken.unionAll(best.select("a", "b")).distinct())
        # two components that chose each other: the lesser one leads
        back = best.select(F.col("x").alias("y"), F.col("y").alias("back_"))
        up = best.join(back, "y").select("x", F.when((F.col("back_") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y"))
        up = _kept(up)
        while True:
            two = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved_"))
            two = _kept(two)
            up = two.select("x", "y")
            if two.where("moved_").isEmpty():
                break
        to = lambda c: up.select(F.col("x").alias(c), F.col("y").alias(f"{c}_"))  # noqa: B023, E731
        open_ = _kept(open_.join(to("x"), "x").join(to("y"), "y").where("x_ <> y_").select("a", "b", F.col("x_").alias("x"), F.col("y_").alias("y"), "at_"))
    keyed = edges.withColumns({"a_": F.least("lhs", "rhs"), "b_": F.greatest("lhs", "rhs")})
    marks = taken.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.lit(True).alias("in_"))
    real = F.col("lhs").isNotNull() & F.col("rhs").isNotNull()  # least() passes over a null
    return keyed.join(marks, ["a_", "b_"], "left").withColumn("accepted", F.coalesce("in_", F.lit(False)) & real).drop("a_", "b_", "in_")


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def between(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lhs, rhs, pose): the pose of rhs in lhs, of frames that share a root (``paths`` of :func:`to_root`, roots with the identity)."""
    a = paths.select(F.col("frame").alias("lhs"), F.col("root").alias("a_"), F.col("pose").alias("p_"))
    b = paths.select(F.col("frame").alias("rhs"), F.col("root").alias("b_"), F.col("pose").alias("q_"))
    return pairs.join(a, "lhs").join(b, "rhs").where("a_ = b_").select("lhs", "rhs", multiply(inverse(F.col("p_")), F.col("q_")).alias("pose"))


#: The longest name of a frame.
MOST_NAME = 127


def frame_problems(frames: DataFrame) -> DataFrame:
    """(frame, problem): names that are empty, too long, begin with an underscore, or are there twice; frames whose parent is missing; frames on a cycle."""
    counts = frames.groupBy("frame").agg(F.count(F.lit(1)).alias("n_"), F.max("parent").alias("parent"))
    cycle = in_cycles(counts).withColumn("problem", F.lit("cycle"))
    known = counts.select(F.col("frame").alias("parent"), F.lit(True).alias("known_"))
    found = F.array(
        F.when(F.col("frame").isNull() | (F.col("frame") == ""), "no name"),
        F.when(F.length("frame") > MOST_NAME, "long name"),
        F.when(F.col("frame").startswith("_"), "reserved name"),
        F.when(F.col("n_") > 1, "repeated name"),
        F.when(F.col("parent").isNotNull() & F.col("known_").isNull(), "no such parent"),
    )
    joined = counts.join(known, "parent", "left")
    return joined.select("frame", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")).unionAll(cycle)


def canonical(edges: DataFrame) -> DataFrame:
    """``edges`` (lhs, rhs, pose, ...) with lhs < rhs: those the other way round are turned and their poses inverted."""
    turn = F.col("lhs") > F.col("rhs")
    both = edges.withColumn("pose", F.when(turn, inverse(F.col("pose"))).otherwise(F.col("pose")))
    return both.withColumns({"lhs": F.when(turn, F.col("rhs")).otherwise(F.col("lhs")), "rhs": F.when(turn, F.col("lhs")).otherwise(F.col("rhs"))})


def is_rigid(pose: Column, tolerance: float = 1e-6) -> Column:
    """Whether all seven numbers are finite and the quaternion has length 1."""
    finite = F.lit(True)
    for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"):
        finite = finite & pose[c].isNotNull() & ~F.isnan(pose[c]) & (F.abs(pose[c]) < float("inf"))
    norm = sum((pose[c] * pose[c] for c in ("qx", "qy", "qz")), pose["qw"] * pose["qw"])
    return finite & (F.abs(norm - 1) < tolerance)


def disconnected(history: DataFrame, cuts: DataFrame, edge: list[str], at: str, value: str) -> DataFrame:
    """``history`` with a sample that is not valid for each of ``cuts`` (edge, at, version)."""
    kind = dict(history.dtypes)[value]
    gone = cuts.select(*edge, at, "version", F.lit(None).cast(kind).alias(value), F.lit(False).alias("valid"))
    return history.unionByName(gone, allowMissingColumns=True)
