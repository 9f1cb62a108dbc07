"""Golden cases and invariants of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import durations, metadata, ordering, rotations, tensors
from millrace.operators import conditions, images, inference, poses, queues, routing, tracking
from millrace.sources import generators, recording


def latencies(spark, values):
    return spark.createDataFrame([("a,b", i, float(v)) for i, v in enumerate(values)], "path string, seq int, latency double")


@pytest.mark.parametrize(
    ("values", "skip", "discard", "threshold", "n", "most"),
    [([1, 2, 3, 4, 5], 5, 0, 0, 0, None), ([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], 5, 0, 0, 5, 5), ([4, 6, 5, 3, 7], 0, 0, 5, 3, 7), ([1, 2, 3, 4, 5] * 2, 0, 5, 0, 5, 5), ([1, 2, 3, 4, 5, *range(1, 11), 5], 5, 10, 0, 1, 1), ([1, 2, 3, 4, 5, 12, 12, 12, 12, 12, 8, 10], 5, 0, 10, 1, 10)],
)
def test_latency_report(spark, values, skip, discard, threshold, n, most):
    got = tracking.latency_report(latencies(spark, values), "path", "latency", ["seq"], threshold, skip, discard).collect()
    assert [(r["n"], r["max_ms"]) for r in got] == ([(n, most)] if n else [])


def test_latest_of_equal_extremes_counts(spark):
    r = tracking.latency_report(latencies(spark, [1, 5, 5, 1, 3]), "path", "latency", ["seq"], 0, 0, 0).first()
    assert (r["max_no"], r["min_no"], r["avg_ms"]) == (3, 4, 3.0)


def test_latency_report_sorts_no_more_than_the_edges(spark):
    """Rows that are all equal in the first order column, or have none, are told apart by the second; the rest is hashed."""
    rng = random.Random(5)
    rows = [(p, rng.choice([None, *range(4)]), i, float(rng.randint(0, 5))) for p in "abc" for i in range(60)] + [("d", None, i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "path string, us long, id long, latency double")
    got = {r["path"]: tuple(r)[1:] for r in tracking.latency_report(df, "path", "latency", ["us", "id"], 1, 10, 10).collect()}
    for p in "abcd":
        own = sorted((-1 if us is None else us, i, x) for q, us, i, x in rows if q == p and x >= 1)[10:-10]
        xs = [x for _, _, x in own]
        assert got[p] == (len(xs), max(xs), max(i for i, x in enumerate(xs, 1) if x == max(xs)), min(xs), max(i for i, x in enumerate(xs, 1) if x == min(xs)), pytest.approx(sum(xs) / len(xs)))
    plan = tracking.latency_report(df, "path", "latency", ["us", "id"], 0, 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort " not in plan


def test_metadata_merge(spark):
    df = spark.sql("SELECT map('key1', '5', 'key2', '10') AS a, map('key1', '3', 'key3', '20') AS b, cast(null as map<string,string>) AS c")
    one = lambda x: df.select(x.alias("x")).first()["x"]
    assert one(metadata.merge(F.col("a"), F.col("b"), "update")) == {"key1": "3", "key2": "10", "key3": "20"}
    assert one(metadata.merge(F.col("a"), F.col("b"), "reject")) == {"key1": "5", "key2": "10", "key3": "20"}
    assert one(metadata.merge(F.col("a"), F.col("c"))) == {"key1": "5", "key2": "10"}
    with pytest.raises(Exception, match="both sides"):
        one(metadata.merge(F.col("a"), F.col("b"), "raise"))
    assert one(metadata.merge_ports([F.col("a"), F.col("b"), F.col("c")], "update"))["key1"] == "3"
    assert one(metadata.get(metadata.put(F.col("a"), "k", F.lit(1)), "k")) == "1"
    assert one(metadata.get(F.col("a"), "none", F.lit("x"))) == "x"
    assert one(metadata.emitted(metadata.erase(F.col("a"), "key1", "key2"))) is None


def history(spark, samples):
    return spark.createDataFrame([(1, float(t), int(v), float(x), ok) for t, v, x, ok in samples], "edge int, t double, version long, x double, valid boolean")


def read(spark, samples, asked, mode):
    ask = spark.createDataFrame([(1, i, float(t), v) for i, (t, v) in enumerate(asked)], "edge int, id long, t double, version long")
    coarse = lambda c: F.floor(c / 7).cast("long")
    got = poses.reads(ask, history(spark, samples), ["edge"], "t", "x", coarse, coarse, mode).collect()
    return [r["value"] for r in sorted(got, key=lambda r: r["id"])]


TWO = [(1, 1, 1, True), (2, 2, 2, True)]
ASKED = [(-1, 1024), (1.5, 0), (1, 1024), (1.49, 1024), (1.51, 1024), (1.51, 1), (11.51, 1024)]


@pytest.mark.parametrize(("mode", "want"), [("nearest", [None, None, 1, 1, 2, 1, 2]), ("previous", [None, None, 1, 1, 1, 1, 2]), ("linear", [None, None, 1, 1.49, 1.51, 1, 2])])
def test_edge_history(spark, mode, want):
    assert read(spark, TWO, ASKED, mode) == [w if w is None else pytest.approx(w) for w in want]


def test_extrapolation(spark):
    assert read(spark, [*TWO, (3, 3, 3, True)], [(11.51, 1024), (1.5, 1)], "extrapolate") == [pytest.approx(11.51), None]


@pytest.mark.parametrize(("mode", "want"), [("nearest", [2, 2, None, 2, 4]), ("linear", [1.51, 2, None, 2, 4]), ("extrapolate", [1.51, 2.51, None, 3.51, None])])
def test_disconnected_edge(spark, mode, want):
    samples = [*TWO, (3, 3, 0, False), (4, 4, 4, True)]
    got = read(spark, samples, [(1.51, 1024), (2.51, 1024), (3.51, 1024), (3.51, 2), (4.51, 1024)], mode)
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_updates_must_be_later(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 1.0, 1.0, 2.0, 1.5])], "edge int, seq int, t double")
    got = poses.accepted(df, ["edge"], "t", ["seq"], F.floor(F.col("seq") / 2)).collect()
    assert sorted(r["seq"] for r in got) == [0, 1, 3]


def test_rotations(spark):
    half = math.sqrt(0.5)
    df = spark.range(1).select(rotations.pose(1, 0, 0, 0, 0, 0, 0).alias("a"), rotations.pose(half, 0, half, 0, 3, 3, 3).alias("b"))
    r = df.select(rotations.interpolate(F.col("a"), F.col("b"), F.lit(0.5)).alias("m"), rotations.multiply(F.col("b"), rotations.inverse(F.col("b"))).alias("i"), rotations.angle(F.col("b")).alias("w")).first()
    assert r["w"] == pytest.approx(math.pi / 2)
    assert tuple(r["i"]) == pytest.approx((1, 0, 0, 0, 0, 0, 0), abs=1e-12)
    assert 2 * math.acos(r["m"]["qw"]) == pytest.approx(math.pi / 4) and r["m"]["tx"] == 1.5


def test_tree_composition(spark):
    rows = [("f0", None)] + [(f"f{i}", f"f{i // 3}") for i in range(1, 40)]
    frames = spark.createDataFrame(rows, "frame string, parent string").withColumn("pose", F.when(F.col("parent").isNotNull(), rotations.about_z(0.3, 1.0, 2.0, 0.5)).otherwise(rotations.pose(1, 0, 0, 0, 0, 0, 0)))
    paths = poses.to_root(frames)
    assert {r["root"] for r in paths.select("root").collect()} == {"f0"}
    assert {r["frame"]: r["depth"] for r in paths.collect()}["f39"] == 4
    pairs = spark.createDataFrame([("f39", "f5"), ("f5", "f39")], "lhs string, rhs string")
    got = {r["lhs"]: r["pose"] for r in poses.between(paths, pairs).collect()}
    both = spark.createDataFrame([(got["f39"], got["f5"])], "a struct<qw:double,qx:double,qy:double,qz:double,tx:double,ty:double,tz:double>, b struct<qw:double,qx:double,qy:double,qz:double,tx:double,ty:double,tz:double>")
    assert tuple(both.select(rotations.multiply(F.col("a"), F.col("b")).alias("i")).first()["i"])[4:] == pytest.approx((0, 0, 0), abs=1e-9)


@pytest.mark.parametrize(("policy", "ticks", "ran"), [("catch", [0, 250, 255, 299, 300, 301], [0, 250, 255, 300]), ("grid", [0, 250, 299, 305, 399], [0, 250, 305]), ("gap", [0, 101, 150, 350, 449, 450], [0, 101, 350, 450])])
def test_periodic_ticks(spark, policy, ticks, ran):
    df = spark.createDataFrame([(1, t) for t in ticks], "k int, t long")
    if policy == "catch":
        got = conditions.catch_up_ticks(df, ["k"], "t", ["t"], 100, F.floor(F.col("t") / 200).cast("long"))
    else:
        got = conditions.grid_ticks(df, ["k"], "t", ["t"], 100) if policy == "grid" else conditions.min_gap_ticks(df, ["k"], "t", ["t"], F.floor(F.col("t") / 150), 100)
    assert sorted(r["t"] for r in got.collect()) == ran


def test_condition_algebra(spark):
    df = spark.createDataFrame([("a", "READY", 100), ("a", "WAIT_TIME", 150), ("a", "WAIT", 0), ("b", "READY", 120), ("b", "NEVER", 0)], "k string, state string, at long")
    assert {r["k"]: (r["state"], r["at"]) for r in conditions.any_of(df, ["k"], "state", "at").collect()} == {"a": ("READY", 100), "b": ("NEVER", 0)}
    assert {r["k"]: (r["state"], r["at"]) for r in conditions.all_of(df, ["k"], "state", "at").collect()} == {"a": ("WAIT", 0), "b": ("NEVER", 0)}


def test_queues_part_their_input(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(rng.randint(0, 5), i) for i in range(60)], "k int, seq int")
    first = {(r["k"], r["seq"]) for r in queues.bounded(df, ["k"], ["seq"], 3, "reject").collect()}
    last = {(r["k"], r["seq"]) for r in queues.bounded(df, ["k"], ["seq"], 3, "pop").collect()}
    assert len(first) == len(last) == 18 and max(s for _, s in first) < max(s for _, s in last)
    with pytest.raises(Exception, match="overflow"):
        queues.strict(df, ["k"], 3).collect()
    assert queues.strict(df, ["k"], 60).count() == 60
    with pytest.raises(ValueError):
        queues.bounded(df, ["k"], ["seq"], 1, "none")


def test_numbers_do_not_depend_on_buckets(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    for width in (1, 7, 1000):
        got = ordering.numbered(df, ["k"], ["id"], F.floor(F.col("id") / width)).collect()
        assert all(r["n"] == r["id"] // 3 + 1 for r in got)
        total = ordering.running_sum(df, [], ["id"], F.floor(F.col("id") / width), F.col("id"), "s").collect()
        assert all(r["s"] == r["id"] * (r["id"] - 1) // 2 for r in total)


def test_argmax(spark):
    df = spark.createDataFrame([([0.003, 0.028, 0.007, 0.144, 0.041, 0.002, 0.089, 0.078, 0.045, 0.022, 0.125, 0.096, 0.008, 0.008, 0.01, -1.0, -2.0, float("nan"), 0.0, -3.0],)], "v array<double>")
    assert df.select(tensors.argmax_classes(F.col("v"), 4, 5).alias("c")).first()["c"] == [3, 1, 0, 0]
    first = df.select(tensors.channels_last(F.array(*[F.lit(i) for i in range(6)]), 3, 2).alias("c")).first()["c"]
    assert first == [0, 3, 1, 4, 2, 5]


def test_primitives_and_kinds(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(7)]).alias("v"))
    assert df.select(tensors.primitives(F.col("v"), "line_strip").alias("p")).first()["p"] == [[0, 1, 2, 3], [2, 3, 4, 5]]
    assert df.select(tensors.primitives(F.slice("v", 1, 3), "lines").alias("p")).first()["p"] == []
    assert df.select(tensors.primitive_kind(F.lit(2), F.lit(False), F.lit(True), F.lit(False)).alias("p")).first()["p"] == "crosses"


def test_constant_image_and_demosaic(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, v double")
    assert [tuple(r) for r in images.equalized_bins(df, ["k"], "v").collect()] == [(1, 0, 2, 0)]
    flat = spark.createDataFrame([([7] * 16,)], "v array<int>")
    assert set(flat.select(images.demosaic(F.col("v"), 4, 4).alias("x")).first()["x"]) == {7}
    assert len(flat.select(images.demosaic(F.col("v"), 4, 4, alpha=255).alias("x")).first()["x"]) == 64


def test_inference(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, x array<double>")
    got = {r["id"]: r["m"] for r in inference.infer(df, {"m": lambda: lambda x: x.sum(axis=1)}, {"m": "x"}).collect()}
    assert got == {1: [3.0], 2: None}
    for bad in (({}, {}), ({"m": 1}, {}), ({"m": 1}, {"m": ""})):
        with pytest.raises(ValueError):
            inference.checked(*bad)
    with pytest.raises(ValueError):
        inference.checked({"m": 1}, {"m": "x"}, {"m": 0})


def test_durations():
    assert [durations.nanoseconds(x) for x in ("10ms", "0.2s", "50Hz", "7", 7)] == [10_000_000, 200_000_000, 20_000_000, 7, 7]
    for bad in ("x", "1 week", "0Hz"):
        with pytest.raises(ValueError):
            durations.nanoseconds(bad)


def test_sources(spark, tmp_path):
    assert [r["value"] for r in generators.counter(spark, 3).collect()] == [1, 2, 3]
    t = generators.tensors(spark, 2, [2, 3], "complex<float>")
    assert generators.described(t).first()["elements"] == 6
    with pytest.raises(ValueError):
        generators.tensors(spark, 1, [2], "int8_t", [1, 2, 3])
    types = generators.payload_types(spark)
    types.write.parquet(str(tmp_path / "types"))
    assert spark.read.parquet(str(tmp_path / "types")).collect() == types.collect()
    recording.record(generators.counter(spark, 5), str(tmp_path / "rec"))
    assert recording.replay(spark, str(tmp_path / "rec")).count() == 5
    recording.export_csv(spark.createDataFrame([("1", 'a"b,c')], "column1 string, column2 string"), str(tmp_path / "csv"), ["column1", "column2"])
    assert tuple(spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first())[0] == "1"
    with pytest.raises(ValueError):
        recording.export_csv(spark.range(1), str(tmp_path / "csv"), ["none"])


def test_routes(spark):
    df = spark.range(6)
    got = sorted(tuple(r) for r in routing.routed(df, {"a": F.col("id") < 2, "b": F.col("id") < 4}).collect())
    assert got == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b"), (3, "b")]


def test_log_filter_denies_first(spark):
    df = spark.createDataFrame([("a.in",), ("a.out",), ("b.in",)], "n string")
    got = [r["n"] for r in df.where(tracking.log_filter(F.col("n"), allow=["in"], deny=["^b"])).collect()]
    assert got == ["a.in"]


def test_process_checks_its_configuration(spark):
    from millrace.plans.process import process

    df = spark.createDataFrame([([0.0, 1.0],)], "v array<double>")
    assert process(df, {"t": ("v", [("rescale_down", {}), ("printed", {})])}).first()["t"] == "0, 255"
    for bad in ({}, {"v": ("v", [("printed", {})])}, {"": ("v", [("printed", {})])}, {"t": ("w", [("printed", {})])}, {"t": ("v", [])}, {"t": ("v", [("none", {})])}):
        with pytest.raises(ValueError):
            process(df, bad)


def test_rigid_poses_and_cuts(spark):
    df = spark.range(1).select(rotations.pose(1, 0, 0, 0, 0, 0, 0).alias("a"), rotations.pose(1, 1, 0, 0, 0, 0, 0).alias("b"), rotations.pose(1, 0, 0, 0, math.nan, 0, 0).alias("c"))
    assert tuple(df.select(*[poses.is_rigid(F.col(c)) for c in "abc"]).first()) == (True, False, False)
    cut = poses.disconnected(history(spark, TWO), spark.createDataFrame([(1, 3.0, 3)], "edge int, t double, version long"), ["edge"], "t", "x")
    assert cut.where("not valid").count() == 1


# -- null keys are keys like any other


def nullable(spark):
    """Six rows of key 1 and six of no key, in turn."""
    return spark.createDataFrame([(None if i % 2 else 1, i, 10 * i) for i in range(12)], "k int, seq int, t long")


def by_key(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        out.setdefault(r["k"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_null_keys(spark):
    df, bucket = nullable(spark), F.floor(F.col("seq") / 5)
    batches = by_key(conditions.count_batches(df, ["k"], ["seq"], bucket, 4).collect(), "batch")
    assert batches == {1: [0] * 4, None: [0] * 4}
    assert by_key(conditions.expiring_batches(df, ["k"], "t", ["t"], bucket, 3, 1000).collect(), "batch") == {1: [0, 0, 0, 1, 1, 1], None: [0, 0, 0, 1, 1, 1]}
    assert by_key(conditions.timeout_batches(df, ["k"], "t", ["t"], 3, 1000).collect(), "batch") == {1: [0, 0, 0, 1, 1, 1], None: [0, 0, 0, 1, 1, 1]}
    for ticks in (conditions.grid_ticks(df, ["k"], "t", ["t"], 40), conditions.catch_up_ticks(df, ["k"], "t", ["t"], 40, bucket), conditions.min_gap_ticks(df, ["k"], "t", ["t"], bucket, 40)):
        assert by_key(ticks.collect(), "t") == {1: [0, 40, 80], None: [10, 50, 90]}
    assert by_key(queues.bounded(df, ["k"], ["seq"], 2, "fault").collect(), "seq", "overflow") == {1: [(0, 4), (2, 4)], None: [(1, 4), (3, 4)]}
    assert queues.strict(df, ["k"], 6).count() == 12
    latest = queues.latest_value(df.where("seq >= 4"), df.where("seq < 4"), ["k"], ["t", "seq"], F.floor(F.col("t") / 50), "seq").collect()
    assert {(r["k"], r["latest"]) for r in latest} == {(1, 2), (None, 3)} and sum(r["is_old"] for r in latest) == 6
    assert len(poses.accepted(df, ["k"], "t", ["seq"], bucket).collect()) == 12
    assert {r["k"] for r in images.equalized_bins(df, ["k"], "t").collect()} == {1, None}
    assert by_key(ordering.numbered(df, ["k"], ["seq"], bucket, total="all").collect(), "n", "all")[None] == [(i, 6) for i in range(1, 7)]
    assert by_key(ordering.running_sum(df, ["k"], ["seq"], bucket, F.col("seq"), "s").collect(), "s")[None] == [0, 1, 4, 9, 16, 25]


def test_chains_are_folded_apart(spark):
    """A key whose rows come in bursts: the greedy batches of the whole sequence, whatever the bursts."""
    rng, t, rows = random.Random(3), 0, []
    for i in range(400):
        t += rng.choice([0, 1, 2, 5, 30])
        rows.append((1, i, t))
    df = spark.createDataFrame(rows, "k int, seq int, t long")
    got = [r["batch"] for r in conditions.expiring_batches(df, ["k"], "t", ["t", "seq"], F.floor(F.col("t") / 100), 5, 12).orderBy("seq").collect()]
    want, batch, first, n = [], -1, 0, 0
    for _, _, t in rows:
        if not n or n >= 5 or t - first > 12:
            batch, first, n = batch + 1, t, 0
        n += 1
        want.append(batch)
    assert got == want
    ran = [r["seq"] for r in conditions.min_gap_ticks(df, ["k"], "t", ["t", "seq"], F.floor(F.col("t") / 100), 7).orderBy("seq").collect()]
    due, want = None, []
    for _, i, t in rows:
        if due is None or t >= due:
            due = t + 7
            want.append(i)
    assert ran == want


def exchanged(df, column: str) -> int:
    """How often the physical plan shuffles ``column``, before reuse."""
    n, text = 0, df._jdf.queryExecution().executedPlan().toString().split("\n")
    for i, line in enumerate(text):
        if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line:
            below = next((x for x in text[i + 1 :] if "Project" in x or "Scan" in x or "HashAggregate" in x or "Filter" in x), "")
            n += column in below
    return n


def test_full_rows_are_shuffled_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 k", "id", "cast(id as string) wide").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucket = F.floor(F.col("id") / 100)
        for out in (ordering.numbered(df, ["k"], ["id"], bucket), ordering.running_sum(df, ["k"], ["id"], bucket, F.col("id"), "s"), ordering.last_known(df, ["k"], ["id"], bucket, F.col("id"), "l"), conditions.count_batches(df, ["k"], ["id"], bucket, 4)):
            assert exchanged(out, "wide") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


# -- frames


def test_cycles_are_found(spark):
    frames = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None), ("f", "f"), ("g", "e")], "frame string, parent string")
    problems = {(r["frame"], r["problem"]) for r in poses.frame_problems(frames).collect()}
    assert problems == {(x, "cycle") for x in "abcf"}
    with pytest.raises(ValueError, match="cycle"):
        poses.to_root(frames.withColumn("pose", rotations.pose(1, 0, 0, 0, 0, 0, 0)))


def test_deep_chain_has_one_root(spark):
    rows = [("f0", None)] + [(f"f{i}", f"f{i - 1}") for i in range(1, 40)]
    frames = spark.createDataFrame(rows, "frame string, parent string").withColumn("pose", F.when(F.col("parent").isNotNull(), rotations.pose(1, 0, 0, 0, 1, 0, 0)).otherwise(rotations.pose(1, 0, 0, 0, 0, 0, 0)))
    got = {r["frame"]: (r["root"], r["depth"], r["pose"]["tx"]) for r in poses.to_root(frames).collect()}
    assert got == {f"f{i}": ("f0", i, float(i)) for i in range(40)}


def test_edges_that_close_a_cycle_are_refused(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 3), ("c", "b", 4), ("d", "d", 5), ("x", "y", 6), ("c", "y", 7), (None, "a", 8), ("x", "a", 9)], "lhs string, rhs string, at int")
    got = {r["at"]: r["accepted"] for r in poses.tree_edges(df, "at").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 8: False, 9: False}
    rng = random.Random(9)
    rows = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", i) for i in range(150)]
    label, want, seen = {}, {}, {}
    for a, b, i in rows:
        pair = tuple(sorted((a, b)))
        la, lb = label.setdefault(a, a), label.setdefault(b, b)
        want[i] = seen.setdefault(pair, la != lb)
        if la != lb:
            label = {k: la if v == lb else v for k, v in label.items()}
    assert {r["at"]: r["accepted"] for r in poses.tree_edges(spark.createDataFrame(rows, "lhs string, rhs string, at int"), "at").collect()} == want


def test_screw_motion(spark):
    half = math.sqrt(0.5)
    df = spark.range(1).select(rotations.pose(1, 0, 0, 0, 0, 0, 0).alias("a"), rotations.pose(half, 0, half, 0, 3, 3, 3).alias("b"))
    m = df.select(rotations.slerp_pose(F.col("a"), F.col("b"), F.lit(0.5)).alias("m")).first()["m"]
    assert 2 * math.acos(m["qw"]) == pytest.approx(math.pi / 4, abs=1e-8)
    assert (m["tx"], m["ty"], m["tz"]) == pytest.approx(((2 - math.sqrt(2)) * 1.5, 1.5, math.sqrt(2) * 1.5), abs=1e-8)
    twice = df.select(rotations.multiply(rotations.power(F.col("b"), 0.5), rotations.power(F.col("b"), 0.5)).alias("m")).first()["m"]
    assert tuple(twice) == pytest.approx((half, 0, half, 0, 3, 3, 3), abs=1e-9)


def test_euler_angles(spark):
    df = spark.createDataFrame([(0.3, -0.4, 1.2), (1.5, 2.0, -3.0), (-0.7, 0.0, 0.0)], "r double, p double, y double")
    back = df.select("*", rotations.euler(rotations.from_euler(F.col("r"), F.col("p"), F.col("y"))).alias("e")).collect()
    for x in back:
        turned = spark.createDataFrame([(x["e"]["roll"], x["e"]["pitch"], x["e"]["yaw"], x["r"], x["p"], x["y"])], "a double, b double, c double, r double, p double, y double")
        q = turned.select(rotations.multiply(rotations.from_euler(F.col("a"), F.col("b"), F.col("c")), rotations.inverse(rotations.from_euler(F.col("r"), F.col("p"), F.col("y")))).alias("q")).first()["q"]
        assert abs(q["qw"]) == pytest.approx(1, abs=1e-9) and abs(x["e"]["roll"]) <= math.pi / 2 + 1e-9


# -- images


def test_cubic_weights_and_planes(spark):
    w = images.cubic_weights(5, 9)
    assert w.sum(axis=1) == pytest.approx([1.0] * 9)
    df = spark.createDataFrame([(1, [7] * 64), (2, None)], "id int, v array<int>")
    got = {r["id"]: r["x"] for r in df.select("id", images.resize_cubic(F.col("v"), 8, 8, 1, 5, 3).alias("x")).collect()}
    assert got == {1: [7] * 15, 2: None}
    rng = random.Random(1)
    gray = [x for _ in range(16) for x in [rng.randint(0, 255)] * 3]
    df = spark.createDataFrame([(gray,)], "v array<int>")
    for layout in images.LAYOUTS:
        for luma in images.LUMA:
            back = df.select(images.planes_to_rgb(images.rgb_to_planes(F.col("v"), 4, 4, layout, luma), 4, 4, layout, luma).alias("x")).first()["x"]
            assert back == gray  # a gray image has no chroma to lose
    with pytest.raises(ValueError):
        images.planes_to_rgb(F.col("v"), 3, 4)
    with pytest.raises(ValueError):
        images.planes_to_rgb(F.col("v"), 4, 4, "other")


def test_chroma_is_added_up_row_by_row(spark):
    """Halves are decided by rounding errors: the sum goes over a sample's four pixels in their order, as plain SQL does."""
    cells = {103: (205, 197, 154, 170, 224, 169, 137, 236, 92, 187, 42, 88), 102: (182, 101, 184, 35, 174, 98, 167, 93, 43, 227, 243, 74), 126: (25, 161, 53, 96, 19, 250, 143, 84, 69, 235, 235, 115)}
    frames = [(u, [x for _ in range(4) for row in (c[:6], c[6:]) for x in row * 4]) for u, c in cells.items()]
    df = spark.createDataFrame(frames, "u int, v array<int>")
    for r in df.select("u", images.rgb_to_planes(F.col("v"), 8, 8).alias("x")).collect():
        assert r["x"][64:80] == [r["u"]] * 16


def test_binary_class_rows(spark):
    df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 3.0]), (4, [1.0])], "id int, v array<double>")
    got = {r["id"]: r["c"] and tuple(r["c"])[:2] for r in df.select("id", tensors.binary_class_row(F.col("v"), ["a", "b", "c"]).alias("c")).collect()}
    assert got == {1: ("1", "0"), 2: ("0", "1"), 3: ("0", "1"), 4: None}


# -- recordings


def test_entity_recording(spark, tmp_path):
    from millrace.sources import entities

    spark.dataSource.register(entities.EntityRecording)
    rows = [(i, bytes([i % 256]) * (i % 5)) for i in range(50)]
    spark.createDataFrame(rows, "log_time long, data binary").repartition(3).write.format("entities").mode("append").option("path", str(tmp_path / "r")).save()
    back = spark.read.format("entities").option("path", str(tmp_path / "r")).option("rows", 4).load()
    assert sorted((r["log_time"], bytes(r["data"])) for r in back.collect()) == rows
    assert not list((tmp_path / "r").glob(".part*"))
    base = tmp_path / "one"
    base.with_suffix(".index").write_bytes(entities.RECORD.pack(5, 3, 0) + entities.RECORD.pack(6, 9, 3))
    base.with_suffix(".entities").write_bytes(b"abcd")
    got = [tuple(r) for r in spark.read.format("entities").option("path", str(base)).load().collect()]
    assert [(r[0], r[1], r[2], r[3] and bytes(r[3])) for r in got] == [(5, 3, 0, b"abc"), (6, 9, 3, None)]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("entities").option("path", str(tmp_path / "nowhere")).load().collect()
