"""Tables kept in partitions, stored dimensions, sliced as-of joins, digest trees."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quillmart.operators import hashing
from quillmart.operators.history import CUT_FANOUT, as_of_join, as_of_join_by_window, cut_levels, hot_key_cuts, scd2_fold, with_cuts_before, with_surrogate_key
from quillmart.operators.stored import StoredDimension, merge_facts
from quillmart.sources.parts import PartitionedTable, table_metrics, write_observed

OBS = "k long, h string, at timestamp, seq long"


def full_fold(spark, rows):
    df = spark.createDataFrame(rows, OBS)
    return with_surrogate_key(scd2_fold(df, "k", "h", "at", tiebreak=("seq",)), "k", "h", "key")


def bag(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def text_bag(df):
    return sorted((str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()))


def test_merged_dimension_equals_the_full_fold(spark, tmp_path):
    rng, start = random.Random(4), dt(2026, 1, 1)
    rows = [(k, rng.choice("abc"), start + timedelta(hours=rng.randint(0, 60)), 0) for k in range(30) for _ in range(8)]
    rows = [(k, h, at, i) for i, (k, h, at, _) in enumerate({(k, at): (k, h, at, 0) for k, h, at, _ in rows}.values())]
    rng.shuffle(rows)
    # First the observations of some keys in order; then all else: later ones, late ones, back-dated first ones, new keys.
    on_time = [r for r in rows if r[0] < 20 and r[2] < start + timedelta(hours=30) and r[2] > start + timedelta(hours=5)]
    later = [r for r in rows if r[0] < 10 and r[2] >= start + timedelta(hours=30)]
    rest = [r for r in rows if r not in on_time and r not in later]
    dim = StoredDimension(spark, str(tmp_path / "dim"), spark.createDataFrame([], OBS).schema, "k", "h", "at", "key", buckets=8, tiebreak=("seq",))
    taken = []
    for batch in (on_time, later, later[:3], rest[: len(rest) // 2], rest[len(rest) // 2 :]):
        before = {r["k"]: r["key"] for r in dim.versions().filter("version = 1").collect()}
        old = {(r["k"], r["key"], r["effective_from"]) for r in dim.versions().collect()}
        files = dim.files()
        report = {r["k"]: r for r in dim.merge(spark.createDataFrame(batch, OBS)).collect()}
        taken += [r for r in batch if r not in taken]
        want = full_fold(spark, taken)
        assert text_bag(dim.versions()) == text_bag(want)
        assert dim.hash() == hashing.logical_hash(dim.versions(), dim.versions().columns).first().logical_hash
        changed = {k for k, *_ in old ^ {(r["k"], r["key"], r["effective_from"]) for r in want.collect()}}
        assert set(report) == changed
        after = {r["k"]: r["key"] for r in want.filter("version = 1").collect()}
        assert {k for k, r in report.items() if r["first_moved"]} == {k for k in before if before[k] != after[k]}
        buckets = {r[0] for r in spark.createDataFrame([(r[0],) for r in batch], "k long").select(F.pmod(F.xxhash64("k"), F.lit(8)).cast("string")).collect()}
        assert all(dim.files()[b] == path for b, path in files.items() if b not in buckets)
    assert dim.observations().count() == len(rows)


FACT = "id long, day int, value double"


def test_facts_are_replaced_partition_by_partition(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, FACT)
    t = PartitionedTable(spark, str(tmp_path / "facts"), "day", df([]).schema)
    rows = {i: (i, 20260101 + i % 5 if i % 7 else None, float(i)) for i in range(100)}
    merge_facts(t, df(list(rows.values())), df([]).select("id"), ["id"], "b1")
    first = t.state()["parts"]
    assert bag(t.read().filter("day IS NOT NULL")) == bag(df([r for r in rows.values() if r[1]])) and set(first) == {"20260101", "20260102", "20260103", "20260104", "20260105", "none"}
    # 1 changes, 2 moves to another day, 3 goes, 1000 is new: days 2 to 4 and a new one are written.
    affected = [1, 2, 3, 1000]
    fresh = [(1, 20260102, -1.0), (2, 20260109, 2.0), (1000, 20260103, 5.0)]
    touched = merge_facts(t, df(fresh), spark.createDataFrame([(i,) for i in affected], "id long"), ["id"], "b2")
    assert sorted(map(str, touched)) == ["20260102", "20260103", "20260104", "20260109"]
    want = [r for r in rows.values() if r[0] not in affected] + fresh
    assert sorted(map(str, t.read().collect())) == sorted(map(str, df(want).collect()))
    assert {k for k, p in t.state()["parts"].items() if first.get(k) == p} == {"20260101", "20260105", "none"}
    assert t.hash() == hashing.logical_hash(df(want)).first().logical_hash and t.meta() == {"bound": "b2"}
    # A unit that yields nothing; a partition that becomes empty goes; no change at all.
    merge_facts(t, df([]), spark.createDataFrame([(2,)], "id long"), ["id"])
    assert "20260109" not in t.state()["parts"] and t.meta() == {"bound": "b2"}
    assert t.hash() == hashing.logical_hash(t.read()).first().logical_hash
    merge_facts(t, df([]), df([]).select("id"), ["id"], "b3")
    assert t.read().count() == len(want) - 1
    with pytest.raises(ValueError):
        merge_facts(t, df([]), df([]).select("id"), ["id"], "b1")
    with pytest.raises(ValueError):
        t.replace(None, df([(5, 20260101, 1.0)]), None, [20260102])
    assert t.read().count() == len(want) - 1


def test_a_write_counts_what_it_writes(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x")).repartition(5)
    got = write_observed(df, str(tmp_path / "t"), table_metrics(df) | {"lo": F.min("id"), "hi": F.max("id")})
    assert (got["n_rows"], got["lo"], got["hi"]) == (1000, 0, 999)
    assert hashing.hash_of(got) == hashing.logical_hash(spark.read.parquet(str(tmp_path / "t"))).first().logical_hash
    none = df.filter("id < 0")
    assert write_observed(none, str(tmp_path / "n"), table_metrics(none))["n_rows"] == 0


def histories(spark):
    rng, start = random.Random(9), dt(2026, 1, 1)
    rows, ends = [], {}
    for k, n in (("hot", 200), ("warm", 20), ("cold", 1), ("gap", 2)):
        times = sorted(start + timedelta(minutes=m) for m in rng.sample(range(0, 3000), n))
        for i, t in enumerate(times):
            end = times[i + 1] if i + 1 < n else None
            rows.append((k, f"{k}{i}", t if i else dt(1970, 1, 2), end - timedelta(minutes=1) if k == "gap" and end else end))
    events = [(i, "hot", start + timedelta(minutes=rng.randint(-50, 3100), seconds=rng.choice([0, 30]))) for i in range(4000)]
    events += [(10_000 + i, rng.choice(["warm", "cold", "gap", "none"]), start + timedelta(minutes=rng.randint(-50, 3100))) for i in range(600)]
    events += [(20_000 + i, None, start) for i in range(50)] + [(30_000, "hot", None)]
    return spark.createDataFrame(events, "id int, k string, t timestamp"), spark.createDataFrame(rows, "k string, h string, effective_from timestamp, valid_to timestamp")


@pytest.mark.parametrize("slice_rows", [100, 1500, 1_000_000])
def test_sliced_as_of_join_agrees_with_the_join(spark, slice_rows):
    events, versions = histories(spark)
    want = {(r.id, r.h) for r in as_of_join(events, versions, "k", "t").collect()}
    got = [(r.id, r.h) for r in as_of_join_by_window(events, versions, "k", "t", ["h"], slice_rows).collect()]
    assert len(got) == events.count() and set(got) == want


def test_slices_of_a_hot_key_are_bounded(spark):
    events, versions = histories(spark)
    cuts = hot_key_cuts(events, "k", "t", 200).collect()
    assert [r["_key"] for r in cuts if len(r["_cuts"]) >= 15] == ["hot"]
    times = sorted(r.t.timestamp() * 1e6 for r in events.filter("k = 'hot' AND t IS NOT NULL").collect())
    edges = [float("-inf"), *cuts[0]["_cuts"], float("inf")]
    assert max(sum(a <= t < b for t in times) for a, b in zip(edges, edges[1:])) <= 300
    assert hot_key_cuts(events, "k", "t", 10_000) is None


@pytest.mark.parametrize("most", [0, 1, 64, 65, 128, 129, 5000])
def test_a_row_is_held_against_few_of_many_cuts(spark, most):
    cuts = {"hot": [3 * i for i in range(most)], "warm": [5, 7], "cold": []}
    levels = cut_levels(spark.createDataFrame(list(cuts.items()), "_key string, _cuts array<long>"))
    assert len(levels) <= 3 and max((len(r["_part"]) for t in levels for r in t.collect()), default=0) <= CUT_FANOUT
    rows = [(k, x) for k in [*cuts, "none"] for x in [-1, 0, 1, 5, 6, 189, 190, 192, 193, 384, 387, 3 * most, 1 << 60]]
    df = spark.createDataFrame(rows, "_key string, x long").transform(with_cuts_before, levels, "x", "upto", True).transform(with_cuts_before, levels, "x", "below", False)
    want = sorted((k, x, sum(c <= x for c in cuts.get(k, [])), sum(c < x for c in cuts.get(k, []))) for k, x in rows)
    assert sorted((r["_key"], r["x"], r["upto"], r["below"]) for r in df.collect()) == want


def test_tree_difference_joins_only_leaves_that_differ(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 13).alias("x"))
    right = left.filter("k % 5000 <> 1").withColumn("x", F.when(F.col("k") % 4000 == 2, -1).otherwise(F.col("x"))).unionByName(spark.createDataFrame([(-5, 1)], "k long, x long"))
    want = bag(hashing.keyed_difference(left, right, ["k"]))
    assert len(want) == 10 and bag(hashing.tree_difference(left, right, ["k"], 64, 16)) == want
    a, b = (hashing.digest_tree(df, ["k"], 64, 16) for df in (left, right))
    assert bag(hashing.tree_difference(left, right, ["k"], 64, 16, (a, b))) == want
    leaves = hashing.differing_leaves(a, b)
    assert 1 <= leaves.count() <= 10
    reached = hashing.placed_in_tree(left, ["k"], 64, 16).join(leaves.toDF("_bucket", "_leaf"), ["_bucket", "_leaf"], "left_semi").count()
    assert reached <= 10 * 20_000 // (64 * 16) * 2
    assert hashing.tree_difference(left, left, ["k"], 64, 16).isEmpty() and hashing.tree_difference(left.limit(0), right, ["k"], 4, 4).count() == right.count()


# --- sources ----------------------------------------------------------------------------
def test_a_cursor_stream_reads_each_row_once_over_restarts(spark, tmp_path):
    from quillmart.sources.contracts import TableContract
    from quillmart.streaming.cursor import read_cursor_stream

    c = TableContract("t", ("id",), "at", "id bigint NOT NULL, at timestamp_ntz NOT NULL, v string")
    source, start = str(tmp_path / "in"), dt(2026, 1, 1)
    batches = []

    def run():
        sink = lambda df, n: batches.append([r.id for r in df.collect()])
        q = read_cursor_stream(spark, source, c, 3).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    def add(ids, hours):
        rows = [(i, start + timedelta(hours=hours(i)), f"v{i}") for i in ids]
        spark.createDataFrame(rows, c.ddl.replace(" NOT NULL", "")).repartition(2).write.mode("append").parquet(source)

    run()
    assert sum(batches, []) == []
    add(range(10), lambda i: i // 4)
    run()
    assert sorted(sum(batches, [])) == list(range(10))
    run()
    add(range(10, 25), lambda i: max(2, i // 8))  # the first ones share the last row's time: only their keys are greater
    run()
    assert sorted(sum(batches, [])) == list(range(25))


def test_bucketed_facts_join_without_an_exchange(spark, monkeypatch):
    from quillmart.plans import stored

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = stored.bucketed_sources(spark, "/root/testdata/sf0.001", 4)
        for df in (stored.facts(spark, "", s["orders"].drop("customer_key"), s["items"]), stored.fct_order_payment_of(s["payments"], s["orders"])):
            df.count()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_that_are_no_records_keep_their_text(spark, tmp_path):
    from quillmart.sources.scans import CORRUPT, corrupt_kind, read_permissive_csv

    lines = ['1,"a, b",2', "2,c", "3,d,4,5", '4,"open,5', "five,e,6", "6,,7", "7,f,x"]
    (tmp_path / "t.csv").write_text("id,name,n\n" + "\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "id int, name string, n int").schema
    got = read_permissive_csv(spark, str(tmp_path / "t.csv"), schema).cache()
    rows = {(r.id, r.name, r.n) for r in got.filter(f"{CORRUPT} IS NULL").select("id", "name", "n").collect()}
    assert rows == {(1, "a, b", 2), (6, None, 7)}
    kinds = {r[0]: r.k for r in got.filter(f"{CORRUPT} IS NOT NULL").select(CORRUPT, corrupt_kind(F.col(CORRUPT), 3).alias("k")).collect()}
    assert kinds == {"2,c": "SHORT", "3,d,4,5": "LONG", '4,"open,5': "QUOTE", "five,e,6": "TYPE", "7,f,x": "TYPE"}


def test_files_without_a_commit_are_told_apart(spark, tmp_path):
    from quillmart.sources import ledger, scans

    root = str(tmp_path / "bronze")
    spark.range(20).selectExpr("id", "CAST(id % 4 AS string) batch_id").repartition(1).write.partitionBy("batch_id").parquet(root)
    named = scans.list_files(spark, root).select("path").cache()
    assert named.count() == 4
    spark.range(1).write.parquet(f"{root}/stray")
    spark.range(3).write.mode("append").parquet(f"{root}/batch_id=1")
    book = spark.createDataFrame([("t", "o", 3, b, dt(2026, 1, 1), 5, "h") for b in "012"] + [("other", "o", 3, "3", dt(2026, 1, 1), 5, "h")], ledger.LEDGER)
    got = [(r.batch_id, r.why) for r in ledger.unlisted_files(scans.list_files(spark, root), book, "t", named).collect()]
    assert set(got) == {("3", "UNCOMMITTED"), ("1", "UNKNOWN_FILE"), (None, "NO_BATCH")}
    assert {(r.batch_id, r.why) for r in ledger.unlisted_files(scans.list_files(spark, root), book, "t").collect()} == {("3", "UNCOMMITTED"), (None, "NO_BATCH")}


def test_a_copy_that_differs_from_its_publish_is_refused(spark, tmp_path):
    from quillmart.plans.publish import Publisher, export_serving

    pub = Publisher(spark, str(tmp_path / "pub"), {"fct_a": "orders"})
    pub.publish({"fct_a": spark.range(10).repartition(3)}, [])
    assert pub.rows() == {"fct_a": 10} and pub.hashes()["fct_a"] == hashing.logical_hash(spark.range(10)).first().logical_hash
    row = export_serving(spark, pub, str(tmp_path / "ok"), ("fct_",)).first()
    assert row.row_counts == {"fct_a": 10} and row.hashes == pub.hashes()
    monkey = pub.published
    pub.published = lambda: {"fct_a": monkey()["fct_a"].filter("id > 0")}
    with pytest.raises(ValueError):
        export_serving(spark, pub, str(tmp_path / "bad"), ("fct_",))


def test_strict_types_of_seed_columns(spark):
    from quillmart.operators.quality import strict, strict_errors

    rows = [("3", "1.005", "2026-01-01"), ("3.0", "2.125", "2026-01-01 10:00:00+09:00"), ("3e0", "-7", "2026-01-01T10:00:00Z"), ("3.5", "x", "soon"), (None, None, None), ("1e40", "1e40", "01/02/2026")]
    df = spark.createDataFrame(rows, "n string, m string, t string")
    kinds = {"n": "integer", "m": "money", "t": "timestamp"}
    got = df.select(*[strict(F.col(c), k).cast("string").alias(c) for c, k in kinds.items()], strict_errors(df, kinds, ("t",)).alias("e")).collect()
    assert [tuple(r)[:3] for r in got] == [
        ("3", "1.00", "2026-01-01 00:00:00"), ("3", "2.12", "2026-01-01 01:00:00"), ("3", "-7.00", "2026-01-01 10:00:00"), (None, None, None), (None, None, None), (None, None, None),
    ]
    assert [r.e for r in got] == [[], [], [], ["n", "m", "t"], ["t"], ["n", "m", "t"]]
    with pytest.raises(ValueError):
        strict(F.col("n"), "colour")


def test_serving_status_comes_from_publishes_that_took_place(spark):
    from quillmart.plans.rules import serving_status

    rows = [("a", "r1", True, False), ("a", "r2", True, True), ("a", "r3", False, False), ("a", "r4", True, True), ("b", "r1", True, True), ("c", "r1", True, False)]
    as_of = spark.createDataFrame([("a", dt(2026, 1, 1)), ("d", dt(2026, 1, 2))], "domain string, as_of timestamp")
    got = {r.domain: (r.refreshed_at, r.is_held, r.consecutive_holds) for r in serving_status(spark.createDataFrame(rows, "domain string, run_id string, published boolean, held boolean"), as_of).collect()}
    assert got == {"a": ("r1", True, 2), "b": (None, True, 1), "c": ("r1", False, 0), "d": (None, None, None)}


def test_a_snapshot_over_jdbc_is_read_in_slices(spark, tmp_path):
    from quillmart.sources import scans

    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(500).selectExpr("id * 3 AS k", "CAST(id % 7 AS int) AS v").unionByName(spark.createDataFrame([(None, 9)], "k bigint, v int"))
    rows.toDF("K", "V").coalesce(1).write.jdbc(url, "T", properties=own)
    parts = scans.slices(spark.read.jdbc(url, "T", properties=own), "K", 4)
    got = scans.read_snapshot(spark, url, "T", parts, own)
    assert got.rdd.getNumPartitions() == 4 and sorted((str(r.K), r.V) for r in got.collect()) == sorted((str(r.k), r.v) for r in rows.collect())


def test_a_build_is_written_and_hashed_once_for_all_its_publishes(spark, tmp_path):
    from quillmart.operators import quality
    from quillmart.plans.publish import Publisher

    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    domains = {"a": "orders", "b": "shared"}
    build = Publisher(spark, str(tmp_path / "built"), domains).build({"a": df, "b": df.filter("id < 10")})
    fails = lambda domain: [quality.Check(f"{domain}_canary", domain, lambda: df.limit(1))]
    for domain, changed in (("orders", ["b"]), ("shared", []), ("none", ["a", "b"])):
        pub = Publisher(spark, str(tmp_path / domain), domains)
        assert sorted(pub.publish(build, fails(domain) if domain in domains.values() else [])) == changed
        assert not (tmp_path / domain / "runs").exists()
        assert {n: bag(t) for n, t in pub.published().items()} == {n: bag(df.filter("id < 10") if n == "b" else df) for n in changed}
        assert pub.hashes() == {n: hashing.logical_hash(t).first().logical_hash for n, t in pub.published().items()}


def test_merged_states_are_read_from_a_table(spark, monkeypatch):
    from quillmart.plans import stored as plans

    merged = []
    merge = StoredDimension.merge
    monkeypatch.setattr(StoredDimension, "merge", lambda self, new: merged.append(new) or merge(self, new))
    dim, _ = plans.merged_states(spark, "/root/testdata/sf0.001")
    # A merge reads its observations more than once: their window must not run anew each time.
    assert len(merged) == 2 and not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in merged)
