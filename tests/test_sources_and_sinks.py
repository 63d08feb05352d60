import json
import os
import threading

import pytest
from conftest import near
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.books import book_features
from tapeloom.schemas import FEATURES
from tapeloom.session import job_name, join_small, shared_dir, staged, staged_with_counts, staging
from tapeloom.sinks import publish as P
from tapeloom.sinks.publish import alignment, current, publish, publish_ids, require_aligned
from tapeloom.sources import books as B
from tapeloom.sources import histories as H
from tapeloom.sources import idlists, listings
from tapeloom.sources.tables import read_csv, require_columns


def payloads(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")


def test_history_points_skip_what_cannot_be_read(spark):
    df = payloads(
        spark,
        {"history": [{"t": 1, "p": 0.5}, {"t": None, "p": 1}, 7, {"t": "3", "p": "0.25"}, {"t": 4, "p": "x"}, {"t": 5.9, "p": 1}]},
        "oops", {"history": 5}, {"history": []}, {},
    )
    got = sorted(H.history_points(df, "body", ["i"]).collect())
    assert [(r.i, r.position, r.t, r.price) for r in got] == [(0, 0, 1, 0.5), (0, 3, 3, 0.25), (0, 5, 5, 1.0)]


def test_batch_points_take_map_first(spark):
    point = [{"t": 1, "p": 0.5}]
    df = payloads(
        spark,
        {"history": {"a": point}, "data": [{"token_id": "z", "history": point}]},
        {"history": {}, "data": [{"token_id": "b", "history": point}, 3, {"token_id": "b", "history": [{"t": 2, "p": 0.7}]}]},
        {"data": [{"token_id": 0, "market": "", "asset_id": "c", "history": point}, {"history": point}]},
        {"data": [{"token_id": "0", "history": point}, {"token_id": "d", "history": 4}]},
        "nothing",
    )
    got = sorted((r.i, r.token_id, r.t, r.price) for r in H.batch_points(df, "body", ["i"]).collect())
    assert got == [(0, "a", 1, 0.5), (1, "b", 2, 0.7), (2, "c", 1, 0.5), (3, "0", 1, 0.5)]


def test_landed_json_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"id": "1", "volumeNum": 12.5, "active": True, "closed": False}) + "\n")
    row = listings.active_markets(listings.read_markets(spark, str(tmp_path))).first()
    assert row.volumeNum == "12.5"
    event = {"title": " A vs. B ", "series_id": "s", "markets": [{"id": "1", "question": " "}, {"id": "2", "question": "Q"}]}
    (tmp_path / "e.json").write_text(json.dumps(event))
    got = listings.event_markets(listings.read_events(spark, str(tmp_path / "e.json"))).orderBy("position").collect()
    assert [(r.id, r.question) for r in got] == [("1", "A vs. B"), ("2", "Q")]


def book(spark, bids, asks):
    body = {"timestamp": "9", "bids": [dict(zip(("price", "size"), x)) for x in bids], "asks": [dict(zip(("price", "size"), x)) for x in asks]}
    return B.parse_books(payloads(spark, body), "body", ["i"])


def test_book_summary_and_features(spark):
    df = B.summarize_books(book(spark, [(".48", "100"), (".47", "50")], [(".52", "30"), (".53", "20")]))
    names = ("ob_mid", "ob_spread", "ob_imbalance_topn", "ob_bid_depth_topn", "ob_ask_depth_topn")
    row = df.select("*", *[v.alias(k) for k, v in book_features(*[F.col(n) for n in names]).items()]).first()
    assert near(row.ob_spread, 0.04) and near(row.ob_mid, 0.5) and row.ob_timestamp_ms == "9"
    assert (row.ob_bid_depth_topn, row.ob_ask_depth_topn, row.ob_imbalance_topn) == (150.0, 50.0, 0.5)
    assert near(row.feat_ob_spread_over_mid, 0.08) and near(row.feat_ob_log_bid_ask_depth_ratio, 1.098612289)


def test_book_edges(spark):
    one_sided = B.summarize_books(book(spark, [("x", "1"), (".4", "2")], [])).first()
    assert one_sided.ob_best_bid == 0.4 and one_sided.ob_best_ask is None and one_sided.ob_mid is None
    assert one_sided.ob_bid_depth_topn is None and one_sided.ob_imbalance_topn is None
    empty_sizes = B.summarize_books(book(spark, [(".4", "0")], [(".5", "0")])).first()
    assert empty_sizes.ob_mid == 0.45 and empty_sizes.ob_imbalance_topn is None
    deep = B.summarize_books(book(spark, [("bad", "1")] * 5 + [(".4", "9")], [(".5", "1")])).first()
    assert deep.ob_best_bid is None and deep.ob_bid_depth_topn == 0.0 and deep.ob_ask_depth_topn == 1.0


def test_id_lists(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("# all\n12, 13 # note\n  14\tslug\n\n12\n")
    got = {r.market_id for r in idlists.read_ids(spark, str(path), "15 16,12").collect()}
    assert got == {"12", "13", "14", "slug", "15", "16"}
    assert idlists.read_ids(spark, None, None).count() == 0


def test_csv_reads_nan_and_line_breaks(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("q", T.StringType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "a.csv").write_text('id,q,v\n1,"two\nlines, ""so""",1.5\n2,,NaN\n3,x,\n')
    rows = read_csv(spark, str(tmp_path / "a.csv"), schema, line_breaks=True).orderBy("id").collect()
    assert [(r.q, r.v) for r in rows] == [('two\nlines, "so"', 1.5), (None, None), ("x", None)]
    with pytest.raises(ValueError):
        require_columns(spark.range(1), {"id", "other"})


def test_publish_replaces_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(5), path)
    publish(spark.range(3), path)
    assert spark.read.parquet(current(spark, path)).count() == 3
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        publish(bad, path)
    assert spark.read.parquet(current(spark, path)).count() == 3
    versions = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]
    assert len(versions) <= 3  # the current one, the one before, and what the failed job left
    publish(spark.createDataFrame([], FEATURES), str(tmp_path / "empty"))
    assert spark.read.parquet(current(spark, str(tmp_path / "empty"))).columns == FEATURES.names
    ids = publish_ids(spark.range(2), str(tmp_path / "ids"), "id")
    with pytest.raises(FileNotFoundError):
        current(spark, str(tmp_path / "nothing"))
    assert sorted(r.value for r in spark.read.text(ids).collect()) == ["0", "1"]


def test_alignment(spark):
    a, b = spark.range(3).toDF("k"), spark.range(1, 4).toDF("k")
    row = alignment(a, b, ["k"]).first()
    assert (row.n_features, row.n_metadata, row.only_features, row.only_metadata, row.aligned) == (3, 3, 1, 1, False)
    require_aligned(a, a, ["k"])
    with pytest.raises(ValueError):
        require_aligned(a, b, ["k"])
    assert alignment(a.limit(0), a.limit(0), ["k"]).first().aligned


def test_aligned_tables_are_checked_while_they_are_written(spark, tmp_path):
    paths = (str(tmp_path / "features"), str(tmp_path / "metadata"))
    a = spark.range(500).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") > 3, F.lit("t")).alias("tag"))
    b = a.repartition(7).withColumnRenamed("k", "id").withColumn("more", F.lit(1))
    before = jobs(spark)
    P.publish_aligned(a, b, paths, ["k", "tag"], ["id", "tag"])
    assert jobs(spark) - before <= 3  # two writes and the shuffle that the second one has itself
    known = [current(spark, p) for p in paths]
    assert [spark.read.parquet(p).count() for p in known] == [500, 500]
    other = b.where("id <> '7'").unionByName(b.where("id = '8'"))  # as many rows, other keys
    twice = b.unionByName(b.where("id = '8'"))
    swapped = b.withColumn("tag", F.when(F.col("id") == "2", F.lit("t")).when(F.col("id") == "9", None).otherwise(F.col("tag")))
    for wrong in (other, twice, swapped, b.limit(0)):
        with pytest.raises(ValueError):
            P.publish_aligned(a, wrong, paths, ["k", "tag"], ["id", "tag"])
        assert [current(spark, p) for p in paths] == known
        assert all(len([n for n in os.listdir(p) if n.startswith("v-")]) == 1 for p in paths)
    P.publish_aligned(a.limit(0), b.limit(0), paths, ["k", "tag"], ["id", "tag"])
    assert [spark.read.parquet(current(spark, p)).count() for p in paths] == [0, 0]


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_counts_are_gathered_while_staging(spark):
    counts = {"n": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0)}
    for rows, want in ((spark.range(9).repartition(3), {"n": 9, "even": 5}), (spark.range(0), {"n": 0, "even": 0})):
        table, got = staged_with_counts(rows, "counted", counts)
        assert got == want and table.count() == want["n"]
    name = job_name("counting", 1, {})
    for _ in range(2):  # the second run finds the table and reads it
        try:
            with staging(spark, name):
                assert staged_with_counts(spark.range(4), "counted", counts)[1] == {"n": 4, "even": 2}
                raise RuntimeError
        except RuntimeError:
            pass
    with staging(spark, name):
        assert staged_with_counts(spark.range(4), "counted", counts)[1] == {"n": 4, "even": 2}


def test_join_small_agrees_for_every_route(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(20).toDF("k").withColumn("w", F.col("k") * 2)
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = join_small(big, small, ["k"], how)
        sent = join_small(big, small, ["k"], how, max_rows=20)
        assert salted.exceptAll(sent).count() == 0 and sent.exceptAll(salted).count() == 0
    with pytest.raises(ValueError):
        join_small(big, small, ["k"], "outer")


def test_staged_uses_the_shared_folder(spark):
    df = staged(spark.range(4), "check")
    assert df.count() == 4 and shared_dir(spark) in df.inputFiles()[0]


def test_readers_see_whole_versions_during_publishing(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(0, 5).coalesce(1), path)
    stop, seen, errors = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                # What a reader resolves is a whole version; it may be dropped two versions later.
                folder = current(spark, path)
                assert folder.startswith(f"{path}/v-") and os.path.exists(f"{folder}/_SUCCESS"), folder
                seen.append(folder)
            except Exception as error:  # noqa: BLE001
                errors.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(15):
        publish(spark.range(i, i + 5).coalesce(1), path)
    stop.set()
    reader.join()
    assert not errors and len(set(seen)) > 3 and P.version(spark, path) == 16
    assert {r.id for r in spark.read.parquet(current(spark, path)).collect()} == set(range(14, 19))


def test_two_writers_and_compare_and_set(spark, tmp_path):
    path = str(tmp_path / "t")
    before = P.version(spark, path)
    publish(spark.range(1), path, expect=before)
    with pytest.raises(P.Conflict):
        publish(spark.range(2), path, expect=before)
    assert spark.read.parquet(current(spark, path)).count() == 1
    assert len([p for p in os.listdir(path) if p.startswith("v-")]) == 1  # the loser's folder is gone

    def write(i):
        for k in range(4):
            publish(spark.range(10 * i + k), path)

    writers = [threading.Thread(target=write, args=(i,)) for i in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    # Every publication got a number of its own, and the last one is one of the writers' last.
    assert P.version(spark, path) == 9
    assert spark.read.parquet(current(spark, path)).count() in (13, 23)
    assert not [p for p in os.listdir(path) if p.startswith(".draft")]


def test_a_crash_before_the_claim_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    publish(spark.range(3), path)
    monkeypatch.setattr(P, "_renamed", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        publish(spark.range(9), path)
    monkeypatch.undo()
    assert spark.read.parquet(current(spark, path)).count() == 3
    publish(spark.range(4), path)
    assert spark.read.parquet(current(spark, path)).count() == 4


def test_latest_snapshot_and_unreadable_stamps(spark):
    side = "array<struct<price:string,size:string>>"
    rows = [
        ("a", "900", [(".4", "1")], []), ("a", "1000", [(".5", "1")], []), ("a", "n/a", [(".6", "1")], []),
        ("b", "n/a", [(".1", "1")], []), ("b", None, [(".2", "1")], []), ("c", "7", None, None), ("c", "7", [(".3", "2")], []),
    ]
    books = spark.createDataFrame(rows, f"token_id string, timestamp string, bids {side}, asks {side}")
    got = {r.token_id: (r.ob_best_bid, r.ob_timestamp_ms) for r in B.summarize_books(B.latest_books(books)).collect()}
    assert got == {"a": (0.5, "1000"), "b": (0.1, "n/a"), "c": (0.3, "7")}
    levels = spark.createDataFrame(
        [("a", "bid", 0.5, 1.0, "n/a", 1), ("a", "bid", 0.4, 1.0, "10", 2), ("a", "bid", 0.3, 1.0, "9", 3), ("b", "ask", 0.9, 1.0, "x", 4)],
        "token_id string, side string, price double, size double, timestamp string, o int",
    )
    got = {r.token_id: (r.ob_best_bid, r.ob_best_ask) for r in B.summarize_levels(levels, ["o"]).collect()}
    assert got == {"a": (0.4, None), "b": (None, 0.9)}


def test_a_job_owns_its_tables(spark):
    folder = shared_dir(spark)

    def files():
        return {p for p in os.listdir(folder) if "owned" in p}

    with pytest.raises(ValueError):
        with staging(spark):
            staged(spark.range(3), "owned")
            assert len(files()) == 1
            raise ValueError
    assert not files()
    counts = {}

    def job(name, n):
        with staging(spark):
            tables = [staged(spark.range(n), f"owned-{name}") for _ in range(3)]
            counts[name] = [t.count() for t in tables]

    jobs = [threading.Thread(target=job, args=(f"j{n}", n)) for n in (4, 7)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert counts == {"j4": [4] * 3, "j7": [7] * 3} and not files()


def test_a_killed_job_goes_on_where_it_was(spark):
    name = job_name("owned", ("settings", 1), {"points": "v-1"})
    assert name != job_name("owned", ("settings", 2), {"points": "v-1"}) != job_name("owned", ("settings", 1), {"points": "v-2"})
    run = []

    def job(fail):
        with staging(spark, name):
            first = staged(spark.range(5).withColumn("x", F.rand()), "one")
            run.append(sorted(r.x for r in first.collect()))
            if fail:
                raise KeyboardInterrupt
            return staged(first.where("id < 2"), "two").count()

    with pytest.raises(KeyboardInterrupt):
        job(True)
    folder = f"{shared_dir(spark)}/job-{name}"
    assert os.path.exists(f"{folder}/000-one/_SUCCESS")
    assert job(False) == 2
    assert run[0] == run[1] and not os.path.exists(folder)  # random numbers were read, not drawn again
