"""Publishing, recovery and reports on small tables."""


from ledgerline.operators.publish import majority, subscriber_summary, suppress
from ledgerline.operators.recovery import plan_recovery, serve, snapshot_orders
from ledgerline.sinks import reports


def test_suppression_and_heartbeat(spark):
    rows = [("a", k, 10 * k, v) for k, v in enumerate([1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1])] + [("b", 0, 0, None), ("b", 1, 10, None), ("b", 2, 20, 5)]
    out = suppress(spark.createDataFrame(rows, "s string, n long, t long, v int"), "s", "n", "t", ["v"], 40)
    assert sorted((r.s, r.n, r.publish_seq) for r in out.collect()) == [("a", 0, 1), ("a", 3, 2), ("a", 5, 3), ("a", 9, 4), ("b", 0, 1), ("b", 2, 2)]


def test_subscriber_and_majority(spark):
    df = spark.createDataFrame([("x", n, 10 * n) for n in (1, 2, 4, 8)], "topic string, n long, ns long")
    assert tuple(subscriber_summary(df, "topic", "n", "ns").first()) == ("x", 4, 4, 30.0, 80)
    src = spark.createDataFrame([("sw",), ("hw",), ("sw",), ("hw",), ("none",)], "src string")
    assert tuple(majority(src, "src", ["hw", "sw", "none"]).first()) == ("hw", 2)


def test_server_rules_in_order(spark):
    rows = [("c", 0, 10, 5, 100), ("c", 1, 10, 5, 100), ("c", 2, 10, 5, 100), ("c", 3, 10, 0, 100), ("c", 2_000_000_000, 0, 5, 100), ("c", 3_000_000_000, 1, 5, 100), ("c", 4_000_000_000, 90, 50, 100), ("c", 5_000_000_000, 60, 30, 100), ("d", 0, 200, 1, 100)]
    out = serve(spark.createDataFrame(rows, "client string, arrival long, seq long, count long, next_seq long"), 2, 1.0, 95, 20)
    got = {(r.client, r.arrival): (r.outcome, r.granted) for r in out.collect()}
    assert list(got[k] for k in sorted(got)) == [("served", 5), ("served", 5), ("rate_limited", 0), ("bad", 0), ("unpublished", 0), ("retention", 0), ("trimmed", 10), ("trimmed", 20), ("unpublished", 0)]


def test_recovery_plan_and_snapshot(spark):
    gaps = spark.createDataFrame([(1, 5, 0), (1, 5, 2), (1, 5, 9), (1, 5000, 0)], "from long, to long, down_rounds int")
    out = [(r.cause, r.rounds, r.waited_ns) for r in plan_recovery(gaps, 1000, 3, 100).orderBy("to", "down_rounds").collect()]
    assert out == [("rerequest", 1, 0), ("rerequest", 3, 300), ("snapshot", 3, 700), ("snapshot", 0, 0)]
    live = spark.createDataFrame([(2, 1, "S", 5, 10, 7), (1, 1, "B", 4, 10, 9), (3, 1, "B", 4, 20, 3)], "root long, locate int, side string, price long, shares long, arrival long")
    assert [r.root for r in snapshot_orders(live, 50).collect()] == [3, 1, 2]


def test_tables_and_files(spark, tmp_path):
    hist = spark.createDataFrame([(1, "a,\"b\"", True, "total", 40, 3), (1, "x", False, "total", 2, 0)], "run int, label string, median boolean, metric string, bucket long, count long")
    reports.write_histogram(hist, str(tmp_path / "h"))
    back = reports.read_run_tables(spark, str(tmp_path / "*" / "*.csv")).collect()
    assert [(r.label, r.bucket_lo_ns, r.bucket_hi_ns, r["count"]) for r in back] == [("a,\"b\"", 40.0, 41.0, 3)]
    runs = spark.createDataFrame([(1, 10)], "run int, messages long")
    wide = reports.run_table(runs, spark.createDataFrame([(1, "A", 4), (1, "Z", 1)], "run int, type string, n long"), ["A", "D"]).first()
    assert (wide.count_A, wide.count_D, wide.count_other) == (4, 0, 6)
    assert reports.one_json(runs, runs).first().value == '{"run":1,"messages":10,"runs":[{"run":1,"messages":10}]}'
    assert reports.markdown(runs).splitlines()[2] == "| 1 | 10 |"
    (tmp_path / "log").write_text("sent 1,234 packets\nnothing\n")
    assert reports.scan_log(spark, str(tmp_path / "log"), r"sent ([\d,]+)").first().number == 1234.0
    assert reports.decades(hist, ["run"]).where("count > 0").first().bin == 16
    assert abs(reports.nines(spark.createDataFrame([(99, 100)], "cum_count long, all_count long")).first().nines - 2) < 1e-9
    top = spark.createDataFrame([("S", 5, 1000000, None, None, 1, 0)], "symbol string, bid_shares long, bid_price long, ask_price long, ask_shares long, bid_levels long, ask_levels long")
    assert "100.0000" in reports.top_of_book_lines(top).first().value
