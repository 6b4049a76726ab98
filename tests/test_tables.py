"""Tables that the daily job leaves, retention by month, references thinned before a join."""

import os

from pyspark.sql import functions as F

from harness import TESTDATA
from tidewire.operators import dedup
from tidewire.plans import daily
from tidewire.plans import views as V
from tidewire.sources.tables import drop_before, write_months

SF = f"{TESTDATA}/sf0.001"


def files(root):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_daily_tables_of_two_runs(spark, tmp_path, monkeypatch):
    root, crawl = str(tmp_path), V.bodies(spark, SF)
    answers, people, start = V.responses(spark, SF), V.recipients(spark, SF), F.expr("timestamp'2024-02-01 06:00:00'")
    rows = lambda name: {tuple(r) for r in spark.read.parquet(f"{root}/{name}").collect()}      # noqa: E731

    def run(name, part):
        return daily.run_stored(spark, root, name, part, answers, people, start, merge=name == "b")
    assert run("a", crawl.where("seq % 4 = 0"))
    first, before = rows("articles"), files(root)
    # the second run is lost after the queue, and starts over
    real = daily._extracted
    monkeypatch.setattr(daily, "_extracted", lambda *a: 1 / 0)
    try:
        run("b", crawl)
        raise AssertionError
    except ZeroDivisionError:
        monkeypatch.setattr(daily, "_extracted", real)
    assert run("b", crawl)
    after, left = rows("articles"), files(root)
    assert first < after and all(left[f] == t for f, t in before.items())         # run a's files are as they were
    assert not run("b", crawl) and not run("a", crawl) and files(root) == left
    # against one pass over both parts: nothing that run a stored comes again
    known = spark.read.parquet(f"{root}/articles").where("run = 'a'")
    want = dedup.dedup(crawl, "seq", known.select("url"), known.select("simhash")).select("seq")
    got = spark.read.parquet(f"{root}/articles").where("run = 'b'").select("seq")
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect()) and got.count()
    totals = {(r.run, r.name): r.n for r in spark.read.parquet(f"{root}/manifest").collect()}
    assert set(totals) == {(r, t) for r in "ab" for t in daily.STORED}
    for (name, table), n in totals.items():
        assert spark.read.parquet(f"{root}/{table}").where(F.col("run") == name).count() == n
    assert totals["b", "extraction_items"] and totals["b", "report_items"] and totals["b", "delivery_plan"] == totals["a", "delivery_plan"]


def test_months_go_as_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    times = [None, "2023-12-31 23:00:00", "2024-01-05 00:00:00", "2024-01-20 12:00:00", "2024-01-20 12:00:01", "2024-02-03 00:00:00", "2024-03-09 00:00:00"]
    df = spark.createDataFrame(list(enumerate(times)), "id bigint, t string").select("id", F.expr("CAST(t AS TIMESTAMP_NTZ)").alias("at"))
    write_months(df, path, "at")
    before = files(path)
    gone, edge = drop_before(spark, path, "at", F.expr("timestamp_ntz'2024-04-19 12:00:01'"), 90)
    assert (gone, edge) == (["2023-12"], "2024-01")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 4, 5, 6]
    after = files(path)
    kept = {f: t for f, t in before.items() if "month=2024-02" in f or "month=2024-03" in f or "HIVE_DEFAULT" in f}
    assert len(kept) == 3 and all(after[f] == t for f, t in kept.items()) and not any("month=2023-12" in f for f in after)
    assert drop_before(spark, path, "at", F.expr("timestamp_ntz'2024-04-19 12:00:01'"), 90)[0] == []
    assert drop_before(spark, path, "at", F.expr("timestamp_ntz'2024-12-01 00:00:00'"), 90) == (["2024-01", "2024-02", "2024-03"], None)
    assert [r.id for r in spark.read.parquet(path).collect()] == [0]


def test_references_are_thinned_in_the_scan(spark, tmp_path):
    rows = [(i, f"u{i}" if i % 3 else None, i * 7 if i % 2 else None) for i in range(20_000)]
    path = str(tmp_path / "stored")
    spark.createDataFrame(rows, "id bigint, url string, simhash bigint").write.parquet(path)
    stored = spark.read.parquet(path)
    assert dedup.known_references(stored, ["id"]).count() == sum(1 for r in rows if r[1] is not None or r[2] is not None)
    fresh = spark.createDataFrame([("u7", None), ("none", 35), (None, None)], "url string, simhash bigint")
    left = dedup.known_references(stored, ["id"], fresh)
    assert {5, 7} <= {r.id for r in left.collect()} and left.count() < 10
    assert dedup.known_references(stored, ["id"], fresh.limit(0)).count() == 0


def written(df):
    """Bytes that the plan of `df` shuffles."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        metric = node.metrics().get("shuffleBytesWritten")
        total += metric.get().value() if metric.isDefined() else 0
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
    return total


def test_thinned_references_shuffle_less(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.range(200_000).select(F.concat(F.lit("https://news.example.com/"), "id").alias("url"), F.col("id").alias("simhash")).write.parquet(path)
    stored, fresh = spark.read.parquet(path), spark.range(0, 400_000, 1000).select(
        F.concat(F.lit("https://news.example.com/"), "id").alias("url"), F.lit(None).cast("bigint").alias("simhash"))
    plain = fresh.hint("merge").join(stored.select("url"), "url", "left_anti")
    thin = fresh.hint("merge").join(dedup.known_references(stored, fresh=fresh).select("url"), "url", "left_anti")
    assert sorted(r.url for r in plain.collect()) == sorted(r.url for r in thin.collect())
    assert written(thin) * 10 < written(plain)
