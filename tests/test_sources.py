"""Sources, sinks and streams on small files."""

from __future__ import annotations

import json
import zipfile
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators.integrity import IntegrityError, promote, pull_coverage, require_coverage, write_checked, write_ordered
from tidemark.sources import readers
from tidemark.session import NoSharedFolder, shared_dir
from tidemark.streaming.streams import sessions, stream_static_lookup, weekly_last

from .conftest import day

BAR = {k: 1.0 for k in readers.BAR_FIELDS}


def test_json_bars(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"date": "2020-01-02T00:00:00.000Z", **BAR}, {"date": "2020-01-03T00:00:00.000Z", **BAR}]))
    got = readers.read_json_bars(spark, str(p), "AAA").collect()
    assert [r["date"] for r in got] == [date(2020, 1, 2), date(2020, 1, 3)] and got[0]["adj_close"] == 1.0
    p.write_text(json.dumps([{"date": "2020-01-02", **BAR}] * 2))
    with pytest.raises(readers.BadSource):
        readers.read_json_bars(spark, str(p), "AAA")
    p.write_text(json.dumps([{"date": "2020-01-02", **BAR}, {"date": "2020-01-03", "open": 1.0}]))  # whole in one bar only
    with pytest.raises(ValueError, match="lacks"):
        readers.read_json_bars(spark, str(p), "AAA")
    p.write_text(json.dumps([{"date": "2020-01-02", **BAR, "volume": None}]))
    assert readers.read_json_bars(spark, str(p), "AAA").first()["volume"] is None
    p.write_text("[]")
    with pytest.raises(readers.BadSource, match="no bars"):
        readers.read_json_bars(spark, str(p), "AAA")


@pytest.mark.parametrize("head", ["observation_date,DTB3", "DATE,VALUE", "date,anything"])
def test_rate_csv(spark, tmp_path, head):
    p = tmp_path / "r.csv"
    p.write_text(f"{head}\n2020-01-02,5.25\n2020-01-03,.\n2020-01-06,NaN\n")
    assert [(r["date"], r["rate"]) for r in readers.read_rate_csv(spark, str(p), "DTB3").collect()] == [(date(2020, 1, 2), 0.0525)]
    assert readers.read_rate_csv(spark, str(p), "DTB3", date(2020, 1, 2)).count() == 1
    with pytest.raises(readers.BadSource, match="begins"):
        readers.read_rate_csv(spark, str(p), "DTB3", date(2019, 1, 1))
    for rows, said in (("2020-01-02,90", "implausible"), ("2020-01-02,1\n2020-01-02,1", "repeated"), ("2020-01-02,.", "usable")):
        p.write_text(f"{head}\n{rows}\n")
        with pytest.raises(readers.BadSource, match=said):
            readers.read_rate_csv(spark, str(p), "DTB3")


def test_saved_rates_and_ordered_files(spark, tmp_path):
    df = spark.createDataFrame([(day(k), k / 100.0) for k in (3, 1, 2)], "date date, rate double")
    write_ordered(df, str(tmp_path / "r.parquet"), ["date"])
    files = sorted((tmp_path / "r.parquet").glob("*.parquet"))
    assert [r.date for f in files for r in spark.read.parquet(str(f)).collect()] == [day(1), day(2), day(3)]
    assert readers.load_rate(spark, str(tmp_path / "r.parquet")).count() == 3
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        readers.load_rate(spark, str(tmp_path / "none.parquet"))


def test_bulk_archive_and_typed_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("t.csv", "a,b\n1,x\n2,\n")
        z.writestr("readme.txt", "no")
    out = readers.unzip_one_csv(spark, str(tmp_path / "x.zip"), str(tmp_path / "csv"))
    df = readers.read_csv_table(spark, out)
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.count() == 2
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("a.csv", "a\n")
        z.writestr("b.csv", "a\n")
    with pytest.raises(Exception, match="2 CSV"):
        readers.unzip_one_csv(spark, str(tmp_path / "y.zip"), str(tmp_path / "csv2"))
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\nq,1\n")
    with pytest.raises(Exception, match="(?i)malformed|cast"):
        readers.read_csv_table(spark, str(bad), "a int, b int").collect()


def test_partitioned_bars(spark, tmp_path):
    df = spark.createDataFrame([("A", date(2020, 1, 2), 1.0), ("B", date(2020, 1, 2), 2.0)], "ticker string, date date, close double")
    readers.write_bars(df, str(tmp_path / "bars"))
    assert readers.load_bars(spark, str(tmp_path / "bars"), ["A"]).count() == 1
    with pytest.raises(readers.BadSource, match="C"):
        readers.load_bars(spark, str(tmp_path / "bars"), ["A", "C"])
    got = {r["ticker"]: r["missing"] for r in pull_coverage(df, spark.createDataFrame([("A",), ("C",)], "ticker string")).collect()}
    assert got == {"A": False, "C": True}
    report = pull_coverage(df, spark.createDataFrame([("A",), ("C",)], "ticker string"))
    with pytest.raises(IntegrityError, match="C"):
        require_coverage(report)
    assert require_coverage(report.where("ticker = 'A'")).count() == 1


def test_views_fail_on_a_missing_table(spark):
    readers.register_tables(spark, "/root/testdata/sf0.001", ["region", "nation"])
    assert spark.sql("select count(*) from nation join region on n_regionkey = r_regionkey").first()[0] == 25
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        readers.register_tables(spark, "/root/testdata/sf0.001", ["region", "nothing_here"])


def test_documents_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    got = {r["name"]: r["raw"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo", "b.txt": "three"}


def page(number: int, size: int):
    return [(number * size + k,) for k in range(size if number < 2 else 1)]


def lost(number: int, size: int):
    return None if number == 1 else [(number,)]


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    read = lambda f: spark.read.format("paged").options(fetch=f"tests.test_sources:{f}", page_size="3", max_pages="3", ddl="i long").load()
    assert sorted(r[0] for r in read("page").collect()) == [0, 1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="page 1 failed"):
        read("lost").collect()
    assert readers.page_status([3, 3, 1], 3, 3) == "complete" and readers.page_status([3, 3, 3], 3, 3) == "truncated_maxpages" and readers.page_status([3, None], 3, 3) == "error"


def test_quarantine_and_promotion(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    path = str(tmp_path / "t.parquet")
    good = {"some": F.count(F.lit(1)) > 0}
    assert write_checked(df, path, good)["rows"] == 2 and spark.read.parquet(path).count() == 2
    assert json.loads((tmp_path / "t.json").read_text())["rows"] == 2
    with pytest.raises(IntegrityError):
        write_checked(df, str(tmp_path / "u.parquet"), {"no_nulls": F.count("v") == F.count(F.lit(1))})
    assert not (tmp_path / "u.parquet").exists() and (tmp_path / "u_SUSPECT.parquet").exists()
    with pytest.raises(IntegrityError):
        promote(spark, str(tmp_path / "u.parquet"), {"no_nulls": F.count("v") == F.count(F.lit(1))})
    promote(spark, str(tmp_path / "u.parquet"), good)
    assert spark.read.parquet(str(tmp_path / "u.parquet")).count() == 2


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def stream(spark, tmp_path, rows, ddl):
    """Each row is a file of its own, so watermarks move between micro-batches."""
    src = tmp_path / "in"
    for r in rows:
        spark.createDataFrame([r], ddl).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_weekly_stream(spark, tmp_path):
    at = lambda d, h=0: datetime(2020, 1, d, h)
    rows = [(1, at(6), 1.0), (1, at(10, 5), 2.0), (1, at(13), 3.0), (1, at(29), 9.0)]
    drain(weekly_last(stream(spark, tmp_path, rows, "k int, ts timestamp, v double"), "ts", "k", "v"), "weekly")
    got = [(r["week_end"].date(), r["v"], r["n"]) for r in spark.table("weekly").orderBy("week_end").collect()]
    assert got == [(date(2020, 1, 11), 2.0, 2), (date(2020, 1, 18), 3.0, 1)]


def test_stream_static_lookup(spark, tmp_path):
    rows = [(1, datetime(2020, 1, 5)), (1, datetime(2020, 1, 10)), (2, datetime(2020, 1, 5))]
    facts = spark.createDataFrame([(1, datetime(2020, 1, 1), datetime(2020, 1, 10), "a"), (1, datetime(2020, 1, 10), None, "b")], "k int, valid_from timestamp, valid_to timestamp, c string")
    drain(stream_static_lookup(stream(spark, tmp_path, rows, "k int, ts timestamp"), facts, "k", "ts", ["c"]), "looked")
    assert sorted((r["k"], r["ts"].day, r["c"] or "") for r in spark.table("looked").collect()) == [(1, 5, "a"), (1, 10, "b"), (2, 5, "")]


def test_session_stream(spark, tmp_path):
    at = lambda m: datetime(2020, 1, 1, m // 60, m % 60)
    rows = [(1, at(0)), (1, at(3)), (1, at(60)), (2, at(61)), (2, at(600)), (3, at(900))]
    drain(sessions(stream(spark, tmp_path, rows, "k long, ts timestamp"), "k", "ts", 600), "sess")
    got = {(r["key"], r["n"]) for r in spark.table("sess").collect()}
    assert {(1, 2), (1, 1), (2, 1)} <= got


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: none))
    with pytest.raises(NoSharedFolder, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))
    conf.get = lambda key, default=None: "hdfs://shared/x"
    assert shared_dir(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs://shared/x"
