"""Filters, summaries and streaming forms as registered queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import no_nan, parse_day
from ..operators import factors, filings, filters, harness, trend
from ..session import scratch, table
from ..streaming.streams import weekly_last
from . import panel_queries, text_queries, trend_queries
from .common import out, sql_out
from .pit_queries import sql_day

FROM, TO = date(2013, 1, 1), date(2014, 12, 31)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tickers").select("permaticker", "ticker", parse_day("firstpricedate").alias("first"), parse_day("lastpricedate").alias("last")).distinct()


def span_overlap(spark, d):
    return out(filters.overlapping(_windows(spark, d), FROM, TO))


def known_by_span_end(spark, d):
    return out(filters.known_by(table(spark, d, "filings").select("filing_id", "acceptance_date").distinct(), "acceptance_date", TO))


def pilot_sample(spark, d):
    ids = table(spark, d, "tickers").select("permaticker").distinct()
    return out(filters.seeded_sample(ids, 25, ["permaticker"], 7))


def largest_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars")).where("chars is not null")
    return out(filters.head_by(docs, [F.desc("chars"), F.col("doc_id")], 20))


def filing_summary(spark, d):
    f = table(spark, d, "filings").where("permaticker is not null").select("permaticker", "acceptance_date", "filing_id", "form").distinct()
    return out(filters.group_summary(f, ["permaticker"], "acceptance_date", "filing_id", ["form"]))


def status_value_counts(spark, d):
    return out(filters.value_counts(table(spark, d, "panel"), "fwd_status"))


def dimension_counts(spark, d):
    return out(filters.value_counts(table(spark, d, "fundamentals"), "dimension"))


def report_lag(spark, d):
    f = table(spark, d, "fundamentals").select("fund_id", "dimension", "reportperiod", parse_day("datekey").alias("known")).distinct()
    return out(filters.median_lag(f, ["dimension"], "reportperiod", "known"))


def identity_master(spark, d):
    return out(panel_queries._meta(spark, d))


def _found_sections(spark, d):
    """The sections found in each document, a row each, NULL where it lacks one."""
    both = [F.struct(F.lit(n).alias("section"), F.col(n).alias("text")) for n in ("mdna", "risk_factors")]
    return text_queries._extracted(spark, d).select("doc_id", F.explode(F.array(*both)).alias("x")).select("doc_id", "x.*")


def corpus_funnel(spark, d):
    return out(filters.corpus_funnel(_found_sections(spark, d), "doc_id", "section", "text", ("mdna", "risk_factors")))


def pivot_sections(spark, d):
    got = filings.pivot_sections(_found_sections(spark, d), ["doc_id"])
    return out(got.select("doc_id", F.md5("mdna").alias("mdna"), F.md5("risk_factors").alias("risk_factors")))


def section_prompts(spark, d):
    got = filings.pivot_sections(_found_sections(spark, d), ["doc_id"])
    prompt = tx.section_prompt({"MD&A": F.col("mdna"), "Risk factors": F.col("risk_factors")})
    return out(got.select("doc_id", F.md5(prompt).alias("digest"), tx.content_key(F.md5(prompt), F.lit("v1")).alias("key")))


def design_matrix(spark, d):
    p = table(spark, d, "panel").select("scenario_id", F.col("date").alias("day"), "permaticker", no_nan("composite").alias("composite"), "ranked").distinct()
    return out(factors.design_matrix(p, ["scenario_id", "day", "permaticker"], ["composite", "not_there"]))


def first_active_day(spark, d):
    return out(trend.first_active(trend_queries._weights(spark, d)))


def evaluate_long_only(spark, d):
    got = harness.evaluate(panel_queries._rank_panel(spark, d), ["scenario_id", "day"], "day", "permaticker", "composite", "decile", "ret", ["scenario_id"])
    return out(got["long_only"])


def walk_forward_folds(spark, d):
    days = table(spark, d, "panel").select(F.col("date").alias("day")).distinct()
    return out(filters.walk_forward(days, "day", 8, 30, 21))


def stream_weekly(spark, d):
    """The weekly resample as a stream run to its end over the events, into files.

    Weeks are given out once the watermark has passed them; a day far in the future closes the last one. The files lie in the
    shared folder, so nothing is kept on the driver.
    """
    path = f"{d}/events.parquet"
    schema = table(spark, d, "events").schema
    live = spark.readStream.schema(schema).parquet(path if _is_dir(spark, path) else f"{path}*").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    far = scratch(spark, "weekly-in")
    spark.createDataFrame([(datetime(2200, 1, 1), None, None)], live.schema).coalesce(1).write.parquet(far)
    closing = spark.readStream.schema(live.schema).parquet(far)
    weekly = weekly_last(live.unionByName(closing), "ts", "user_id", "value")
    target = scratch(spark, "weekly-out")
    for _ in range(2):  # the watermark of a batch closes weeks in the next one
        query = weekly.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return out(spark.read.schema(weekly.schema).parquet(target).where("user_id is not null").select("user_id", F.to_date("week_end").alias("week_end"), "value", "n"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {f.__name__: f for f in (
    span_overlap, known_by_span_end, pilot_sample, largest_documents, filing_summary, status_value_counts, dimension_counts, report_lag, identity_master,
    corpus_funnel, pivot_sections, section_prompts, design_matrix, first_active_day, evaluate_long_only, walk_forward_folds, stream_weekly,
)}

_PIV = f"{text_queries._FOUND}, q as (select doc_id, mdna m, risk_factors r from se where mdna is not null or risk_factors is not null)"
SQL = {
    "span_overlap": f"select * from (select distinct cast(permaticker as bigint) permaticker, ticker, {sql_day('firstpricedate')} first, {sql_day('lastpricedate')} last from tickers) where first <= date '2014-12-31' and last >= date '2013-01-01'",
    "known_by_span_end": "select distinct filing_id, cast(acceptance_date as date) acceptance_date from filings where acceptance_date <= date '2014-12-31'",
    "largest_documents": "select doc_id, length(text) chars from documents where text is not null order by chars desc, doc_id limit 20",
    "filing_summary": "with f as (select distinct permaticker, cast(acceptance_date as date) d, filing_id, form from filings where permaticker is not null and acceptance_date is not null), r as (select *, row_number() over (partition by permaticker order by d, filing_id) a, row_number() over (partition by permaticker order by d desc, filing_id desc) z from f) select cast(permaticker as bigint) permaticker, count(*) n, min(d) first_acceptance_date, max(case when a = 1 then form end) first_form, max(d) last_acceptance_date, max(case when z = 1 then form end) last_form from r group by 1",
    "status_value_counts": "select fwd_status, count(*) n from panel group by 1",
    "dimension_counts": "select dimension, count(*) n from fundamentals group by 1",
    "report_lag": sql_out(f"with f as (select distinct fund_id, dimension, cast(reportperiod as date) r, {sql_day('datekey')} k from fundamentals) select dimension, median(k - r) median_lag, count(*) n from f where r is not null and k is not null group by 1", "median_lag"),
    "identity_master": f"select cast(permaticker as bigint) permaticker, b last, category, exchange from (select permaticker, {sql_day('firstpricedate')} a, {sql_day('lastpricedate')} b, category, exchange from tickers) where a <= b qualify row_number() over (partition by permaticker order by b desc, category desc nulls last, exchange desc nulls last) = 1",
    "corpus_funnel": f"with {text_queries._FOUND} select count(*) filings, count(mdna) with_mdna, count(risk_factors) with_risk_factors, count(*) filter (where mdna is null and risk_factors is null) without_any from se",
    "pivot_sections": f"with {_PIV} select doc_id, md5(m) mdna, md5(r) risk_factors from q",
    "section_prompts": f"""with {_PIV}, p as (select doc_id, md5('MD&A: ' || coalesce(m, 'NOT PRESENT') || chr(10) || 'Risk factors: ' || coalesce(r, 'NOT PRESENT')) digest from q) select doc_id, digest, sha256('["' || digest || '","v1"]') as key from p""",
    "design_matrix": sql_out("select distinct scenario_id, cast(date as date) as day, permaticker, case when not isnan(composite) then composite end composite from panel where ranked", "composite", "permaticker"),
    "first_active_day": f"with {trend_queries._EXA}, fa as (select day, sum(abs(w)) e from xw group by day) select coalesce(min(case when e > 0 then day end), min(day)) as day from fa",
    "evaluate_long_only": panel_queries.SQL["cost_curve"],
    "walk_forward_folds": "with s as (select min(cast(date as date)) a, max(cast(date as date)) z from panel), f as (select k fold, a, (z - a + 1) / 9.0 len from s, range(1, 9) t(k)), g as (select fold, a + cast(floor(len * fold) as int) + case when fold > 1 then 21 else 0 end st, a + cast(floor(len * (fold + 1)) as int) en from f) select cast(fold as bigint) fold, st - 31 train_to, st test_from, en - 1 test_to from g",
    "stream_weekly": sql_out("with e as (select user_id, ts, value, cast(ts as date) - cast((isodow(cast(ts as date)) + 1) % 7 as int) w from events) select user_id, w + 7 week_end, arg_max(value, ts) as value, count(*) n from e where user_id is not null group by 1, 2", "value"),
    "pilot_sample": "select permaticker from (select distinct permaticker from tickers) order by md5(permaticker || '|7'), permaticker limit 25",
}
