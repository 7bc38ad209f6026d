"""Filings, document text, feature audit and integrity checks as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import acceptance_date, canon_cik, cik_from_url, no_nan
from ..operators import audit, factors, filings, integrity
from ..operators.asof import asof_join, with_age_limit
from ..session import staged, table
from .common import out, sql_out
from .pit_queries import STALE_DAYS, sql_day

# Word lists for the tone measure, in the words of the test corpus.
GOOD = ["RECOVERED", "EXPANDED", "WIDENED", "IMPROVED", "PERSIST", "CLOSED"]
COUNTED = {"mdna_uncertainty": "may", "mdna_liquidity_stress": "loan", "rf_severity": "harm", "rf_specificity": "could", "rf_litigation": "claim"}
BAD = ["WEAKEN", "WRITTEN", "MISSED", "FELL", "DECLINED", "SLIPPED", "HARM", "IMPAIRED", "INTERRUPT"]


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _turns(spark, d):
    """Each document with the last non-blank text of the same company before it."""
    docs = _docs(spark, d).where("cik is not null and published is not null").select("doc_id", "cik", "published", "text")
    return filings.with_prior(docs, "cik", ["published", "doc_id"], ["text"], "doc_id")


def filing_qualify(spark, d):
    f = _filings(spark, d)
    return out(f.select("filing_id", filings.base_form(F.col("form")).alias("base"), filings.is_amendment(F.col("form")).alias("amended"), filings.qualifies(F.col("form")).alias("qualifies")))


def filing_dedupe(spark, d):
    f = table(spark, d, "filings").select("accession", "form", "acceptance_datetime", F.col("filing_id").alias("ordinal"))
    return out(filings.assemble([f]).select("accession", "form", "acceptance_date"))


def amendment_count(spark, d):
    f = _filings(spark, d)
    kind = F.col("base").isin(*filings.QUALIFYING_FORMS)
    got = f.select(filings.base_form(F.col("form")).alias("base"), filings.is_amendment(F.col("form")).alias("a"))
    return out(got.agg(F.sum((kind & F.col("a")).cast("int")).alias("amendments"), F.count(F.lit(1)).alias("n")))


def cik_canon(spark, d):
    return out(table(spark, d, "bridge").select("permaticker", F.col("cik").alias("spelled"), canon_cik("cik").alias("plain")).distinct())


def acceptance_days(spark, d):
    return out(_filings(spark, d).select("filing_id", acceptance_date("acceptance_datetime").alias("day")))


def _attributed(spark, d):
    f = _filings(spark, d).select("filing_id", "accession", "cik", "acceptance_date").where("accession is not null and acceptance_date is not null")
    return f, filings.attribute_filings(f, filings.prepared_bridge(table(spark, d, "bridge")), policy="drop")


def cik_window_attribution(spark, d):
    return out(_attributed(spark, d)[1].select("filing_id", "owner"))


def attribution_stats(spark, d):
    f, got = _attributed(spark, d)
    return out(filings.attribution_stats(f, filings.prepared_bridge(table(spark, d, "bridge")), got))


def truncate_sections(spark, d):
    return out(_docs(spark, d).select("doc_id", tx.is_truncated("text").alias("truncated"), F.length(tx.truncate_middle(F.col("text"))).alias("kept"), F.md5(tx.truncate_middle(F.col("text"))).alias("digest")))


def prior_section_text(spark, d):
    return out(_turns(spark, d).select("doc_id", F.md5("prior_text").alias("prior")))


def jaccard_change(spark, d):
    return out(_turns(spark, d).select("doc_id", tx.word_change("text", "prior_text").alias("change")))


def stub_density(spark, d):
    return out(_docs(spark, d).select("doc_id", tx.start_density("text", "risk").alias("risk"), tx.start_density("text", "may").alias("may"), tx.length_tone("text").alias("tone")))


def lexicon_tone(spark, d):
    return out(_docs(spark, d).select("doc_id", tx.lexicon_tone("text", GOOD, BAD).alias("tone")))


def _named(spark, d):
    """Documents beside one registrant of their CIK. As the texts name places and not registrants, the name is
    joined by the document's first words and the ticker by the first capitals in it."""
    names = table(spark, d, "bridge").select(canon_cik("cik").alias("plain"), "name", "ticker").where("plain <> ''").groupBy("plain").agg(F.min("name").alias("name"), F.min("ticker").alias("ticker"))
    docs = _docs(spark, d).withColumn("plain", canon_cik("cik")).join(names, "plain", "left")
    alias = F.nullif(F.regexp_extract("text", r"([A-Z][a-z]{4,}) \d{4}", 1), F.lit(""))
    return docs.withColumns({"aliases": F.array_compact(F.array(alias)), "number": F.nullif(F.regexp_extract("text", r"\b([3-9]\d{3})\b", 1), F.lit("")), "code": F.nullif(F.regexp_extract("text", r"\b([A-Z]{3,4})\b", 1), F.lit(""))})


def mask_identity(spark, d):
    return out(_named(spark, d).select("doc_id", tx.mask("text", "name", F.coalesce("code", "ticker"), F.coalesce("number", "plain"), F.col("aliases")).alias("masked")))


def prepared_sections(spark, d):
    text, cut = tx.prepared("text", "name", "ticker", "plain")
    return out(_named(spark, d).select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("chars"), cut.alias("cut")))


def html_to_text(spark, d):
    return out(_docs(spark, d).select("doc_id", tx.html_to_text("text").alias("plain")))


def _extracted(spark, d, *keep: str):
    """Documents with the sections that the form of their source holds."""
    form = tx.form_of_source("source")
    text = _docs(spark, d).select("doc_id", *keep, form.alias("form"), tx.rendered("text", form, F.lit(True)).alias("plain"))
    return text.select("doc_id", *keep, *[c.alias(k) for k, c in tx.sections(F.col("plain"), F.col("form")).items()])


def section_extract(spark, d):
    return out(_extracted(spark, d))


def submission_sections(spark, d):
    """Documents wrapped as full submissions: an exhibit that is longer, then the filing, every third under an amended type."""
    form = tx.form_of_source("source")
    kind = F.when(F.col("doc_id") % 3 == 0, F.concat(form, F.lit("/A"))).when(F.col("doc_id") % 7 == 0, "8-K").otherwise(form)
    part = lambda k, body: F.concat(F.lit("<DOCUMENT>\n<TYPE>"), k, F.lit("\n<TEXT>\n"), body, F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    raw = F.concat(part(F.lit("EX-99"), F.concat("text", F.lit(" and more"))), part(kind, F.col("text")))
    text = _docs(spark, d).select("doc_id", form.alias("form"), tx.rendered(raw, form, F.lit(False)).alias("plain"))
    found = tx.sections(F.col("plain"), F.col("form"))
    return out(text.select("doc_id", F.md5("plain").alias("digest"), *[F.md5(c).alias(k) for k, c in found.items()]))


def stub_features(spark, d):
    """The ten measures over the sections that each document holds, and the company's sections before."""
    rows = staged(_extracted(spark, d, "cik", "published").where("cik is not null and published is not null"))  # found once, read for each join
    turns = filings.with_prior(rows, "cik", ["published", "doc_id"], ["mdna", "risk_factors"], "doc_id")
    return out(filings.stub_features(turns, COUNTED).select("doc_id", *tx.FEATURES))


def absent_enforced(spark, d):
    """Scores that an outside extractor gave for every document, in range and only where the text they describe is there."""
    rows = _extracted(spark, d).withColumns({"prior_mdna": F.when(F.col("doc_id") % 2 == 0, F.col("mdna")), "prior_risk_factors": F.col("risk_factors")})
    given = rows.withColumns({k: F.lit(0.1 * i).cast("double") + F.col("doc_id") % 5 - 2.0 for i, k in enumerate(tx.FEATURES)})
    return out(filings.enforce_absent(given).select("doc_id", *tx.FEATURES))


def feature_clamp(spark, d):
    return out(table(spark, d, "panel").select("scenario_id", "date", "permaticker", tx.clamp(F.col("composite").cast("string"), -0.5, 0.5).alias("clamped")).distinct())


def feature_normalize(spark, d):
    p = table(spark, d, "panel").select("scenario_id", "date", "permaticker", no_nan("fwd_ret_21").alias("x"), "ranked").distinct()
    z = factors.normalize_within(p.withColumn("k", F.concat_ws("|", F.col("scenario_id").cast("string"), F.col("date").cast("string"))), "k", ["x"])
    return out(z.select("scenario_id", "date", "permaticker", "z_x"))


def coverage_funnel(spark, d):
    feats = table(spark, d, "feat_t").select("feat_id", "t", F.col("permaticker").cast("long").alias("permaticker")).distinct()
    g = table(spark, d, "filings").where("not is_amendment").select(F.col("permaticker").cast("long").alias("permaticker"), "acceptance_date", "filing_id")
    got = asof_join(feats, g, ["permaticker"], "t", "acceptance_date", ["filing_id"], strict=True, how="left", as_of="filed")
    return out(filings.coverage_funnel(with_age_limit(got, "t", "filed", ["filing_id"], STALE_DAYS), ["filing_id"]))


def missing_report(spark, d):
    return out(filings.missing_report(table(spark, d, "feat_t").distinct(), ["close_t", "vol_252", "dollarvol_60"]))


def _scored(spark, d):
    return table(spark, d, "panel").select("scenario_id", F.col("date").alias("day"), "permaticker", no_nan("composite").alias("x"), no_nan("fwd_ret_21").alias("y")).distinct()


def masked_probe(spark, d):
    return out(audit.masked_probe(_scored(spark, d), ["scenario_id"], "x", "y").drop("p", "rejected"))


def masked_probe_verdict(spark, d):
    return out(audit.masked_probe(_scored(spark, d), ["scenario_id"], "x", "y"))


def identity_sensitivity(spark, d):
    """Shifts of three sizes, by scenario, so that some are within half a deviation and some are not."""
    shifted = _scored(spark, d).withColumn("shift", F.col("x") * (F.col("scenario_id") % 3) * 0.05)
    return out(audit.identity_sensitivity(shifted, ["scenario_id"], "shift", "y"))


def within_date_ic(spark, d):
    return out(audit.within_date_ic(_scored(spark, d), ["scenario_id"], "day", "x", "y"))


def lexicon_agreement(spark, d):
    """A second tone that follows the first closely in every second scenario."""
    other = F.when(F.col("scenario_id") % 2 == 0, F.col("x") + F.col("y") * 3.0).otherwise(F.col("y"))
    return out(audit.agreement(_scored(spark, d).withColumn("other", other), ["scenario_id"], "x", "other"))


def extractor_agreement(spark, d):
    f = table(spark, d, "feat_t").select("feat_id", no_nan("close_t").alias("close_t"), no_nan("vol_252").alias("vol_252")).distinct()
    other = f.select("feat_id", (F.col("close_t") * 0.9 + 1.0).alias("close_t"), (-F.col("vol_252")).alias("vol_252"))
    return out(audit.compare_extractors(f, other, "feat_id", ["close_t", "vol_252"]))


def extractor_verdict(spark, d):
    """The verdict on extractors that differ little, in part and much."""
    f = table(spark, d, "feat_t").select("feat_id", no_nan("close_t").alias("close_t"), no_nan("vol_252").alias("vol_252"), F.col("hist_days").cast("double").alias("hist_days")).distinct()
    got = None
    for name, cols in (("little", {"close_t": F.col("close_t") * 2, "vol_252": F.col("vol_252") + 1, "hist_days": F.col("hist_days")}), ("part", {"close_t": F.col("close_t"), "vol_252": -F.col("vol_252"), "hist_days": F.col("hist_days")}), ("much", {"close_t": -F.col("close_t"), "vol_252": -F.col("vol_252"), "hist_days": F.col("feat_id") % 7.0})):
        other = f.select("feat_id", *[c.alias(k) for k, c in cols.items()])
        row = audit.extractor_verdict(audit.compare_extractors(f, other, "feat_id", list(cols))).select(F.lit(name).alias("differ"), "*")
        got = row if got is None else got.unionByName(row)
    return out(got)


def manifest_rows(spark, d):
    """Filings as manifests of parallel arrays, the last one an entry short, and back to rows."""
    f = _filings(spark, d).where("cik is not null and filing_id is not null").groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("filing_id", "form", "accession", "acceptance_datetime"))).alias("x"))
    short = F.slice(F.col("x.acceptance_datetime"), F.lit(1), F.size("x") - 1)
    m = f.select("cik", F.col("x.form").alias("form"), F.col("x.accession").alias("accessionNumber"), short.alias("acceptanceDateTime"))
    return out(filings.flatten_manifest(m, "cik", {"form": "form", "accessionNumber": "accession", "acceptanceDateTime": "acceptance_datetime"}))


def fetch_plan(spark, d):
    k = F.col("filing_id") % 4
    doc = F.when(k == 0, "a.HTM").when(k == 1, "b.html").when(k == 2, "c.txt")
    f = _filings(spark, d).where("accession is not null").select("filing_id", canon_cik("cik").alias("cik"), "accession", doc.alias("primary_document"))
    return out(filings.fetch_plan(f).select("filing_id", "is_html", F.array_join("urls", " ").alias("urls")))


def cik_of_url(spark, d):
    urls = table(spark, d, "bridge").select("permaticker", F.when(F.col("cik").isNotNull(), F.concat(F.lit("https://x.example/browse?action=get&CIK=000"), F.trim("cik"), F.lit("&type=10-K"))).alias("url")).distinct()
    return out(urls.select("permaticker", "url", cik_from_url("url").alias("cik")))


def integrity_summary(spark, d):
    return out(integrity.integrity_summary(table(spark, d, "sep_prices"), ["closeadj", "volume", "ret"], "date", "ticker"))


def key_multiplicity(spark, d):
    return out(integrity.multiplicity(table(spark, d, "tickers"), "ticker", "permaticker"))


def present_coverage(spark, d):
    return out(integrity.coverage(table(spark, d, "bridge"), "cik", F.col("isdelisted") == "Y"))


def repeated_bars(spark, d):
    return out(integrity.repeated_keys(table(spark, d, "sep_prices"), ["ticker", "date"]))


def _days(spark, d):
    return table(spark, d, "sep_prices").groupBy("ticker", F.col("date").alias("day")).agg(F.max("closeadj").alias("price"))


def stale_runs(spark, d):
    return out(integrity.stale_runs(_days(spark, d), "ticker", "day", "price"))


def gap_check(spark, d):
    return out(integrity.gap_check(_days(spark, d), "ticker", "day"))


def bar_integrity(spark, d):
    return out(integrity.bar_check(_days(spark, d), "ticker", "day", "price"))


QUERIES = {f.__name__: f for f in (
    filing_qualify, filing_dedupe, amendment_count, cik_canon, acceptance_days, cik_window_attribution, attribution_stats, truncate_sections, prior_section_text,
    jaccard_change, stub_density, lexicon_tone, mask_identity, prepared_sections, html_to_text, section_extract, submission_sections, stub_features, absent_enforced, feature_clamp, feature_normalize, coverage_funnel,
    missing_report, masked_probe, masked_probe_verdict, identity_sensitivity, within_date_ic, lexicon_agreement, extractor_agreement, extractor_verdict, manifest_rows, fetch_plan, cik_of_url, integrity_summary,
    key_multiplicity, present_coverage, repeated_bars, stale_runs, gap_check, bar_integrity,
)}


_QUAL = "('10-K', '10-K405', '10-KSB', '10-KSB405', '10-KT', '10-Q', '10-QT')"
_CIK = "coalesce(regexp_replace(regexp_extract(trim(cik), '^(\\d+)(\\.0*)?$', 1), '^0+([0-9])', '\\1'), '')"
_ATT = f"""
br as (select distinct permaticker, {_CIK} c, {sql_day("firstpricedate")} a, {sql_day("lastpricedate")} b from bridge),
bk as (select * from br where c <> '' and a is not null and b is not null and permaticker is not null),
fi as (select distinct filing_id, accession, {_CIK} c, cast(acceptance_date as date) d from filings where accession is not null and acceptance_date is not null),
hi as (select distinct fi.*, bk.permaticker owner from fi join bk on bk.c = fi.c and fi.d between bk.a and bk.b),
at1 as (select * from hi where accession not in (select accession from hi group by 1 having count(distinct owner) > 1))"""
_W = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
_TURN = """
tu as (select doc_id, text, last_value(case when length(trim(text, ' ')) > 0 then text end ignore nulls) over (partition by cik order by cast(published as date), doc_id rows between unbounded preceding and 1 preceding) p
  from documents where cik is not null and published is not null)"""


def _density(word: str, c: str = "text") -> str:
    w = f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"
    return f"case when length(trim({c}, ' ')) > 0 then least(1.0, len(list_filter({w}, lambda w: starts_with(w, '{word}'))) / greatest(len({w}), 1) * 20.0) end"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _tidy_sql(x: str) -> str:
    """The only character reference in the test corpus is that of the ampersand."""
    x = f"translate(replace({x}, '&amp;', '&'), {_q(''.join(map(chr, tx.PLAIN)) + chr(13))}, {_q(''.join(tx.PLAIN.values()) + chr(10))})"
    for pattern, to in (("[ \\t]+", "' '"), ("\\n[ \\t]*", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def _tagless_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?is)<(script|style).*?>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g')"


def _section_sql(x: str, item: str, title: str, ends: tuple[str, ...]) -> str:
    """Headers are marked in the text: 1 behind those that begin the section, 2 before those that end it."""
    title = title.replace("'", "''")
    begun = f"regexp_replace({x}, '(?i)((?:^|\\n)\\s*item\\s*{item}\\s*[.:)\\-]?\\s*{title})', '\\1' || chr(1), 'g')"
    both = f"regexp_replace({begun}, '(?i)(\\n\\s*item\\s*(?:{'|'.join(ends)}))', chr(2) || '\\1', 'g')"
    found = f"list_transform(regexp_extract_all({both}, chr(1) || '([^' || chr(2) || ']*)', 1), lambda x: replace(x, chr(1), ''))"
    return f"(select case when length(w) >= 200 then w end from (select regexp_replace(l[list_position(list_transform(l, lambda x: length(x)), list_max(list_transform(l, lambda x: length(x))))], '^\\s+|\\s+$', '', 'g') w from (select {found} l)))"


_FORM = "case when replace(lower(source), '-', '') like '%10q%' then '10-Q' else '10-K' end"
_BOTH = ", ".join(f"case when form = '10-Q' then {_section_sql('plain', *tx.SECTION_MAP['10-Q'][n])} else {_section_sql('plain', *tx.SECTION_MAP['10-K'][n])} end {n}" for n in ("mdna", "risk_factors"))
_FOUND = f"""
pl as (select doc_id, cik, cast(published as date) published, {_FORM} form, {_tidy_sql(_tagless_sql('text'))} plain from documents),
se as (select doc_id, cik, published, {_BOTH} from pl)"""


def _feature_sql() -> str:
    prior = lambda c: f"last_value(case when length(trim({c}, ' ')) > 0 then {c} end ignore nulls) over (partition by cik order by published, doc_id rows between unbounded preceding and 1 preceding) prior_{c}"
    here = lambda c, x: f"case when length(trim({c}, ' ')) > 0 then {x} end"

    def change(c: str) -> str:
        a, b = _W.format(c=c), _W.format(c=f"prior_{c}")
        return f"case when length(trim({c}, ' ')) > 0 and prior_{c} is not null then 1.0 - len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1) end"

    tone = here("mdna", "tanh((length(mdna) % 7 - 3) / 3.0)")
    cols = [tone, tone, _density(COUNTED["mdna_uncertainty"], "mdna"), here("mdna", "least(1.0, length(mdna) / 5000.0)"), _density(COUNTED["mdna_liquidity_stress"], "mdna"), change("mdna"), _density(COUNTED["rf_severity"], "risk_factors"), f"1.0 - {_density(COUNTED['rf_specificity'], 'risk_factors')}", _density(COUNTED["rf_litigation"], "risk_factors"), change("risk_factors")]
    return f"with {_FOUND}, tu as (select *, {prior('mdna')}, {prior('risk_factors')} from se where cik is not null and published is not null) select doc_id, {', '.join(f'{x} {k}' for x, k in zip(cols, tx.FEATURES, strict=True))} from tu"


def _enforced_sql() -> str:
    out = []
    for i, (k, (low, high)) in enumerate(tx.FEATURES.items()):
        name = "mdna" if k.startswith("mdna") else "risk_factors"
        there = f"length(trim({name}, ' ')) > 0" + (" and doc_id % 2 = 0" if k == "mdna_change" else "")
        out.append(f"case when {there} then greatest({low}, least({high}, {0.1 * i} + doc_id % 5 - 2.0)) end {k}")
    return f"with {_FOUND} select doc_id, {', '.join(out)} from se"


_NOISE = ", ".join(_q(w) for w in tx.NAME_NOISE)
_NAMED = f"""
nm as (select {_CIK} c, min(name) name, min(ticker) ticker from bridge group by 1),
na as (select d.doc_id, d.text, nm.name, nm.ticker, nm.c plain, nullif(regexp_extract(text, '([A-Z][a-z]{{4,}}) \\d{{4}}', 1), '') alias,
  nullif(regexp_extract(text, '\\b([3-9]\\d{{3}})\\b', 1), '') number, nullif(regexp_extract(text, '\\b([A-Z]{{3,4}})\\b', 1), '') code
  from (select *, {_CIK} c from documents) d left join nm on nm.c = d.c and nm.c <> '')"""


def _mask_sql(alias: str, ticker: str, number: str) -> str:
    """CTE mk (doc_id, masked) over _NAMED."""
    words = f"list_concat(list_filter(regexp_extract_all(coalesce(name, ''), '[A-Za-z][A-Za-z\\-'']+'), lambda w: length(w) > 2 and lower(w) not in ({_NOISE})), {alias})"
    ordered = f"list_transform(list_sort(list_transform(list_distinct({words}), lambda w: {{'n': -length(w), 'w': w}})), lambda s: s.w)"
    return f"""
mw as (select *, {ordered} words, {ticker} tk, {number} no from na),
m1 as (select *, case when len(words) > 0 then regexp_replace(text, '(?i)\\b(?:' || array_to_string(words, '|') || ')\\b', '[COMPANY]', 'g') else text end t1 from mw where length(trim(text, ' ')) > 0),
m2 as (select *, case when length(trim(tk)) > 0 then regexp_replace(t1, '\\b' || trim(tk) || '\\b', '[TICKER]', 'g') else t1 end t2 from m1),
m3 as (select *, case when length(no) > 0 then regexp_replace(t2, '\\b0*' || no || '\\b', '[CIK]', 'g') else t2 end t3 from m2),
mk as (select na.doc_id, regexp_replace(regexp_replace(regexp_replace(t3, '(?i){tx.MONTH_DATE}', '[DATE]', 'g'), '{tx.NUMERIC_DATE}', '[DATE]', 'g'), '{tx.YEAR}', '[YEAR]', 'g') masked from na left join m3 using (doc_id))"""


_SX = "sx as (select distinct scenario_id, cast(date as date) as day, permaticker, case when not isnan(composite) then composite end x, case when not isnan(fwd_ret_21) then fwd_ret_21 end y from panel)"


def _rho(src: str, by: str, least: int) -> str:
    return f"""
r0 as (select {by}, x, y from {src} where x is not null and y is not null),
r1 as (select {by}, rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0 a,
  rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0 b from r0),
r2 as (select {by}, count(*) n, case when count(*) >= {least} and min(a) < max(a) and min(b) < max(b) then covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) end rho from r1 group by all)"""


_DY = "dy as (select ticker, cast(date as date) as day, max(closeadj) price from sep_prices group by all)"
_BD = "(select count(*) from range(0, datediff('day', p, day)) t(k) where isodow(p + cast(k as int)) <= 5)"
_GAP = f"gp as (select ticker, day, lag(day) over (partition by ticker order by day) p, price, lag(price) over (partition by ticker order by day) q from dy), gg as (select ticker, day, price, q, case when p is not null then {_BD} end gap from gp)"
_RUN = "ru as (select *, sum(case when price is not null and price is not distinct from lp then 0 else 1 end) over (partition by ticker order by day) i from (select *, lag(price) over (partition by ticker order by day) lp from dy)), rl as (select ticker, max(c) longest from (select ticker, i, count(*) c from ru group by all) group by 1)"

_GOOD, _BAD = (", ".join(f"'{w}'" for w in ws) for ws in (GOOD, BAD))
_TONE = f"""
tw as (select doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: upper(trim(w, '.,;:()[]"'''))) w from documents),
tp as (select doc_id, text, len(list_filter(w, lambda x: x in ({_GOOD}))) p, len(list_filter(w, lambda x: x in ({_BAD}))) n from tw)"""



def bar_check_sql(days: str, longs: str) -> str:
    """The bar check over a CTE ``dy`` (ticker, day, price) that ``days`` defines."""
    return sql_out(
        f"with {days}, {_GAP}, {_RUN}, c as (select ticker, count(*) bars, sum((price is null or price <= 0)::int) bad_prices, sum(coalesce(gap > 5, false)::int) gaps, sum(coalesce(abs(price / nullif(q, 0) - 1) > 0.4, false)::int) big_moves from gg group by 1) select c.*, longest longest_stale, bad_prices > 0 hard_fail, gaps > 0 or big_moves > 0 or longest > 4 soft_fail from c join rl using (ticker)",
        "",
        longs,
    )


_F = "distinct filing_id, upper(trim(form)) f from filings"
SQL = {
    "filing_qualify": f"select filing_id, regexp_replace(f, '/A$', '') base, coalesce(f like '%/A', false) amended, coalesce(f in {_QUAL}, false) qualifies from (select {_F})",
    "filing_dedupe": f"select accession, form, try_cast(substr(acceptance_datetime, 1, 10) as date) acceptance_date from (select * from filings where accession is not null qualify row_number() over (partition by accession order by filing_id) = 1) where upper(trim(form)) in {_QUAL}",
    "amendment_count": sql_out(f"select sum((f like '%/A' and regexp_replace(f, '/A$', '') in {_QUAL})::int) amendments, count(*) n from (select upper(trim(form)) f from (select distinct * from filings))", "", "amendments"),
    "cik_canon": f"select distinct permaticker, cik spelled, case when cik is null then '' else {_CIK} end plain from bridge",
    "acceptance_days": "select distinct filing_id, try_cast(substr(acceptance_datetime, 1, 10) as date) as day from filings",
    "cik_window_attribution": f"with {_ATT} select filing_id, owner from at1",
    "attribution_stats": sql_out(f"with {_ATT}, e as (select accession, max(fi.c in (select c from bk)) h, max(accession in (select accession from at1)) a from fi group by 1) select count(*) total, sum((not h)::int) no_cik, sum(a::int) attributed, sum((h and not a)::int) gap from e", "", "no_cik attributed gap"),
    "truncate_sections": "with t as (select doc_id, length(text) > 16000 c, case when length(text) > 16000 then substr(text, 1, 12000) || chr(10) || chr(10) || '...[SECTION TRUNCATED - MIDDLE OMITTED]...' || chr(10) || chr(10) || right(text, 4000) else text end x from documents) select doc_id, coalesce(c, false) truncated, length(x) kept, md5(x) digest from t",
    "prior_section_text": f"with {_TURN} select doc_id, md5(p) prior from tu",
    "jaccard_change": sql_out(f"with {_TURN}, w as (select doc_id, {_W.format(c='text')} a, {_W.format(c='p')} b, length(trim(text, ' ')) > 0 and p is not null ok from tu) select doc_id, case when ok then 1.0 - len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) end change from w", "change"),
    "stub_density": sql_out(f"select doc_id, {_density('risk')} risk, {_density('may')} may, case when length(trim(text, ' ')) > 0 then tanh((length(text) % 7 - 3) / 3.0) end tone from documents", "risk may tone"),
    "lexicon_tone": sql_out(f"with {_TONE} select doc_id, case when length(text) > 0 then coalesce((p - n) / nullif(p + n, 0), 0) end tone from tp", "tone"),
    "feature_clamp": sql_out("select distinct scenario_id, cast(date as date) date, permaticker, case when composite is not null and not isnan(composite) then greatest(-0.5, least(0.5, composite)) end clamped from panel", "clamped", "permaticker"),
    "feature_normalize": sql_out("with s as (select distinct scenario_id, cast(date as date) date, permaticker, case when not isnan(fwd_ret_21) then fwd_ret_21 end x, coalesce(ranked, false) ranked from panel), a as (select *, case when ranked then x end v from s), b as (select *, avg(v) over g m, stddev_pop(v) over g sd from a window g as (partition by scenario_id, date)), c as (select *, case when v is not null then greatest(m - 3 * sd, least(m + 3 * sd, v)) end w from b), e as (select *, avg(w) over g m2, stddev_pop(w) over g s2 from c window g as (partition by scenario_id, date)) select scenario_id, date, permaticker, case when w is not null then case when s2 <= 1e-14 * greatest(abs(m2), 1) then 0.0 else (w - m2) / nullif(s2, 0) end end z_x from e", "z_x", "permaticker"),
    "coverage_funnel": sql_out("with f as (select distinct feat_id, cast(t as date) t, permaticker from feat_t), g as (select permaticker, cast(acceptance_date as date) a, max(filing_id) filing_id from filings where not is_amendment and permaticker is not null and acceptance_date is not null group by all), j as (select f.t, g.a from f asof left join g on f.permaticker = g.permaticker and f.t > g.a) select count(*) n, sum((t - a <= 548)::int) ok, sum((t - a > 548)::int) stale, sum((a is null)::int) no_filing, sum((t - a <= 548)::int) any_feature from j", "", "ok stale no_filing any_feature"),
    "missing_report": sql_out("with s as (select distinct * from feat_t), u as (select 'close_t' feature, close_t v from s union all select 'vol_252', vol_252 from s union all select 'dollarvol_60', dollarvol_60 from s) select feature, sum((v is null)::int) missing, count(*) n, avg(v) mean from u group by 1", "mean", "missing"),
    "masked_probe": sql_out(f"with {_SX},{_rho('sx', 'scenario_id', 20)} select scenario_id, rho, n from r2", "rho"),
    "identity_sensitivity": sql_out(f"with {_SX}, sh as (select *, x * (scenario_id % 3) * 0.05 s from sx) select scenario_id, avg(abs(s)) mean_shift, stddev_pop(y) sd, coalesce(avg(abs(s)) > 0.5 * stddev_pop(y), false) sensitive from sh group by 1", "mean_shift sd"),
    "within_date_ic": sql_out(f"with {_SX},{_rho('sx', 'scenario_id, day', 5)}, i as (select scenario_id, avg(rho) mean_ic, count(rho) dates from r2 group by 1), k as (select distinct scenario_id from sx) select scenario_id, mean_ic, coalesce(dates, 0) dates, coalesce(abs(mean_ic) > 0.08, false) quarantined from k left join i using (scenario_id)", "mean_ic"),
    "lexicon_agreement": sql_out(f"with {_SX}, sy as (select * replace (case when scenario_id % 2 = 0 then x + y * 3.0 else y end as y) from sx),{_rho('sy', 'scenario_id', 20)} select scenario_id, rho, n, coalesce(rho >= 0.4, false) agrees from r2", "rho"),
    "extractor_agreement": sql_out(f"with f as (select distinct feat_id, close_t, vol_252 from feat_t), lg as (select 'close_t' feature, close_t x, close_t * 0.9 + 1.0 y from f union all select 'vol_252', vol_252, -vol_252 from f), {_rho('lg', 'feature', 3)}, o as (select feature, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) pearson, avg(x) mean_a, avg(y) mean_b, avg(abs(x - y)) mean_abs_diff from lg where x is not null and y is not null group by 1) select feature, rho spearman, n, pearson, mean_a, mean_b, mean_abs_diff from r2 join o using (feature)", "spearman pearson mean_a mean_b mean_abs_diff"),
    "extractor_verdict": sql_out(
        f"""with f as (select distinct feat_id, close_t, vol_252, hist_days from feat_t), lg as (
  select 'little' differ, 'close_t' feature, close_t x, close_t * 2 y from f union all select 'little', 'vol_252', vol_252, vol_252 + 1 from f union all select 'little', 'hist_days', hist_days, hist_days from f
  union all select 'part', 'close_t', close_t, close_t from f union all select 'part', 'vol_252', vol_252, -vol_252 from f union all select 'part', 'hist_days', hist_days, hist_days from f
  union all select 'much', 'close_t', close_t, -close_t from f union all select 'much', 'vol_252', vol_252, -vol_252 from f union all select 'much', 'hist_days', hist_days, feat_id % 7 from f),{_rho('lg', 'differ, feature', 3)},
v as (select differ, count(rho) features, median(rho) median_spearman, sum((rho >= 0.7)::int) good, sum((rho < 0.5)::int) weak from r2 group by 1)
select *, case when median_spearman >= 0.7 and weak = 0 then 'tracks' when weak >= 3 or median_spearman < 0.5 then 'diverges' else 'mixed' end verdict from v""",
        "median_spearman",
        "good weak",
    ),
    "manifest_rows": "with f as (select distinct * from filings where cik is not null and filing_id is not null), r as (select *, row_number() over (partition by cik order by filing_id, form nulls first, accession nulls first, acceptance_datetime nulls first) i, count(*) over (partition by cik) n from f) select cik, i ordinal, form, accession, case when i < n then acceptance_datetime end acceptance_datetime from r",
    "fetch_plan": f"""with f as (select distinct filing_id, coalesce({_CIK}, '') c, accession, case filing_id % 4 when 0 then 'a.HTM' when 1 then 'b.html' when 2 then 'c.txt' end p from (select distinct * from filings where accession is not null)), g as (select *, coalesce(lower(p) like '%.htm' or lower(p) like '%.html', false) h, '{filings.ARCHIVE}' || c || '/' b from f)
select filing_id, h is_html, case when h then b || replace(accession, '-', '') || '/' || p || ' ' else '' end || b || accession || '.txt' urls from g""",
    "cik_of_url": "with u as (select distinct permaticker, 'https://x.example/browse?action=get&CIK=000' || trim(cik) || '&type=10-K' url from bridge) select permaticker, url, nullif(regexp_extract(url, '(?i)cik=0*(\\d+)', 1), '') cik from u",
    "integrity_summary": sql_out("select count(*) n, sum((closeadj is null)::int) null_closeadj, sum((volume is null)::int) null_volume, sum((ret is null)::int) null_ret, cast(min(date) as date) first_day, cast(max(date) as date) last_day, count(distinct ticker) entities from sep_prices", "", "null_closeadj null_volume null_ret"),
    "key_multiplicity": sql_out("select count(*) keys, sum((k > 1)::int) multiple, max(k) most from (select ticker, count(distinct permaticker) k from tickers where ticker is not null group by 1)", "", "multiple"),
    "present_coverage": sql_out("with p as (select coalesce(lower(trim(cik)) not in ('', 'nan', 'none', 'null', '<na>', 'nat'), false)::int h, isdelisted from bridge) select avg(h) overall, avg(h) filter (where isdelisted = 'Y') in_subset from p", "overall in_subset"),
    "repeated_bars": "select ticker, cast(date as date) date, count(*) n from sep_prices group by all having count(*) > 1",
    "stale_runs": f"with {_DY}, {_RUN} select ticker, longest from rl",
    "gap_check": f"with {_DY}, {_GAP} select ticker, day, gap, row_number() over (partition by ticker order by gap desc, day) place from gg where gap is not null qualify place <= 3",
    "bar_integrity": bar_check_sql(_DY, "bad_prices gaps big_moves"),
    "html_to_text": f"select doc_id, {_tidy_sql(_tagless_sql('text'))} plain from documents",
    "section_extract": f"with {_FOUND} select doc_id, mdna, risk_factors from se",
    "stub_features": sql_out(_feature_sql(), " ".join(tx.FEATURES)),
    "absent_enforced": sql_out(_enforced_sql(), " ".join(tx.FEATURES)),
    "submission_sections": f"""with sg as (select doc_id, {_FORM} form, case when doc_id % 3 <> 0 and doc_id % 7 = 0 then text || ' and more' else text end body from documents),
pl as (select doc_id, form, {_tidy_sql("regexp_replace(chr(10) || body || chr(10), '(?s)<[^>]+>', chr(10), 'g')")} plain from sg)
select doc_id, md5(plain) digest, md5(mdna) mdna, md5(risk_factors) risk_factors from (select *, {_BOTH} from pl)""",
    "mask_identity": f"with {_NAMED}, {_mask_sql('case when alias is null then [] else [alias] end', 'coalesce(code, ticker)', 'coalesce(number, plain)')} select doc_id, masked from mk",
    "prepared_sections": f"""with {_NAMED}, {_mask_sql('[]::varchar[]', 'ticker', 'plain')}, c as (select doc_id, case when length(masked) > 16000 then substr(masked, 1, 12000) || chr(10) || chr(10) || '...[SECTION TRUNCATED - MIDDLE OMITTED]...' || chr(10) || chr(10) || right(masked, 4000) else masked end x, coalesce(length(masked) > 16000, false) cut from mk)
select doc_id, md5(x) digest, length(x) chars, cut from c""",
}
