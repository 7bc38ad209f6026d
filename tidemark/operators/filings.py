"""Filing tables: manifests to rows, qualifying forms, attribution to identities, sections and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import acceptance_date, canon_cik, known, parse_day
from ..functions.text import COUNTED, FEATURES, base_form, blank_to_null, clamp, lower_words, stub_scores

# Forms that carry the wanted sections.
QUALIFYING_FORMS = ("10-K", "10-K405", "10-KSB", "10-KSB405", "10-KT", "10-Q", "10-QT")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def is_amendment(form: Column) -> Column:
    return known(F.upper(F.trim(form)).endswith("/A"))


def qualifies(form: Column) -> Column:
    return known(base_form(form).isin(*QUALIFYING_FORMS)) & ~is_amendment(form)


def flatten_manifest(manifests: DataFrame, cik: str, arrays: dict[str, str]) -> DataFrame:
    """Parallel arrays to rows. ``arrays`` maps an array column to its column name in the result.

    The first array sets the number of rows; shorter ones are padded with NULL, longer ones cut.
    """
    first, *_ = arrays
    n = F.size(first)
    item = lambda c: F.try_element_at(c, F.col("__i"))
    rows = manifests.where(n > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), n)))
    return rows.select(cik, "__i", *[item(F.col(c)).alias(name) for c, name in arrays.items()]).withColumnRenamed("__i", "ordinal")


def assemble(blocks: list[DataFrame]) -> DataFrame:
    """Union of manifest blocks, the earliest block's row per accession kept, qualifying forms only.

    Adds is_amendment-free ``acceptance_date`` and keeps order of blocks as preference. Rows without accession are left out.
    """
    both = None
    for k, b in enumerate(blocks):
        b = b.withColumn("__block", F.lit(k))
        both = b if both is None else both.unionByName(b, allowMissingColumns=True)
    first = Window.partitionBy("accession").orderBy("__block", "ordinal")
    kept = both.where("accession is not null").withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return kept.where(qualifies(F.col("form"))).withColumn("acceptance_date", acceptance_date("acceptance_datetime")).drop("__r", "__block", "ordinal")


def fetch_plan(filings: DataFrame) -> DataFrame:
    """+ urls: where to look for the document, the primary one first if it is HTML, then the whole submission."""
    flat = F.regexp_replace("accession", "-", "")
    folder = F.concat(F.lit(ARCHIVE), F.col("cik"), F.lit("/"), flat, F.lit("/"))
    is_html = known(F.lower("primary_document").rlike(r"\.html?$"))
    whole = F.concat(F.lit(ARCHIVE), F.col("cik"), F.lit("/"), F.col("accession"), F.lit(".txt"))
    urls = F.when(is_html, F.array(F.concat(folder, F.col("primary_document")), whole)).otherwise(F.array(whole))
    return filings.withColumns({"is_html": is_html, "urls": urls})


def prepared_bridge(bridge: DataFrame) -> DataFrame:
    """Readable windows of identities by plain CIK: permaticker, cik, first, last. Repeated rows count once."""
    return (
        bridge.select("permaticker", canon_cik("cik").alias("cik"), parse_day("firstpricedate").alias("first"), parse_day("lastpricedate").alias("last"))
        .where("cik <> '' and first is not null and last is not null and permaticker is not null")
        .distinct()
    )


class AmbiguousFiling(ValueError):
    """A filing falls into the windows of several identities."""


def attribute_filings(filings: DataFrame, bridge: DataFrame, day: str = "acceptance_date", policy: str = "raise") -> DataFrame:
    """Filings with the identity whose window on their CIK holds their day (inner).

    ``filings`` has accession, cik (any spelling) and the day. ``policy``: 'raise' fails at once when a
    filing has several identities; 'drop' leaves such filings out; 'all' keeps every identity.
    """
    f = filings.withColumn("__cik", canon_cik("cik"))
    b = bridge.select(F.col("permaticker").alias("owner"), F.col("cik").alias("__c"), "first", "last")
    hit = f.join(b, (F.col("__cik") == F.col("__c")) & F.col(day).between(F.col("first"), F.col("last"))).drop("__c", "first", "last", "__cik")
    if policy == "all":
        return hit.distinct()
    many = hit.groupBy("accession").agg(F.min("owner").alias("a"), F.max("owner").alias("z")).where("a <> z").select("accession")
    if policy == "raise":
        bad = many.limit(3).collect()
        if bad:
            raise AmbiguousFiling(", ".join(r[0] for r in bad))
        return hit.distinct()
    return hit.join(many, "accession", "left_anti").distinct()


def attribution_stats(filings: DataFrame, bridge: DataFrame, attributed: DataFrame) -> DataFrame:
    """One row of distinct accession counts: total, without a known CIK, attributed, known CIK but outside every window."""
    ciks = bridge.select(F.col("cik").alias("__cik")).distinct().withColumn("has", F.lit(1))
    done = attributed.select("accession").distinct().withColumn("done", F.lit(1))
    f = filings.withColumn("__cik", canon_cik("cik")).join(ciks, "__cik", "left").join(done, "accession", "left")
    each = f.groupBy("accession").agg(F.max("has").alias("has"), F.max("done").alias("done"))
    c = lambda cond: F.sum(cond.cast("int")).cast("long")
    return each.agg(
        F.count(F.lit(1)).alias("total"),
        c(F.col("has").isNull()).alias("no_cik"),
        c(F.col("done").isNotNull()).alias("attributed"),
        c(F.col("has").isNotNull() & F.col("done").isNull()).alias("gap"),
    )


def pivot_sections(sections: DataFrame, keys: list[str], names: tuple[str, ...] = ("mdna", "risk_factors")) -> DataFrame:
    """One row per filing with a column per section; a filing without any text does not appear."""
    pick = [F.min(F.when(F.col("section") == n, F.col("text"))).alias(n) for n in names]
    some = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    return sections.groupBy(*keys).agg(*pick).where(some)


def with_prior(df: DataFrame, entity: str, order: list[str], columns: list[str], row_id: str) -> DataFrame:
    """+ prior_<column>: the entity's last non-blank text strictly before this row.

    Only ids pass through the window, so an entity with a large part of all filings sorts ids and not texts; the texts are
    then fetched by their ids, which are unique. Rows with a NULL ``row_id`` are left out.
    """
    line = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(row_id).isNotNull())
    flags = {c: blank_to_null(c).isNotNull().alias(f"__has_{c}") for c in columns}
    ids = rows.select(row_id, entity, *order, *flags.values()) if row_id not in order else rows.select(entity, *order, *flags.values())
    ids = ids.select(row_id, *[F.last(F.when(F.col(f"__has_{c}"), F.col(row_id)), ignorenulls=True).over(line).alias(f"__prior_{c}") for c in columns])
    out = rows
    for c in columns:
        # rows without a prior text take no part in the fetch, so their NULLs do not meet in one task
        known = ids.where(F.col(f"__prior_{c}").isNotNull()).select(row_id, f"__prior_{c}")
        texts = rows.select(F.col(row_id).alias(f"__prior_{c}"), F.col(c).alias(f"prior_{c}"))
        out = out.join(known.join(texts, f"__prior_{c}").select(row_id, f"prior_{c}"), row_id, "left")
    return out


def stub_features(df: DataFrame, counted: dict[str, str] = COUNTED) -> DataFrame:
    """+ the ten measures of a filing's texts (mdna, risk_factors and their priors), absent sections enforced.

    ``counted`` names the beginnings of words that the measures of density count. Texts are parted into words once, in a
    step of their own, and each measure is made once before it is brought into range.
    """
    texts = ("mdna", "risk_factors", "prior_mdna", "prior_risk_factors")
    parted = df.withColumns({f"__w_{t}": lower_words(t) for t in texts})
    raw = parted.withColumns({f"__{k}": v for k, v in stub_scores("mdna", *[F.col(f"__w_{t}") for t in texts], counted).items()})
    return raw.withColumns({k: clamp(F.col(f"__{k}"), *FEATURES[k]) for k in FEATURES}).drop(*[f"__w_{t}" for t in texts], *[f"__{k}" for k in FEATURES])


def enforce_absent(scored: DataFrame) -> DataFrame:
    """Scores from elsewhere: brought into range, and NULL where the text they describe is absent."""
    needs = lambda k: blank_to_null("mdna" if k.startswith("mdna") else "risk_factors").isNotNull()
    prior = lambda k: blank_to_null("prior_mdna" if k.startswith("mdna") else "prior_risk_factors").isNotNull() if k.endswith("_change") else F.lit(True)
    return scored.withColumns({k: F.when(needs(k) & prior(k), clamp(F.col(k), *FEATURES[k])) for k in FEATURES})


def cached_features(texts: DataFrame, cache: DataFrame, score) -> DataFrame:
    """Score only what the cache lacks. Both have ``key``; ``score`` maps a DataFrame to key + features."""
    missing = texts.join(cache.select("key"), "key", "left_anti")
    return texts.join(cache, "key").select("key", *FEATURES).unionByName(score(missing).select("key", *FEATURES))


def coverage_funnel(joined: DataFrame, features: list[str]) -> DataFrame:
    """One row over an as-of join: rows, ok, stale, no_filing, any_feature."""
    c = lambda cond: F.sum(known(cond).cast("int")).cast("long")
    some = F.lit(False)
    for f in features:
        some = some | F.col(f).isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("n"), *[c(F.col("status") == s).alias(s) for s in ("ok", "stale", "no_filing")], c(some).alias("any_feature"))


def missing_report(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, missing, n, mean - long form, one pass."""
    cols = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]
    return (
        df.select(F.explode(F.array(*cols)).alias("c"))
        .groupBy(F.col("c.feature").alias("feature"))
        .agg(F.sum(F.col("c.v").isNull().cast("int")).cast("long").alias("missing"), F.count(F.lit(1)).alias("n"), F.avg("c.v").alias("mean"))
    )
