"""Filter, search, sort, page and summarise stored leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORT_KEYS = ("score", "company_name", "revenue", "employees", "year_founded", "city", "industry", "merged_count")


def filter_leads(df: DataFrame, *, upload_id=None, tiers=(), min_score=None, email_status=(), phone_status=(), industries=(), ids=(), reachable=False, merged=False, has_signals=False, owner_known=False, sources=(), search=None) -> DataFrame:
    """Leads that pass every given condition; a search text's % and _ are wild cards."""
    conditions = {
        "upload_id": F.col("upload_id") == upload_id if upload_id is not None else None,
        "tier": F.col("tier").isin(*tiers) if tiers else None,
        "score": F.col("score") >= min_score if min_score is not None else None,
        "email_status": F.col("email_status").isin(*email_status) if email_status else None,
        "phone_status": F.col("phone_status").isin(*phone_status) if phone_status else None,
        "industry": F.col("industry").isin(*industries) if industries else None,
        "id": F.col("id").isin(*ids) if ids else None,
        "reachable": (F.col("email_status") == "valid") | (F.col("phone_status") == "valid") if reachable else None,
        "merged": F.col("merged_count") > 1 if merged else None,
        "signals": F.size("signals") > 0 if has_signals else None,
        "owner": F.coalesce(F.col("owner_name") != "", F.lit(False)) if owner_known else None,
        "sources": F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources])) if sources else None,
    }
    for condition in conditions.values():
        if condition is not None:
            df = df.filter(condition)
    if search:
        hit = F.lit(False)
        for c in ("company_name", "owner_name", "email", "city", "domain"):
            if c in df.columns:
                hit = hit | F.coalesce(F.lower(c).like(f"%{search.lower()}%"), F.lit(False))
        df = df.filter(hit)
    return df


def sort_leads(df: DataFrame, key: str = "score", descending: bool = True) -> DataFrame:
    """By one of SORT_KEYS (score if unknown), nulls last, then score downwards and name."""
    c = F.col(key if key in SORT_KEYS else "score")
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("score").desc_nulls_last(), F.col("company_name").asc_nulls_last())


def page_leads(df: DataFrame, page: int = 1, size: int = 50) -> tuple[DataFrame, int]:
    """One page of sorted leads and the number of all; sizes are 1 to 500, 50 if 0."""
    size = min(max(size or 50, 1), 500)
    return df.offset((max(page, 1) - 1) * size).limit(size), df.count()


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("score").desc_nulls_last(), F.col("company_name").asc_nulls_last())


def summary(df: DataFrame) -> DataFrame:
    """One row of conditional counts and the average score."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = [F.count("*").alias("total"), F.floor(F.avg("score") + 0.5).cast("long").alias("avg_score")]
    out += [n(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"]
    for kind, values in (("email", ("valid", "risky", "invalid", "missing")), ("phone", ("valid", "risky", "invalid", "missing")), ("website", ("alive", "dead", "unknown", "missing"))):
        out += [n(F.col(f"{kind}_status") == v).alias(f"{kind}_{v}") for v in values]
    out += [
        n((F.col("email_status") == "valid") | (F.col("phone_status") == "valid")).alias("reachable"),
        n(F.col("owner_name") != "").alias("owner_known"),
        n(F.col("revenue").isNotNull()).alias("revenue_known"),
        n(F.col("revenue_estimated")).alias("revenue_estimated"),
        n(F.size("signals") > 0).alias("with_signals"),
    ]
    return df.agg(*out)


def industry_facets(df: DataFrame) -> DataFrame:
    return df.filter("industry IS NOT NULL").groupBy("industry").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "industry")


def status_facets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def score_histogram(df: DataFrame) -> DataFrame:
    """bucket (0 to 9), n: ten buckets of the score, 100 in the last, empty ones with 0."""
    bucket = F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int")
    counts = df.filter("score IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts.hint("merge"), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def funnel(df: DataFrame, input_rows: str = "merged_count", search: bool = False) -> DataFrame:
    """step, n, pct of the first step: rows, unique, verified email (search: owner named), tier A."""
    third = F.count_if(F.coalesce(F.col("owner_name") != "", F.lit(False))) if search else F.count_if(F.coalesce(F.col("email_status") == "valid", F.lit(False)))
    one = df.agg(F.coalesce(F.sum(input_rows), F.lit(0)).cast("long").alias("a"), F.count("*").alias("b"), third.alias("c"), F.count_if(F.coalesce(F.col("tier") == "A", F.lit(False))).alias("d"))
    name = "owner named" if search else "verified email"
    rows = one.selectExpr("a AS base", f"stack(4, 1, 'rows', a, 2, 'unique', b, 3, '{name}', c, 4, 'tier A', d) AS (step, name, n)")
    return rows.select("step", "name", "n", F.when(F.col("base") > 0, F.floor(F.col("n") * 100.0 / F.col("base") + 0.5)).otherwise(0).cast("int").alias("pct"))


def recent_uploads(uploads: DataFrame, n: int = 20) -> DataFrame:
    return uploads.orderBy(F.desc("created_at"), F.desc("upload_id")).limit(n)


def get_lead(df: DataFrame, lead_id) -> DataFrame:
    return df.filter(F.col("id") == lead_id)
