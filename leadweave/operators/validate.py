"""Email, phone and website status from rules and observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.functions import text as T
from leadweave.storage import materialise


def observation_status(observations: DataFrame) -> DataFrame:
    """status of raw observations (kind mx: mail_hosts, error; kind web: http_status, error)."""
    mx = F.when(F.col("error").isNotNull(), "unknown").when(F.col("mail_hosts") > 0, "yes").otherwise("no")
    web = F.when(F.col("error") == "dns", "dead").when(F.col("error").isNotNull() | F.col("http_status").isNull(), "dead").when(F.col("http_status") < 500, "alive").otherwise("dead")
    return observations.withColumn("status", F.when(F.col("kind") == "mx", mx).otherwise(web))


#: Seconds of a stretch of time within which a key's rows are sorted together.
STRETCH = 60


def latest_observation(keys: DataFrame, observations: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """keys (domain, kind, at) with the newest outcome observed within ttl_hours before `at`; null if none.

    Of observations of one time the largest outcome counts. Keys and observations are sorted together by time and the
    last observation is carried on, so there are no pairs of a key and each observation. A domain's rows are dealt out
    by stretches of time; into each goes the newest observation of those before it. All columns and rows of `keys`
    stay, an `outcome` of its own is replaced; null keys and times have no outcome.
    """
    by = ["domain", "kind"]
    stretch = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (STRETCH * 1_000_000)).alias("stretch")
    seen = observations.filter("domain IS NOT NULL AND kind IS NOT NULL AND observed_at IS NOT NULL")
    seen = seen.select(*by, F.col("observed_at").alias("time"), F.struct("observed_at", "outcome").alias("seen")).select("*", stretch)
    asked = keys.select(*by, F.col("at").alias("time"), F.struct(*[F.col(f"`{c}`") for c in keys.columns if c.lower() != "outcome"]).alias("asked")).select("*", stretch)
    both = materialise(asked.unionByName(seen, allowMissingColumns=True), "asked-seen")  # it is read twice
    newest = both.groupBy(*by, "stretch").agg(F.max("seen").alias("newest"))
    before = F.last("newest", True).over(W.partitionBy(*by).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    carried = newest.withColumn("seen", before).filter("seen IS NOT NULL").select(*by, "stretch", F.lit(None).cast(both.schema["time"].dataType).alias("time"), "seen")
    rows = both.unionByName(carried, allowMissingColumns=True)
    sofar = W.partitionBy(*by, "stretch").orderBy(F.asc_nulls_first("time"), F.col("asked").isNotNull(), "seen").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("last", F.last("seen", True).over(sofar)).filter("asked IS NOT NULL")
    fresh = F.col("last.observed_at") >= F.col("time") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    return rows.select("asked.*", F.when(fresh & F.col("domain").isNotNull() & F.col("kind").isNotNull(), F.col("last.outcome")).alias("outcome"))


def probe_backlog(keys: DataFrame, observations: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """The distinct (domain, kind) of keys without a fresh observation."""
    return latest_observation(keys, observations, ttl_hours).groupBy("domain", "kind").agg(F.max("outcome").alias("outcome")).filter("outcome IS NULL").drop("outcome")


def reuse_counts(keys: DataFrame, observations: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """kind, lookups, hits."""
    seen = latest_observation(keys, observations, ttl_hours)
    return seen.groupBy("kind").agg(F.countDistinct("domain").alias("lookups"), F.countDistinct(F.when(F.col("outcome").isNotNull(), F.col("domain"))).alias("hits"))


def validate_email(df: DataFrame) -> DataFrame:
    """Adds email_status, email_reason, email_suggestion from email, is_disposable and mx (yes, no, else unknown)."""
    email, domain = F.col("email"), T.domain_of(F.col("email"))
    fix = T.domain_typo_fix(domain)
    empty, ok = F.coalesce(email, F.lit("")) == "", T.email_syntax_ok(email)
    no_mail, mail = F.coalesce(F.col("mx") == "no", F.lit(False)), F.coalesce(F.col("mx") == "yes", F.lit(False))
    role, free = T.is_role_email(email), T.is_free_provider(domain)
    # Statuses and their reasons, the first that holds.
    steps = [
        (empty, "missing", F.lit("No email on record")),
        (~ok, "invalid", F.lit("Malformed address")),
        (fix.isNotNull(), "invalid", F.concat(F.lit("Typo in domain — did you mean @"), fix, F.lit("?"))),
        (F.col("is_disposable"), "invalid", F.lit("Disposable / temporary inbox")),
        (no_mail, "invalid", F.lit("Domain has no mail server (no MX records)")),
        (~mail, "risky", F.lit("Couldn't verify mail server (DNS timeout)")),
        (role, "risky", F.concat(F.lit("Shared inbox ("), T.local_part(email), F.lit("@) — may not reach the owner"))),
        (free, "valid", F.concat(F.lit("Personal inbox ("), domain, F.lit(") — common for owner-operators"))),
        (F.lit(True), "valid", F.lit("Business domain with active mail server")),
    ]
    status = reason = None
    for when, s, r in steps:
        status = F.when(when, s) if status is None else status.when(when, s)
        reason = F.when(when, r) if reason is None else reason.when(when, r)
    suggestion = F.when(~empty & ok & fix.isNotNull(), F.concat(F.substring_index(email, "@", 1), F.lit("@"), fix))
    return df.withColumns({"email_status": status, "email_reason": reason, "email_suggestion": suggestion})


def validate_phone(df: DataFrame) -> DataFrame:
    """Adds phone_status, phone_reason, phone_type from phone_parsed."""
    p = F.col("phone_parsed")
    shared = F.coalesce(p["type"].isin("TOLL_FREE", "SHARED_COST", "PREMIUM_RATE"), F.lit(False))
    status = F.when(p.isNull(), "missing").when(~p["valid"], "invalid").when(shared, "risky").otherwise("valid")
    # Names of kinds of lines, and reasons.
    kinds = {"MOBILE": "Mobile", "FIXED_LINE": "Landline", "FIXED_LINE_OR_MOBILE": "Direct line", "VOIP": "VoIP"}
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), p["type"]), F.lit("Valid number"))
    reason = F.when(p.isNull(), "No phone on record").when(~p["valid"], "Not a valid phone number").when(shared, "Toll-free line — usually a call center, not the owner").otherwise(label)
    return df.withColumns({"phone_status": status, "phone_reason": reason, "phone_type": F.when(p["valid"], p["type"])})


def validate_website(df: DataFrame) -> DataFrame:
    """Adds website_status, website_detail from domain, pages_crawled and web (an observed status, or null)."""
    n = F.coalesce("pages_crawled", F.lit(0))
    status = F.when(F.col("domain").isNull(), "missing").when(n > 0, "alive").otherwise(F.coalesce("web", F.lit("unknown")))
    detail = F.when(n > 0, F.concat(F.lit("Crawled "), n.cast("string"), F.when(n == 1, " page").otherwise(" pages"))).otherwise(F.col("web"))
    return df.withColumns({"website_status": status, "website_detail": detail})


def disposable_dimension(spark, path: str | None = None) -> DataFrame:
    """The table of disposable domains (domain): the lines of the text files at `path`, or else a seed of a few.

    Lines are trimmed and lower-cased; blank ones and those that begin with # are left out, repeated ones are one.
    """
    if path is None:
        return spark.createDataFrame([(d,) for d in rules.DISPOSABLE_SEED], "domain string")
    lines = spark.read.text(path).select(F.lower(T.strip(F.col("value"))).alias("domain"))
    return lines.filter((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()
