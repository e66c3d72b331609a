"""One golden record for each cluster: survivorship by completeness, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions import text as T

#: Fields that make a row complete, and fields that survive each by itself.
RANKED = ("company_name", "website", "phone", "email", "owner_name", "owner_title", "city", "state", "industry", "revenue", "employees", "year_founded")
SURVIVING = ("website", "domain", "owner_name", "owner_title", "address", "city", "state", "industry", "revenue", "employees", "year_founded", "linkedin", "rating", "review_count")


def completeness(columns: list[str]) -> Column:
    """How many of the ranked fields a row fills."""
    total = F.lit(0)
    for c in RANKED:
        if c in columns:
            total = total + F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("int")
    return total


def golden_records(leads: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each cluster. Fields missing from `leads` are left out.

    All is told by partial aggregates, so that each task that holds rows of a cluster sends one row of it at most.

    Each field comes from the most complete row that fills it, ties by row. A name that isn't all capitals, a valid
    phone that isn't toll-free, and a personal address are preferred.
    """
    rows = leads.join(clusters, "row").withColumn("rank", F.struct((-completeness(leads.columns)).alias("missing"), F.col("row").alias("at")))
    name, phone = F.col("company_name"), F.col("phone_parsed")
    shouting = (name == F.upper(name)) & (name != F.lower(name))
    kind = F.when(phone["valid"] & ~F.coalesce(phone["type"] == "TOLL_FREE", F.lit(False)), 0).when(phone["valid"], 1).otherwise(2)
    first = lambda value, rank="rank": F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), rank if isinstance(rank, Column) else F.col(rank)))
    best_phone = first(phone, F.struct(kind.alias("kind"), F.col("rank")))
    email = F.col("email")
    aggregates = [
        F.min("row").alias("row"),
        F.coalesce(F.min_by(name, F.when(name.isNotNull() & ~shouting, F.col("rank"))), first(name)).alias("company_name"),
        F.min_by("norm_name", "rank").alias("norm_name"),
        F.min_by("source", "rank").alias("source"),
        best_phone.alias("phone_parsed"),
        first(email, F.struct(T.is_role_email(email).alias("role"), F.col("rank"))).alias("email"),
        *[first(F.col(c)).alias(c) for c in SURVIVING if c in leads.columns],
        F.count("*").alias("merged_count"),
    ]
    out = rows.groupBy("cluster").agg(*aggregates)
    # sources are few, so a cluster's fit in a row
    seen = rows.groupBy(F.col("cluster").alias("of"), "source").agg(F.min("row").alias("first")).groupBy("of").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("seen"))
    out = out.join(seen.hint("merge"), F.col("cluster") == F.col("of")).withColumn("sources", F.transform("seen", lambda x: x["source"]))
    return out.select("*", F.col("phone_parsed.e164").alias("phone")).drop("of", "seen")


def provenance(leads: DataFrame, clusters: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """A row for each row of a cluster: cluster, merged_count, row, source, source_id, company_name, email, phone, website, matched_on.

    It has no arrays but the reasons, so that a cluster of any size is spread over many tasks.
    """
    sizes = clusters.groupBy(F.col("cluster").alias("of")).agg(F.count("*").alias("merged_count"))
    rows = leads.join(clusters, "row").join(sizes.hint("merge"), F.col("cluster") == F.col("of"))
    if reasons is not None:
        rows = rows.join(reasons.hint("merge"), "row", "left")
    matched = F.coalesce("matched_on" if reasons is not None else F.lit(None), F.array().cast("array<string>"))
    return rows.select("cluster", "merged_count", "row", "source", "source_id", "company_name", "email", F.col("phone_parsed.e164").alias("phone"), "website", matched.alias("matched_on"))


#: Rows of a cluster up to which they are listed within its golden record.
LISTED = 1000


def attach_provenance(golden: DataFrame, rows: DataFrame, most: int = LISTED) -> DataFrame:
    """Adds source_ids and merged_from (empty for one row), by row, to golden records of at most `most` rows.

    rows: provenance(). Larger clusters have null in both; their rows are those of `rows`.
    """
    told = F.struct("row", "company_name", "email", "phone", "website", "source", "source_id", "matched_on")
    lists = rows.filter(F.col("merged_count") <= most).groupBy(F.col("cluster").alias("of")).agg(F.sort_array(F.collect_list(told)).alias("all"))
    out = golden.join(lists.hint("merge"), F.col("cluster") == F.col("of"), "left")
    ids = F.transform(F.filter("all", lambda x: x["source_id"].isNotNull()), lambda x: F.concat(x["source"], F.lit(":"), x["source_id"]))
    merged = F.transform(F.when(F.col("merged_count") > 1, F.col("all")).otherwise(F.slice("all", 1, 0)), lambda x: x.dropFields("source_id"))
    return out.withColumns({"source_ids": ids, "merged_from": merged}).drop("of", "all")


def dedup_summary(clusters: DataFrame) -> DataFrame:
    """input_rows, unique_rows, merged_rows, clusters_with_duplicates."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count("*").alias("unique_rows"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("merged_rows"), F.count_if(F.col("n") > 1).alias("clusters_with_duplicates")
    )
