"""Phone numbers of any country by the longest prefix of a numbering plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.storage import small_or_merge

# Public numbering plans. Leading digits after the plus, country, kind, fewest and most digits in all.
PLAN = (
    ("1", "US", "FIXED_LINE_OR_MOBILE", 11, 11), ("1800", "US", "TOLL_FREE", 11, 11), ("1833", "US", "TOLL_FREE", 11, 11), ("1844", "US", "TOLL_FREE", 11, 11), ("1855", "US", "TOLL_FREE", 11, 11),
    ("1866", "US", "TOLL_FREE", 11, 11), ("1877", "US", "TOLL_FREE", 11, 11), ("1888", "US", "TOLL_FREE", 11, 11), ("1900", "US", "PREMIUM_RATE", 11, 11),
    ("33", "FR", "FIXED_LINE", 11, 11), ("336", "FR", "MOBILE", 11, 11), ("337", "FR", "MOBILE", 11, 11), ("3380", "FR", "TOLL_FREE", 11, 11), ("3389", "FR", "PREMIUM_RATE", 11, 11), ("339", "FR", "VOIP", 11, 11),
    ("34", "ES", "FIXED_LINE", 11, 11), ("346", "ES", "MOBILE", 11, 11), ("347", "ES", "MOBILE", 11, 11), ("34800", "ES", "TOLL_FREE", 11, 11), ("34900", "ES", "TOLL_FREE", 11, 11),
    ("353", "IE", "FIXED_LINE", 10, 12), ("3538", "IE", "MOBILE", 12, 12), ("3531800", "IE", "TOLL_FREE", 13, 13),
    ("44", "GB", "FIXED_LINE", 11, 12), ("447", "GB", "MOBILE", 12, 12), ("44800", "GB", "TOLL_FREE", 11, 12), ("44808", "GB", "TOLL_FREE", 12, 12), ("449", "GB", "PREMIUM_RATE", 12, 12),
    ("49", "DE", "FIXED_LINE", 7, 13), ("4915", "DE", "MOBILE", 12, 13), ("4916", "DE", "MOBILE", 12, 13), ("4917", "DE", "MOBILE", 12, 13), ("49800", "DE", "TOLL_FREE", 12, 15), ("49900", "DE", "PREMIUM_RATE", 12, 12),
    ("61", "AU", "FIXED_LINE", 11, 11), ("614", "AU", "MOBILE", 11, 11), ("611800", "AU", "TOLL_FREE", 12, 12),
)
#: Most rows of a plan that are broadcast.
BROADCAST_PLAN = 100_000


def phone_plan(spark: SparkSession) -> DataFrame:
    """prefix, country, type, least, most: the plans of some countries; any table of these columns will do."""
    return spark.createDataFrame(PLAN, "prefix string, country string, type string, least int, most int")


def classify_phones(df: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """Adds phone_plan: e164, country, type (null if not valid), valid of international numbers (+ or 00 first).

    The longest prefix of the plan that a number begins with tells its country, kind and lengths. A number is looked up
    once for each length of prefix, the plan is broadcast, and rows stay where they are. What is null or isn't
    written internationally has null. A trunk zero in brackets is left out.
    """
    lengths = [r[0] for r in plan.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # some few
    text = F.regexp_replace(T.strip(F.col(column)), r"\(0\)", "")
    digits = F.when(text.rlike(r"^(\+|00)[0-9 ().-]+$"), F.regexp_replace(F.regexp_replace(text, r"^(\+|00)", ""), "[^0-9]", ""))
    out = df.withColumn("_digits", digits)
    for n in lengths:
        of = plan.filter(F.length("prefix") == n).groupBy(F.col("prefix").alias(f"_at_{n}")).agg(F.first(F.struct("country", "type", "least", "most")).alias(f"_plan_{n}"))
        out = out.withColumn("_start", F.substring("_digits", 1, n)).join(small_or_merge(of, BROADCAST_PLAN), F.col("_start") == F.col(f"_at_{n}"), "left").drop("_start", f"_at_{n}")
    found = F.coalesce(*[F.col(f"_plan_{n}") for n in reversed(lengths)])
    valid = F.coalesce(F.length("_digits").between(found["least"], found["most"]), F.lit(False))
    made = F.struct(F.concat(F.lit("+"), "_digits").alias("e164"), found["country"].alias("country"), F.when(valid, found["type"]).alias("type"), valid.alias("valid"))
    return out.withColumn("phone_plan", F.when(F.col("_digits").isNotNull(), made)).drop("_digits", *[f"_plan_{n}" for n in lengths])
