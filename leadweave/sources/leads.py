"""Conforming any source to the canonical lead columns, and union of sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.rules import FIELD_ALIASES
from leadweave.storage import materialise

TEXT = ("owner_name", "owner_title", "address", "city", "state", "industry", "linkedin", "source_id")


def conform(df: DataFrame, source: str, as_of_year: int, row: str = "row") -> DataFrame:
    """Canonical leads; rows without a company name are left out, missing columns are null."""
    have = set(df.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    words = ("company_name", *TEXT)
    # in steps, so that no expression is worked out again for each use
    out = df.select(
        F.col(row).cast("long").alias("row"),
        *[T.collapse(col(c)).alias(c) for c in words],
        T.host(col("website")).alias("host"),
        col("phone").alias("phone_raw"),
        F.lower(T.strip(col("email"))).alias("email"),
        T.parse_money(col("revenue")).alias("revenue"),
        T.parse_int_loose(col("employees")).alias("employees"),
        T.parse_int_loose(col("year_founded")).alias("year_founded"),
        col("rating").cast("double").alias("rating"),
        col("review_count").cast("int").alias("review_count"),
    )
    out = out.withColumns({**{c: T.not_blank(F.col(c)) for c in words}, "domain": T.is_domain(F.col("host")), "email": T.blank_to_null(F.col("email"))}).drop("host")
    out = T.with_phone(out.filter("company_name IS NOT NULL"), "phone_raw", "phone_parsed")
    return out.withColumns(
        {
            "source": F.lit(source),
            "website": T.normalize_website(F.col("domain")),
            "phone": F.coalesce("phone_parsed.e164", "phone_parsed.raw"),
            "year_founded": F.when(F.col("year_founded").between(1800, as_of_year), F.col("year_founded")),
            "norm_name": T.normalize_name(F.col("company_name")),
        }
    )


def map_columns(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """Canonical field to header, each header used once, and the headers left over."""
    plain = {h: "".join(ch for ch in h.lower() if ch.isascii() and ch.isalnum()) for h in headers}
    found: dict[str, str] = {}
    for field, aliases in FIELD_ALIASES.items():
        for alias in aliases:
            header = next((h for h in headers if plain[h] == alias and h not in found.values()), None)
            if header is not None:
                found[field] = header
                break
    return found, [h for h in headers if h not in found.values()]


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a company name, and the others as (row, reason); row is the line of the file, its header being line 1.

    Raises if there is no column of company names, and, as a file without rows is a mistake, if there are no rows.
    """
    if "company_name" not in df.columns:
        raise ValueError("no column holds company names")
    if df.isEmpty():
        raise ValueError("no rows")
    named = T.clean_text(F.col("company_name")).isNotNull()
    return df.filter(named), df.filter(~named).select((F.col("row") + 2).alias("row"), F.lit("Missing company name").alias("reason"))


def numbered(df: DataFrame, order: tuple[str, ...], out: str, start: int = 1) -> DataFrame:
    """The rows with dense numbers from `start` in the given order of columns, written.

    Rows are dealt out by ranges of the order and counted by range, so that no task gets more than a range.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    rows = dealt.join(F.broadcast(before), part == F.col("_part"))
    return rows.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("_at", "_part", "_before")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in the given order, rows numbered anew from 1 in the order of source and row.

    source_rank and source_row say where a row comes from; columns that a source lacks are null, empty sources add
    nothing. Without any source there is nothing to give: it raises.
    """
    if not sources:
        raise ValueError("no sources")
    parts = [df.withColumn("source_rank", F.lit(k)).withColumnRenamed("row", "source_row") for k, df in enumerate(sources.values())]
    return numbered(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), ("source_rank", "source_row"), "row")


def load_sources(sources: dict[str, DataFrame | Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The union of all sources that can be read, as union_sources gives it, and what became of each.

    The second table has a row for each source, also for empty and failed ones: source, n, error (null if it could be
    read), and skipped (rows that places_to_leads and the like left out, if they were given this source's
    Observation). A source is a table, a function that gives one, or a pair of either and such an Observation. Rows are
    counted while they are written, and a source that fails doesn't stop the others. Raises with the first error if no source has a row.
    """
    spark, parts, told = SparkSession.active(), {}, []
    for name, source in sources.items():
        source, skipped = source if isinstance(source, tuple) else (source, None)
        seen = Observation()
        try:
            df = source() if callable(source) else source
            parts[name] = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), "source")
            told.append((name, seen.get["n"], None, skipped.get["skipped"] if skipped is not None else None))
        except Exception as e:  # whatever a source fails with is its own
            told.append((name, 0, str(e).partition("\n")[0][:500], None))
    if not any(n for _, n, _, _ in told):
        raise ValueError(next((e for _, _, e, _ in told if e), "no source has rows"))
    status = spark.createDataFrame(told, "source string, n long, error string, skipped long")
    return union_sources(parts), status


def source_counts(df: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """source, n; the named sources have a row if they have none of the rows, too."""
    found = df.groupBy("source").agg(F.count("*").alias("n"))
    if not sources:
        return found
    named = df.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return named.join(found.hint("merge"), "source", "full").select("source", F.coalesce("n", F.lit(0)).alias("n"))
