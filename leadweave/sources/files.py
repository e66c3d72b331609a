"""CSV and Parquet sources and sinks of leads."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.sources.leads import map_columns, numbered
from leadweave.storage import materialise

SEPARATORS = (",", ";", "\t", "|")
CSV_OUT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EXPORT = (
    "score", "tier", "company_name", "industry", "city", "state", "address", "website", "email", "email_status", "email_reason", "phone", "phone_status", "phone_type", "owner_name", "owner_title", "revenue",
    "revenue_estimated", "employees", "year_founded", "linkedin", "rating", "review_count", "website_status", "signals", "sources", "merged_count", "score_reasons", "norm_name",
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block, _seq, value: the lines of the files, read in splits; the last three place a line."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq")]
    return spark.read.text(path).select(*place, F.regexp_replace("value", "\r$", "").alias("value"))


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """_file, _block, _seq, record, is_first: the records of CSV files, whose quoted fields may hold line breaks.

    Lines are read in splits, as no one can tell before whether a split begins within quotes. So each line says whether
    it ends within quotes if it begins outside of them, and if it begins within them: it sets the state, keeps it or
    turns it. Running sums and last values of that within each split, then over the splits of each file, tell in what
    state each line begins, and lines that begin within quotes are joined to the one before. A quote opens a field
    only at its start, two quotes within quotes are one. A record stands where its first line does; a quote that isn't
    closed takes what is left of its file.
    """
    s = "\\" + sep if sep in "|." else sep
    field = rf'(?:"(?:[^"]|"")*+"[^{s}]*+|(?!")[^{s}]*+)'
    opens = rf'^(?:{field}{s})*+"(?:[^"]|"")*+$'  # from outside
    stays = r'^(?:[^"]|"")*+$'  # from within: no quote that closes
    reopens = rf'^(?:[^"]|"")*+"[^{s}]*+{s}(?:{field}{s})*+"(?:[^"]|"")*+$'
    lines = _lines(spark, path).withColumns({"_out": F.col("value").rlike(opens), "_in": F.col("value").rlike(stays) | F.col("value").rlike(reopens)})
    lines = materialise(lines, "csv-lines")
    fixed = F.when(F.col("_out") == F.col("_in"), F.col("_in"))  # the state after the line, whatever it was
    turns = (F.col("_out") & ~F.col("_in")).cast("long")
    own = W.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    sofar = lines.withColumn("_turned", F.sum(turns).over(own)).withColumn("_set", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("_turned").alias("at"))), True).over(own))
    # what each split does to the state, and in what state it is entered
    splits = sofar.groupBy("_file", "_block").agg(F.max_by(F.struct("_turned", "_set"), "_seq").alias("end"))
    files = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_total", F.coalesce(F.sum("end._turned").over(files), F.lit(0)))
    splits = splits.withColumn("_carried", F.last(F.when(F.col("end._set").isNotNull(), F.struct(F.col("end._set.state").alias("state"), (F.col("_total") + F.col("end._set.at")).alias("at"))), True).over(files))
    splits = splits.select("_file", "_block", "_total", "_carried")
    before = W.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(W.unboundedPreceding, -1)
    at = sofar.select("*", F.last("_turned").over(before).alias("_t"), F.last("_set").over(before).alias("_s")).join(splits.hint("merge"), ["_file", "_block"])
    turned = F.col("_total") + F.coalesce("_t", F.lit(0))
    last = F.coalesce(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s.state").alias("state"), (F.col("_total") + F.col("_s.at")).alias("at"))), F.col("_carried"))
    state = F.coalesce(last["state"], F.lit(False)) != ((turned - F.coalesce(last["at"], F.lit(0))) % 2 == 1)
    is_first = (F.col("_block") == 0) & F.col("_t").isNull()  # of its file
    at = materialise(at.select("_file", "_block", "_seq", "value", (~state).alias("_begins"), is_first.alias("is_first")), "csv-states")
    # a line within quotes belongs to the last line before it that isn't, of its split or an earlier one
    heads = at.filter("_begins").groupBy("_file", "_block").agg(F.max("_seq").alias("_last"))
    heads = at.select("_file", "_block").distinct().join(heads.hint("merge"), ["_file", "_block"], "left")
    heads = heads.withColumn("_open", F.last(F.when(F.col("_last").isNotNull(), F.struct("_block", "_last")), True).over(files)).drop("_last")
    head = F.last(F.when(F.col("_begins"), F.struct("_block", F.col("_seq").alias("_last"))), True).over(own)
    rows = at.withColumn("_head", head).join(heads.hint("merge"), ["_file", "_block"]).withColumn("_head", F.coalesce("_head", "_open"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_seq", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("_file", F.col("_head._block").alias("_block"), F.col("_head._last").alias("_seq")).agg(whole.alias("record"), F.max("is_first").alias("is_first"))


def read_leads_csv(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = True) -> DataFrame:
    """Rows of strings under the canonical names of the mapped headers, and row, their number from 0; blank rows are left out.

    Rows are numbered in the order of files and records. Without `sep`, the separator that the header line holds most
    often outside of quotes is taken. Other headers keep their names. Quoted fields may hold line breaks, as \n, unless
    multiline is False, which spares the lines a shuffle. The header must stand on one line.
    """
    head = spark.read.text(path).limit(1).collect()
    line = head[0].value.removesuffix("\r") if head else ""
    if sep is None:
        plain = re.sub('"(?:[^"]|"")*"', "", line)
        sep = max(SEPARATORS, key=plain.count)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    place = ["_file", "_block", "_seq"]
    if multiline:
        names = [c.strip() for c in next(csv.reader([line], delimiter=sep), [])]
        records = csv_records(spark, path, sep)
        parsed = F.from_csv("record", ", ".join(f"_{k} string" for k in range(len(names))), options | {"maxCharsPerColumn": "-1"})
        raw = records.filter("NOT is_first").select(*place, parsed.alias("v")) if names else records.limit(0).select(*place, F.struct().alias("v"))
        raw = raw.select(*[F.col(f"v._{k}").alias(c) for k, c in enumerate(names)], *place)
    else:
        raw = spark.read.csv(path, header=True, **options)
        raw = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))
    columns = raw.columns[:-3]
    found, _ = map_columns(columns)
    names = {h: f for f, h in found.items()}
    filled = F.length(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in columns]))) > 0
    rows = raw.filter(filled).select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in columns], *place)
    return numbered(rows, tuple(place), "row", 0).drop(*place)


def parse_errors(spark: SparkSession, path: str, columns: list[str], first: int = 20, sep: str = ",") -> DataFrame:
    """The first rows that don't have the given number of fields: _corrupt (the line) and what was read of it."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    return spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").filter("_corrupt IS NOT NULL").select("_corrupt", *[F.col(f"`{c}`") for c in columns]).limit(first)


def check_rows(df: DataFrame, most: int | None) -> DataFrame:
    """The rows; raises if there are more than `most`."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def export_rows(df: DataFrame) -> DataFrame:
    """The export columns as text, best leads first: lists joined by `; `, reasons that gave points as `label (+n)`."""
    reasons = F.transform(F.filter("score_reasons", lambda r: r["points"] > 0), lambda r: F.concat(r["label"], F.lit(" (+"), r["points"].cast("string"), F.lit(")")))
    special = {"signals": F.array_join("signals", "; "), "sources": F.array_join("sources", "; "), "score_reasons": F.array_join(reasons, "; ")}
    kinds = dict(df.dtypes)

    def shown(c: str) -> Column:
        value = special.get(c, F.col(c))
        if kinds[c] in ("double", "float"):  # whole numbers without a fraction or an exponent
            return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
        return value.cast("string")

    rows = df.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("company_name"))
    return rows.select(*[F.coalesce(shown(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in EXPORT])


def export_csv(df: DataFrame, path: str) -> None:
    """Write export_rows as CSV files with headers; white space at the ends of values stays."""
    export_rows(df).write.mode("overwrite").csv(path, **CSV_OUT)


def save_leads(df: DataFrame, path: str) -> None:
    """Replace the uploads that df holds (partitions of upload_id), and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)


def delete_upload(leads: DataFrame, upload_id) -> DataFrame:
    """The leads without those of an upload."""
    return leads.filter(~F.col("upload_id").eqNullSafe(F.lit(upload_id)))
