"""Registered queries of skewed look-ups, records with line breaks, source states, sinks, phone plans and late facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.functions import text as T
from leadweave.operators import enrich, pages, phones, sites, validate
from leadweave.operators.score import half_up
from leadweave.plans.facts import _elements, _listings, page_facts
from leadweave.plans.fixtures import SQL, fixture
from leadweave.plans.more import _ENRICHED
from leadweave.plans.queries import _CONFORMED, _HOME, _LABELS, _scored, leads, scored
from leadweave.sources import files, listings
from leadweave.sources.leads import load_sources
from leadweave.storage import scratch_path
from leadweave.streaming import late


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINKS = ("/contact", "/about", "/team", "/our-story", "/story", "/company", "/who-we-are", "/history", "/leadership", "/staff", "/meet", "/services", "/prices", "/Our-HISTORY")


def subpage_links(spark, d):
    """Links to two of the kinds of pages for each customer's site."""
    k = F.col("c_custkey")
    link = lambda n: F.concat(F.lit('<a href="'), F.element_at(F.array(*[F.lit(x) for x in LINKS]), (n % len(LINKS) + 1).cast("int")), F.lit('">x</a>'))
    x = _table(spark, d, "customer").select(F.concat(F.lit("c"), k, F.lit(".com")).alias("domain"), F.lit(0).alias("page_seq"), F.concat(F.lit("https://c"), k, F.lit(".com/")).alias("url"), F.concat(link(k), link(k + 5)).alias("html"))
    found = pages.subpage_candidates(x.withColumn("links", pages.page_links(F.col("html"))))
    return found.select("domain", "url", F.col("position").cast("long").alias("position"))


def _seconds(c: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + c)


def ttl_hot(spark, d):
    """As-of reuse where one domain has a tenth of all rows."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    o = _table(spark, d, "lineitem").select(
        F.when(k % 10 == 0, "hot.com").otherwise(F.concat(F.lit("d"), F.col("l_partkey") % 50, F.lit(".com"))).alias("domain"), F.when(n % 2 == 0, "mx").otherwise("web").alias("kind"),
        _seconds((k * 37 + n * 11) % 500_000).alias("observed_at"), F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("unknown")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("outcome"),
    )
    k = F.col("o_orderkey")
    asked = _table(spark, d, "orders").select(k.alias("row"), F.when(k % 10 == 0, "hot.com").otherwise(F.concat(F.lit("d"), F.col("o_custkey") % 60, F.lit(".com"))).alias("domain"), F.when(F.col("o_custkey") % 2 == 0, "mx").otherwise("web").alias("kind"), _seconds(k * 53 % 600_000).alias("at"))
    return validate.latest_observation(asked, o, 2).drop("at")


def robots_many(spark, d):
    """One domain with a rule for each part, asked for a page of each order."""
    h = F.md5(F.col("p_partkey").cast("string"))
    rule = _table(spark, d, "part").select(F.lit("hot.com").alias("domain"), F.lit("*").alias("agent"), F.col("p_partkey").alias("rule_seq"), F.concat(F.lit("/"), F.substring(h, F.lit(1), (F.lit(1) + F.col("p_partkey") % 4).cast("int"))).alias("path"), (F.col("p_partkey") % 3 == 0).alias("allow"))
    k = F.col("o_orderkey")
    domain = F.when(k % 4 == 0, "cold.com").otherwise("hot.com")
    page = _table(spark, d, "orders").select(domain.alias("domain"), F.concat(F.lit("https://"), domain, F.lit("/"), F.md5(k.cast("string"))).alias("url"))
    return sites.robots_allowed(page, rule)


def csv_multiline(spark, d):
    """Names with quotes, separators and line breaks, written as CSV and read again in splits."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat("c_name", F.lit('\n"branch", '), k)).when(k % 7 == 1, F.concat(F.lit("\n"), "c_name")).otherwise(F.col("c_name"))
    path = scratch_path(spark, "csv")
    _table(spark, d, "customer").orderBy(k).select(name.alias("Company Name"), F.when(k % 3 == 0, F.lit('say "hi", then\n\n"bye"')).alias("Notes"), F.concat(F.lit("c"), k, F.lit(".com")).alias("URL")).write.csv(path, **files.CSV_OUT)
    return files.read_leads_csv(spark, path).select("row", "company_name", "website", F.col("Notes").alias("notes"))


def source_status(spark, d):
    """What became of four sources, one of them empty and one missing."""
    closed = Observation()
    sources = {
        "csv": leads(spark, d),
        "places": (lambda: listings.places_to_leads(_listings(spark, d), "Plumbing", closed).withColumn("row", F.col("source_id").cast("long")), closed),
        "map": lambda: listings.osm_to_leads(_elements(spark, d).limit(0)).withColumn("row", F.lit(1).cast("long")),
        "broken": lambda: spark.read.parquet(f"{d}/no_such_table.parquet"),
    }
    return load_sources(sources)[1].select("source", "n", F.col("error").isNotNull().alias("failed"), "skipped")


def crawl_counts(spark, d):
    k = F.col("c_custkey")
    return sites.crawl_counts(_table(spark, d, "customer").select(F.when(k % 5 == 0, "blocked").when(k % 3 == 0, "failed").when(k % 7 != 0, "crawled").alias("status")))


def phones_abroad(spark, d):
    k = F.col("c_custkey")
    pad = lambda n: F.lpad(k.cast("string"), n, "0")
    forms = (("+44 7", 9), ("+33 1 ", 8), ("0049 15", 9), ("+34 900 ", 6), ("+1 (512) 3", 6), ("+61 4", 7), ("(512) 3", 6), ("+999 ", 6), ("+44 (0)20 ", 8), ("+353 1 800 ", 6))
    number = None
    for i, (start, n) in enumerate(forms):
        one = F.concat(F.lit(start), pad(n))
        number = F.when(k % len(forms) == i, one) if number is None else number.when(k % len(forms) == i, one)
    x = _table(spark, d, "customer").select(k.alias("id"), number.alias("phone"))
    return phones.classify_phones(x, "phone", phones.phone_plan(spark)).select("id", "phone_plan.*")


def bonus_reasons(spark, d):
    """The reasons of revenue, signals and reputation."""
    x = scored(spark, d).select("id", F.explode("score_reasons").alias("r")).filter(F.col("r.key").isin("revenue", "signals", "reputation"))
    return x.select("id", F.col("r.key").alias("key"), F.col("r.label").alias("label"), F.col("r.points").cast("long").alias("points"))


def display_values(spark, d):
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select(k.alias("id"), T.display_pct(k % 13, k % 40).cast("long").alias("pct"), T.display_years_since(F.when(k % 9 != 0, F.lit(1950) + k % 70), 2026).cast("long").alias("years"))


def saved_uploads(spark, d):
    """Five uploads saved, one of them saved again with half of its rows, one deleted."""
    path = scratch_path(spark, "uploads")
    x = scored(spark, d).select("id", "upload_id", "score")
    files.save_leads(x, path)
    files.save_leads(x.filter("upload_id = 2 AND id % 2 = 0").withColumn("score", F.lit(-1)), path)
    kept = files.delete_upload(spark.read.parquet(path), 4)
    return kept.select("id", F.col("upload_id").cast("long").alias("upload_id"), F.col("score").cast("long").alias("score"))


def csv_export(spark, d):
    """All columns of the export, written and read again."""
    path = scratch_path(spark, "export")
    files.export_csv(scored(spark, d).withColumn("sources", F.array(F.lit("csv"), F.lit("map"))), path)
    return spark.read.csv(path, header=True, quote='"', escape='"').select(*[F.coalesce(c, F.lit("")).alias(c) for c in files.EXPORT])


def disposable_file(spark, d):
    """Disposable domains from a file: a nation's own, and all below it."""
    path = scratch_path(spark, "disposable")
    n = _table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.regexp_replace("n_name", " ", "-"), F.lit(".Com")).alias("value"))
    n.unionByName(spark.range(2).select(F.when(F.col("id") == 0, "# a remark").otherwise("").alias("value"))).write.text(path)
    c = _table(spark, d, "customer").join(_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name").hint("merge"), "c_nationkey")
    x = c.select(F.col("c_custkey").alias("id"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "mail.").otherwise(""), F.lower(F.regexp_replace("n_name", " ", "-")), F.when(F.col("c_custkey") % 5 == 0, ".org").otherwise(".com")).alias("domain"))
    return T.flag_disposable(x, "domain", validate.disposable_dimension(spark, path)).select("id", "is_disposable")


def area_cells(spark, d):
    """The search of area_search over elements saved by grid cells."""
    path, box = scratch_path(spark, "cells"), (10.0, 10.0, 60.0, 150.0)
    listings.save_elements(_elements(spark, d), path, 30.0)
    return listings.search_elements(listings.elements_in(spark.read.parquet(path), box, 30.0), ["craft=plumber"], "000001", box, 40).select("id")


def enrichment_errors(spark, d):
    """Leads whose site's crawl failed, or whose model gave no facts."""
    found = sites.rollup_sites(page_facts(spark, d)).withColumn("error", F.when(F.col("year_founded") % 2 == 0, "timeout"))
    models = enrich.parse_model_replies(fixture(spark, d, "model_replies"))
    x = enrich.enrichment_record(enrich.fill_gaps(enrich.attach_facts(leads(spark, d), found, models)))
    return x.select("row", F.col("enrichment.crawl_error").alias("crawl_error"), F.col("enrichment.ai_error").alias("ai_error"))


def capped_candidates(spark, d):
    """For each upload the leads that a model reads, and over all how many were readable and skipped by the cap."""
    readable = Observation()
    x = scored(spark, d).withColumn("domain", F.col("company_name"))
    texts = x.select("domain", F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")).alias("text"))
    taken = enrich.model_candidates(x, texts, skipped=readable).groupBy("upload_id").agg(F.count("*").alias("taken")).collect()  # a row an upload
    told, total = readable.get["readable"], sum(r["taken"] for r in taken)
    return spark.createDataFrame([(total, told, told - total)], "taken long, readable long, skipped long")


def late_facts(spark, d):
    """Facts of customers in three files that are read as a stream; the newest of each domain, after a replay."""
    source, store = scratch_path(spark, "facts-in"), scratch_path(spark, "facts")
    k = F.col("o_custkey")
    x = _table(spark, d, "orders").select(F.concat(F.lit("c"), k % 500, F.lit(".com")).alias("domain"), _seconds(F.col("o_orderkey") * 7 % 100_000).alias("observed_at"), k.alias("employees"))
    for part in range(3):
        x.filter(F.col("o_orderkey") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(source)
    late.upsert_facts(stream, store, scratch_path(spark, "facts-state"), availableNow=True).awaitTermination()
    late.upsert_facts(stream, store, scratch_path(spark, "facts-again"), availableNow=True).awaitTermination()  # all batches replayed
    return late.current_facts(spark, store, x.schema).select("domain", "employees")


def lead_socials(spark, d):
    """Social links of leads, and those of their sites where they have none."""
    k = F.col("c_custkey")
    some = lambda **kinds: F.map_filter(F.create_map(*[x for n, c in kinds.items() for x in (F.lit(n), F.when(c, F.concat(F.lit(f"{n}/"), k)))]), lambda n, v: v.isNotNull())
    x = _table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 != 0, some(linkedin=k % 2 == 0, x=k % 3 == 0)).alias("lead"), F.when(k % 5 != 0, some(linkedin=k % 4 == 0, facebook=k % 3 == 1)).alias("site"))
    merged = enrich.merge_socials(F.col("lead"), F.transform_values("site", lambda n, v: F.concat(v, F.lit("/site"))))
    return x.withColumn("m", merged).select("id", *[F.element_at("m", n).alias(n) for n in ("linkedin", "x", "facebook")])


QUERIES = {
    "lead_socials": lead_socials, "subpage_links": subpage_links, "ttl_hot": ttl_hot, "robots_many": robots_many, "csv_multiline": csv_multiline, "source_status": source_status, "crawl_counts": crawl_counts, "phones_abroad": phones_abroad,
    "bonus_reasons": bonus_reasons, "display_values": display_values, "saved_uploads": saved_uploads, "csv_export": csv_export, "disposable_file": disposable_file, "area_cells": area_cells,
    "enrichment_errors": enrichment_errors, "capped_candidates": capped_candidates, "late_facts": late_facts,
}

_AT = "TIMESTAMP '2024-01-01' + to_seconds({})"
_MONEY = "CASE WHEN revenue >= 1000000 THEN CASE WHEN revenue % 1000000 = 0 THEN '$' || CAST(revenue / 1000000 AS INT) || 'M' ELSE '$' || CAST(revenue / 1000000 AS DECIMAL(18, 1)) || 'M' END ELSE '$' || CAST(revenue / 1000 AS INT) || 'K' END"


def _band(low: float, high: float) -> str:
    money = lambda v: f"${v / 1e6:.0f}M" if v >= 1e6 and v % 1e6 == 0 else f"${v / 1e6:.1f}M" if v >= 1e6 else f"${half_up(v / 1e3)}K"
    return f"target band ({money(low)}–{money(high)})"


_SHOWN = f"CASE WHEN coalesce(revenue_estimated, FALSE) THEN 'Est. revenue ~' || {_MONEY} || ' (from headcount)' ELSE 'Revenue ' || {_MONEY} END"
_REVENUE = f"CASE WHEN revenue IS NULL THEN 'Revenue unknown' WHEN revenue BETWEEN {_HOME.revenue_min} AND {_HOME.revenue_max} THEN {_SHOWN} || ' in ' WHEN revenue < {_HOME.revenue_min} THEN {_SHOWN} || ' below ' ELSE {_SHOWN} || ' above ' END || CASE WHEN revenue IS NULL THEN '' ELSE '{_band(_HOME.revenue_min, _HOME.revenue_max)}' END"
_ALL_LABELS = {"revenue": _REVENUE, **_LABELS, "signals": "'Ownership signal: ' || signal", "reputation": "'Strong reputation: ' || rating || '★ from ' || review_count || ' reviews'"}
_WHOLE = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _export_sql() -> str:
    reasons = ", ".join(f"CASE WHEN p_{k} > 0 THEN ({v}) || ' (+' || p_{k} || ')' END" for k, v in _ALL_LABELS.items())
    given = {"signals": "signal", "sources": "'csv; map'", "revenue": _WHOLE.format("revenue"), "rating": _WHOLE.format("rating"), "score_reasons": f"array_to_string(list_filter([{reasons}], lambda x: x IS NOT NULL), '; ')"}
    have = ("score", "tier", "company_name", "industry", "email_status", "phone_status", "owner_name", "owner_title", "revenue_estimated", "employees", "year_founded", "review_count", "website_status")
    return _scored(_HOME) + "SELECT " + ", ".join(f"coalesce(CAST({given.get(c, c)} AS VARCHAR), '') AS {c}" if c in have or c in given else f"'' AS {c}" for c in files.EXPORT) + " FROM scored"


_SUBPAGE = "(contact|about|team|our-story|story|company|who-we-are|history|leadership|staff|meet)"
ORACLE_SQL = {
    "lead_socials": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 'linkedin/' || c_custkey WHEN c_custkey % 5 <> 0 AND c_custkey % 4 = 0 THEN 'linkedin/' || c_custkey || '/site' END AS linkedin, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN 'x/' || c_custkey END AS x, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 = 1 THEN 'facebook/' || c_custkey || '/site' END AS facebook FROM customer",
    "subpage_links": f"WITH l AS (SELECT c_custkey AS k, i AS position, [{', '.join(repr(x) for x in LINKS)}][CAST((c_custkey + 5 * i) % {len(LINKS)} + 1 AS INT)] AS path FROM customer, (VALUES (0), (1)) t(i)) SELECT 'c' || k || '.com' AS domain, 'https://c' || k || '.com' || path AS url, CAST(position AS BIGINT) AS position FROM l WHERE regexp_matches(path, '(?i){_SUBPAGE}')",
    "ttl_hot": "WITH r AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'hot.com' ELSE 'd' || (l_partkey % 50) || '.com' END AS domain, CASE WHEN l_linenumber % 2 = 0 THEN 'mx' ELSE 'web' END AS kind, " + _AT.format("(l_orderkey * 37 + l_linenumber * 11) % 500000") + " AS observed_at, ['yes', 'no', 'unknown'][CAST(l_suppkey % 3 + 1 AS INT)] AS outcome FROM lineitem), "
    "o AS (SELECT domain, kind, observed_at, max(outcome) AS outcome FROM r GROUP BY ALL), k AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 10 = 0 THEN 'hot.com' ELSE 'd' || (o_custkey % 60) || '.com' END AS domain, CASE WHEN o_custkey % 2 = 0 THEN 'mx' ELSE 'web' END AS kind, " + _AT.format("o_orderkey * 53 % 600000") + " AS at FROM orders) "
    "SELECT row, k.domain, k.kind, CASE WHEN o.observed_at >= k.at - INTERVAL 2 HOUR THEN o.outcome END AS outcome FROM k ASOF LEFT JOIN o ON k.domain = o.domain AND k.kind = o.kind AND k.at >= o.observed_at",
    "robots_many": "WITH r AS (SELECT '/' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, CAST(1 + p_partkey % 4 AS INT)) AS path, p_partkey AS seq, p_partkey % 3 = 0 AS allow FROM part), p AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'cold.com' ELSE 'hot.com' END AS domain, '/' || md5(CAST(o_orderkey AS VARCHAR)) AS path FROM orders), "
    "b AS (SELECT path, arg_min(allow, seq) AS allow FROM r GROUP BY path), h AS (SELECT p.path, arg_max(b.allow, length(b.path)) AS allow FROM p JOIN b ON starts_with(p.path, b.path) WHERE domain = 'hot.com' GROUP BY p.path) SELECT domain, 'https://' || domain || p.path AS url, coalesce(CASE WHEN domain = 'hot.com' THEN allow END, TRUE) AS allowed FROM p LEFT JOIN h ON p.path = h.path",
    "csv_multiline": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, CASE WHEN c_custkey % 7 = 0 THEN c_name || chr(10) || '\"branch\", ' || c_custkey WHEN c_custkey % 7 = 1 THEN chr(10) || c_name ELSE c_name END AS company_name, 'c' || c_custkey || '.com' AS website, CASE WHEN c_custkey % 3 = 0 THEN 'say \"hi\", then' || chr(10) || chr(10) || '\"bye\"' END AS notes FROM customer",
    "source_status": f"SELECT 'csv' AS source, count(*) AS n, FALSE AS failed, NULL::BIGINT AS skipped FROM ({SQL['leads']}) UNION ALL SELECT 'places', count(*) FILTER (WHERE c_custkey % 5 <> 0), FALSE, count(*) FILTER (WHERE c_custkey % 5 = 0) FROM customer UNION ALL SELECT 'map', 0, FALSE, NULL UNION ALL SELECT 'broken', 0, TRUE, NULL",
    "crawl_counts": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'blocked' WHEN c_custkey % 3 = 0 THEN 'failed' WHEN c_custkey % 7 <> 0 THEN 'crawled' END AS status, count(*) AS n FROM customer GROUP BY ALL",
    "phones_abroad": "WITH x AS (SELECT c_custkey AS id, c_custkey % 10 AS m, CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT id, CASE m WHEN 0 THEN '+447' || lpad(k, 9, '0') WHEN 1 THEN '+331' || lpad(k, 8, '0') WHEN 2 THEN '+4915' || lpad(k, 9, '0') WHEN 3 THEN '+34900' || lpad(k, 6, '0') WHEN 4 THEN '+15123' || lpad(k, 6, '0') WHEN 5 THEN '+614' || lpad(k, 7, '0') "
    "WHEN 7 THEN '+999' || lpad(k, 6, '0') WHEN 8 THEN '+4420' || lpad(k, 8, '0') WHEN 9 THEN '+3531800' || lpad(k, 6, '0') END AS e164, CASE m WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' WHEN 3 THEN 'ES' WHEN 4 THEN 'US' WHEN 5 THEN 'AU' WHEN 8 THEN 'GB' WHEN 9 THEN 'IE' END AS country, "
    "CASE m WHEN 0 THEN 'MOBILE' WHEN 1 THEN 'FIXED_LINE' WHEN 2 THEN 'MOBILE' WHEN 3 THEN 'TOLL_FREE' WHEN 4 THEN 'FIXED_LINE_OR_MOBILE' WHEN 8 THEN 'FIXED_LINE' WHEN 9 THEN 'TOLL_FREE' END AS type, CASE WHEN m = 6 THEN NULL ELSE m IN (0, 1, 2, 3, 4, 8, 9) END AS valid FROM x",
    "bonus_reasons": _scored(_HOME) + " UNION ALL ".join(f"SELECT id, '{k}' AS key, {_ALL_LABELS[k]} AS label, p_{k} AS points FROM scored" + (f" WHERE p_{k} > 0" if k in rules.BONUS else "") for k in ("revenue", "signals", "reputation")),
    "display_values": "SELECT c_custkey AS id, CASE WHEN c_custkey % 40 > 0 THEN CAST(floor((c_custkey % 13) * 100.0::DOUBLE / (c_custkey % 40) + 0.5) AS BIGINT) ELSE 0 END AS pct, CASE WHEN c_custkey % 9 <> 0 THEN CAST(2026 - (1950 + c_custkey % 70) AS BIGINT) END AS years FROM customer",
    "saved_uploads": _scored(_HOME) + "SELECT id, CAST(upload_id AS BIGINT) AS upload_id, CASE WHEN upload_id = 2 THEN -1 ELSE CAST(score AS BIGINT) END AS score FROM scored WHERE upload_id <> 4 AND (upload_id <> 2 OR id % 2 = 0)",
    "csv_export": _export_sql(),
    "disposable_file": "SELECT c_custkey AS id, n_nationkey % 2 = 0 AND c_custkey % 5 <> 0 AS is_disposable FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "enrichment_errors": _CONFORMED + ", " + _ENRICHED + "SELECT row, CASE WHEN site AND k % 2 = 0 THEN 'timeout' END AS crawl_error, CASE WHEN model AND k % 3 = 2 THEN 'no JSON object in the reply' END AS ai_error FROM e",
    "capped_candidates": _scored(_HOME) + ", n AS (SELECT upload_id, count(*) AS n FROM scored WHERE id % 400 > 200 GROUP BY upload_id) SELECT CAST(sum(least(n, 40)) AS BIGINT) AS taken, CAST(sum(n) AS BIGINT) AS readable, CAST(sum(n - least(n, 40)) AS BIGINT) AS skipped FROM n",
    "area_cells": "WITH f AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 90 BETWEEN 10 AND 60 AND c_custkey % 180 BETWEEN 10 AND 150 AND c_custkey % 9 <> 0 AND (c_custkey % 2 = 0 OR contains(lower(c_name), '000001')) ORDER BY c_custkey LIMIT 80) SELECT id FROM f ORDER BY (id % 4 = 0) DESC, id LIMIT 40",
    "late_facts": "SELECT domain, max({'t': t, 'e': e}).e AS employees FROM (SELECT 'c' || (o_custkey % 500) || '.com' AS domain, o_orderkey * 7 % 100000 AS t, o_custkey AS e FROM orders) GROUP BY domain",
}
