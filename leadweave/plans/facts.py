"""Registered queries over pages, sites, enrichment and sources, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.operators import enrich, pages, sites
from leadweave.plans.fixtures import SQL, fixture
from leadweave.plans.queries import _HOME, YEAR, _scored, leads, scored
from leadweave.rules import GENERIC_GROUP, INDUSTRY_TAGS
from leadweave.sources import files, listings
from leadweave.sources.leads import conform, source_counts, union_sources
from leadweave.storage import materialise, spread


def page_facts(spark, d) -> DataFrame:
    return pages.extract_pages(spread(fixture(spark, d, "site_pages"), "url"), YEAR)


def page_contacts(spark, d):
    x = page_facts(spark, d)
    return x.select("url", "title", F.array_join("emails", ";").alias("emails"), F.array_join("phones", ";").alias("phones"), "year_founded", "owner_name", "owner_title", "employees", F.array_join("signals", ";").alias("signals"))


def page_text(spark, d):
    x = spark.read.parquet(f"{d}/pages.parquet")
    return x.select("page_id", pages.page_text(F.col("html")).alias("text"), F.size(pages.page_links(F.col("html"))).cast("long").alias("links"))


def site_rollup(spark, d):
    x = sites.rollup_sites(page_facts(spark, d))
    return x.select("domain", F.array_join("emails", ";").alias("emails"), F.array_join("phones", ";").alias("phones"), F.array_join("signals", ";").alias("signals"), "year_founded", "owner_name", "owner_title", "employees", F.size("pages").cast("long").alias("pages"), "best_email")


def robots_filter(spark, d):
    return sites.robots_allowed(fixture(spark, d, "site_pages").select("domain", "url"), fixture(spark, d, "robots_rules"))


def subpages(spark, d):
    return sites.select_pages(pages.subpage_candidates(page_facts(spark, d)), robots_filter(spark, d))


def combined_text(spark, d):
    return sites.combined_text(page_facts(spark, d)).select("domain", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


def model_facts(spark, d):
    x = enrich.parse_model_replies(fixture(spark, d, "model_replies"))
    return x.select("domain", "owner_name", "year_founded", "employee_estimate", "family_owned", F.array_join("services", ";").alias("services"), "summary")


def enriched(spark, d) -> DataFrame:
    facts = sites.rollup_sites(page_facts(spark, d))
    models = enrich.parse_model_replies(fixture(spark, d, "model_replies"))
    return enrich.fill_gaps(enrich.attach_facts(leads(spark, d), facts, models))


def gap_fill(spark, d):
    return enriched(spark, d).select("row", "email", "owner_name", "owner_title", "year_founded", "employees", "revenue", F.element_at("provenance", "owner_name").alias("owner_from"), F.element_at("provenance", "employees").alias("employees_from"))


def provenance_counts(spark, d):
    return enrich.filled_counts(enriched(spark, d))


def signals_union(spark, d):
    x = fixture(spark, d, "scored_input")
    a = F.when(F.col("signal").isNotNull(), F.array("signal"))
    b = F.when(F.col("id") % 2 == 0, F.array(F.lit("family owned business"), F.lit("Veteran-owned")))
    return x.select("id", F.array_join(enrich.merge_signals(a, b), ";").alias("signals"))


def candidates_topk(spark, d):
    texts = scored(spark, d).select(F.col("company_name").alias("domain"), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")).alias("text"))
    return enrich.model_candidates(scored(spark, d).withColumn("domain", F.col("company_name")), texts).select("upload_id", "id", F.col("pick").cast("long").alias("pick"))


def facts_json(spark, d):
    return enrich.context_rows(scored(spark, d), ("company_name", "industry", "employees"))


def industry_tags(spark, d):
    x = fixture(spark, d, "scored_input")
    return x.select("id", F.array_join(listings.industry_tags(F.concat(F.coalesce("industry", F.lit("")), F.when(F.col("id") % 3 == 0, " contractor").otherwise(""))), ";").alias("tags"))


def _listings(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = F.array(F.struct(F.col("n_name").alias("longText"), F.lit("X").alias("shortText"), F.array(F.when(F.col("c_custkey") % 2 == 0, "locality").otherwise("postal_town")).alias("types")), F.struct(F.lit("Texas").alias("longText"), F.lit("TX").alias("shortText"), F.array(F.lit("administrative_area_level_1")).alias("types")))
    place = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_name").alias("text")).alias("displayName"), parts.alias("addressComponents"), F.when(F.col("c_custkey") % 3 == 0, F.lit("+1 512-355-0100")).alias("internationalPhoneNumber"),
        F.lit("(512) 355-0199").alias("nationalPhoneNumber"), (F.col("c_custkey") % 50 / 10.0).alias("rating"), F.when(F.col("c_custkey") % 5 == 0, "CLOSED_PERMANENTLY").when(F.col("c_custkey") % 5 == 1, "OPERATIONAL").alias("businessStatus"),
    )
    return spread(c.select(F.to_json(place).alias("json")), "json")


def places_to_leads(spark, d):
    return listings.places_to_leads(_listings(spark, d), "Plumbing").select("source_id", "company_name", "phone", "city", "state", "industry", "rating")


def _elements(spark, d) -> DataFrame:
    s, k = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey")
    tags = F.map_filter(F.create_map(*[x for kv in {"name": F.when(k % 9 != 0, F.col("c_name")), "craft": F.when(k % 2 == 0, "plumber").otherwise("hvac"), "contact:phone": F.when(k % 4 == 0, "(512) 355-0100"), "addr:city": F.when(k % 3 == 0, "Austin"), "addr:street": F.lit("Main St"), "addr:housenumber": k.cast("string"), "start_date": F.when(k % 5 == 0, "1987-05")}.items() for x in (F.lit(kv[0]), kv[1].cast("string") if not isinstance(kv[1], str) else F.lit(kv[1]))]), lambda a, b: b.isNotNull())
    return s.select(F.lit("node").alias("type"), k.alias("id"), k.alias("seq"), (k % 90).cast("double").alias("lat"), (k % 180).cast("double").alias("lon"), tags.alias("tags"))


def osm_to_leads(spark, d):
    return listings.osm_to_leads(_elements(spark, d), "Plumbing").select("source_id", "company_name", "phone", "address", "city", "year_founded")


def area_search(spark, d):
    return listings.search_elements(_elements(spark, d), ["craft=plumber"], "000001", (10.0, 10.0, 60.0, 150.0), 40).select("id")


def union_query(spark, d):
    a = leads(spark, d)
    b = conform(listings.places_to_leads(_listings(spark, d), "Plumbing").withColumn("row", F.col("source_id").cast("long")), "places", YEAR)
    return source_counts(union_sources({"csv": a, "places": b}))


def export_rows(spark, d):
    x = scored(spark, d).withColumn("sources", F.array(F.lit("csv"))).drop("revenue", "rating")
    return files.export_rows(x).select("company_name", "score", "tier", "signals", "sources", "owner_name")


QUERIES = {
    "page_contacts": page_contacts, "page_text": page_text, "site_rollup": site_rollup, "robots_filter": robots_filter, "select_pages": subpages, "combined_text": combined_text, "model_facts": model_facts, "gap_fill": gap_fill,
    "provenance_counts": provenance_counts, "signals_union": signals_union, "candidates_topk": candidates_topk, "facts_json": facts_json, "industry_tags": industry_tags, "places_to_leads": places_to_leads,
    "osm_to_leads": osm_to_leads, "area_search": area_search, "union_sources": union_query, "export_rows": export_rows,
}

_ROBOTS = f"WITH p AS ({SQL['site_pages']}), r AS ({SQL['robots_rules']}), h AS (SELECT p.domain, p.url, arg_max(r.allow, length(r.path) * 100 - r.rule_seq) AS allow FROM p JOIN r ON p.domain = r.domain AND starts_with(regexp_extract(p.url, '^[a-z]+://[^/?#]+(.*)$', 1), r.path) GROUP BY ALL), a AS (SELECT p.domain, p.url, coalesce(h.allow, TRUE) AS allowed FROM p LEFT JOIN h ON p.url = h.url) "
_SITE = "CAST(1950 + k % 60 AS INT)"
_OWNER = "CASE k % 4 WHEN 0 THEN 'Rick Alvarez' WHEN 1 THEN 'Jane Doe' WHEN 3 THEN 'Mary Ann Smith' END"
_B = "b AS (SELECT c_custkey AS k, substr(md5(CAST(c_custkey AS VARCHAR)),1,12) AS h FROM customer WHERE c_custkey % 3 = 0)"
_TEAM = "CASE WHEN 1 + k % 40 >= 2 THEN CAST(1 + k % 40 AS INT) END"


def _tag_case(k: int) -> str:
    keys, tags = INDUSTRY_TAGS[k]
    return "CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in keys) + " THEN [" + ", ".join(f"'{x}'" for x in tags) + "] ELSE [] END"


ORACLE_SQL = {
    "page_contacts": f"WITH {_B} SELECT 'https://' || h || '.com/' AS url, 'Co ' || h AS title, 'info@' || h || '.com' AS emails, '' AS phones, {_SITE} AS year_founded, NULL AS owner_name, NULL AS owner_title, CAST(NULL AS INT) AS employees, 'Family-owned' AS signals FROM b "
    f"UNION ALL SELECT 'https://' || h || '.com/about-us', '', 'rick@' || h || '.com', '+1512355' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), NULL, {_OWNER}, CASE WHEN {_OWNER} IS NOT NULL THEN 'Founder' END, {_TEAM}, 'Multi-generation family business' FROM b",
    "site_rollup": f"WITH {_B} SELECT h || '.com' AS domain, 'info@' || h || '.com;rick@' || h || '.com' AS emails, '+1512355' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS phones, 'Family-owned;Multi-generation family business' AS signals, {_SITE} AS year_founded, {_OWNER} AS owner_name, CASE WHEN {_OWNER} IS NOT NULL THEN 'Founder' END AS owner_title, {_TEAM} AS employees, 2::BIGINT AS pages, 'rick@' || h || '.com' AS best_email FROM b",
    "robots_filter": _ROBOTS + "SELECT * FROM a",
    "select_pages": _ROBOTS + "SELECT domain, 'https://' || domain || '/about-us' AS url FROM p WHERE page_seq = 0 AND ('https://' || domain || '/about-us') NOT IN (SELECT url FROM a WHERE NOT allowed)",
    "model_facts": f"WITH r AS ({SQL['model_replies']}), c AS (SELECT domain, CASE WHEN contains(reply, 'Ricardo') THEN 0 WHEN contains(reply, 'Sure') THEN 1 ELSE 2 END AS kind FROM r) SELECT domain, CASE WHEN kind = 0 THEN 'Ricardo Alvarez' END AS owner_name, CASE WHEN kind = 0 THEN 1985 END AS year_founded, CASE WHEN kind = 1 THEN 12 END AS employee_estimate, "
    "CASE kind WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS family_owned, CASE kind WHEN 0 THEN 'AC repair' WHEN 1 THEN 'a;b' ELSE '' END AS services, CASE kind WHEN 0 THEN 'S.' ELSE '' END AS summary FROM c",
    "signals_union": f"WITH x AS ({SQL['scored_input']}) SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN signal = 'Family-owned' THEN 'Family-owned;Veteran-owned' WHEN signal IS NOT NULL THEN signal || ';family owned business;Veteran-owned' ELSE 'family owned business;Veteran-owned' END ELSE coalesce(signal, '') END AS signals FROM x",
    "candidates_topk": _scored(_HOME) + "SELECT upload_id, id, row_number() OVER (PARTITION BY upload_id ORDER BY score DESC NULLS LAST, review_count DESC NULLS LAST, id) AS pick FROM scored WHERE id % 400 > 200 QUALIFY pick <= 40",
    "facts_json": _scored(_HOME) + ", j AS (SELECT id, '{\"company_name\":\"' || company_name || '\"' || coalesce(',\"industry\":\"' || industry || '\"', '') || coalesce(',\"employees\":' || employees, '') || '}' AS facts FROM scored) SELECT id, facts, 'Use only these facts about the business: ' || facts AS prompt FROM j",
    "industry_tags": f"WITH x AS ({SQL['scored_input']}), t AS (SELECT id, lower(coalesce(industry, '') || CASE WHEN id % 3 = 0 THEN ' contractor' ELSE '' END) AS t FROM x), g AS (SELECT id, flatten([{', '.join(_tag_case(k) for k in range(len(INDUSTRY_TAGS)) if k != GENERIC_GROUP)}]) AS specific, {_tag_case(GENERIC_GROUP)} AS generic FROM t), "
    "s AS (SELECT id, CASE WHEN len(specific) > 0 THEN specific ELSE generic END AS tags FROM g) SELECT id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ';') AS tags FROM s",
    "places_to_leads": "SELECT CAST(c_custkey AS VARCHAR) AS source_id, c_name AS company_name, CASE WHEN c_custkey % 3 = 0 THEN '+1 512-355-0100' ELSE '(512) 355-0199' END AS phone, n_name AS city, 'TX' AS state, 'Plumbing' AS industry, c_custkey % 50 / 10.0::DOUBLE AS rating FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0",
    "osm_to_leads": "SELECT 'node/' || c_custkey AS source_id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS company_name, CASE WHEN c_custkey % 4 = 0 THEN '(512) 355-0100' END AS phone, c_custkey || ' Main St' || CASE WHEN c_custkey % 3 = 0 THEN ', Austin' ELSE '' END AS address, CASE WHEN c_custkey % 3 = 0 THEN 'Austin' END AS city, CASE WHEN c_custkey % 5 = 0 THEN '1987' END AS year_founded FROM customer",
    "area_search": "WITH f AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 90 BETWEEN 10 AND 60 AND c_custkey % 180 BETWEEN 10 AND 150 AND c_custkey % 9 <> 0 AND (c_custkey % 2 = 0 OR contains(lower(c_name), '000001')) ORDER BY c_custkey LIMIT 80) SELECT id FROM f ORDER BY (id % 4 = 0) DESC, id LIMIT 40",
    "union_sources": f"WITH l AS ({SQL['leads']}) SELECT 'csv' AS source, count(*) AS n FROM l UNION ALL SELECT 'places', count(*) FROM customer WHERE c_custkey % 5 <> 0",
    "export_rows": _scored(_HOME) + "SELECT company_name, CAST(score AS VARCHAR) AS score, tier, coalesce(signal, '') AS signals, 'csv' AS sources, coalesce(owner_name, '') AS owner_name FROM scored",
}
