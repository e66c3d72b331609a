"""Registered queries of files, unions, link reasons, enrichment and late facts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.operators import enrich, link, pages, query, score, sites, validate
from leadweave.plans.facts import _OWNER, _TEAM, page_facts
from leadweave.plans.fixtures import SQL, fixture
from leadweave.plans.queries import _CONFORMED, _FUZZY, _HOME, YEAR, _clusters, _estimate, _exact, _points, _scored, leads, raw_leads, scored
from leadweave.sources import files
from leadweave.sources.leads import conform, split_rejects, union_sources
from leadweave.storage import materialise, scratch_path


def _two_sources(spark, d) -> DataFrame:
    """The leads as two sources whose rows are numbered each by itself."""
    x = materialise(leads(spark, d), "leads")  # the union reads its sources more than once
    return union_sources({"csv": x.filter("row div 10 % 2 = 0"), "places": x.filter("row div 10 % 2 = 1").withColumn("row", F.col("row") - 10).withColumn("source", F.lit("places"))})


def union_clusters(spark, d):
    rows = materialise(_two_sources(spark, d), "union")
    return rows.select("row", "source", "source_row").join(link.cluster(rows)[0].hint("merge"), "row")


def _csv(spark, d) -> DataFrame:
    """The leads of customers written as CSV with headers of other names and read again; some have no company."""
    x = raw_leads(spark, d).filter("variant = 0").orderBy("row")
    x = x.select(F.when(F.col("row") % 70 != 0, F.col("company_name")).alias("Business Name"), F.col("website").alias("URL"), F.col("phone").alias("Telephone"), F.col("email").alias("E-mail Address"), F.col("city").alias(" Town"), F.concat(F.lit('"'), F.col("industry"), F.lit('", etc.')).alias("Other"))
    path = scratch_path(spark, "csv")
    x.write.csv(path, header=True, quote='"', escape='"')
    return files.read_leads_csv(spark, path)


def csv_conform(spark, d):
    good, _ = split_rejects(_csv(spark, d))
    return conform(good, "csv", YEAR).select("row", "company_name", "domain", "phone", "email", "city")


def csv_rejects(spark, d):
    return split_rejects(_csv(spark, d))[1]


def matched_on(spark, d):
    return link.matched_on(link.cluster(leads(spark, d))[1]).select("row", F.array_join("matched_on", ";").alias("reasons"))


def link_stats(spark, d):
    return link.link_statistics(link.cluster(leads(spark, d))[1])


def _site_models(spark, d):
    return materialise(sites.rollup_sites(page_facts(spark, d)), "sites"), enrich.parse_model_replies(fixture(spark, d, "model_replies"))


def enrichment_record(spark, d):
    x = enrich.enrichment_record(enrich.fill_gaps(enrich.attach_facts(leads(spark, d), *_site_models(spark, d))))
    e = F.col("enrichment")
    return x.select("row", F.size(e["pages_crawled"]).cast("long").alias("pages"), F.array_join(e["emails_found"], ";").alias("emails"), F.array_join(e["services"], ";").alias("services"), F.element_at(e["provenance"], "owner_name").alias("owner_from"), e["crawl_error"].alias("crawl_error"))


def late_upsert(spark, d):
    """Stored leads with site facts, scored; then model facts come in."""
    found, models = _site_models(spark, d)
    stored = enrich.fill_gaps(enrich.attach_facts(leads(spark, d), found, models.limit(0))).withColumns({"signals": F.coalesce("site.signals", F.array().cast("array<string>")), "email_status": F.lit("valid"), "phone_status": F.lit("valid"), "website_status": F.lit("alive")})
    stored = score.score(stored.drop("site", "model"), score.resolve_criteria(), YEAR)
    out = enrich.upsert_enrichment(materialise(stored, "stored"), found, models, score.resolve_criteria(), YEAR)
    return out.select("row", "owner_name", "owner_title", F.element_at("provenance", "owner_name").alias("owner_from"), "employees", "revenue", "revenue_estimated", F.col("score").cast("long").alias("score"))


def site_socials(spark, d):
    """The first link of each kind of social site over a site's pages; kinds are spread over the pages."""
    x = fixture(spark, d, "site_pages")
    links = F.when(F.col("page_seq") == 0, "<a href='https://facebook.com/first'>f</a>").otherwise('<a href="https://www.linkedin.com/company/q">l</a><a class=x href=https://facebook.com/second>f</a><a href="https://x.com/z">x</a>')
    x = sites.rollup_sites(pages.extract_pages(x.withColumn("html", F.concat("html", links)), YEAR))
    return x.select("domain", *[F.element_at("socials", k).alias(k) for k in ("facebook", "linkedin", "x", "yelp")])


def page_phone_counts(spark, d):
    """Numbers and addresses in the whole texts of all documents."""
    x = spark.read.parquet(f"{d}/documents.parquet")
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    return x.select("doc_id", F.size(pages.page_emails(none, text)).cast("long").alias("emails"), F.size(pages.page_phones(none, text, None, None)).cast("long").alias("phones"))


def observation_states(spark, d):
    x = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "mx").otherwise("web").alias("kind"))
    k = F.col("id")
    x = x.withColumns({"mail_hosts": k % 3, "http_status": F.when(k % 7 != 0, (k % 5 + 1) * 100).cast("int"), "error": F.when(k % 11 == 0, "dns").when(k % 13 == 0, "timeout")})
    return validate.observation_status(x).select("id", "status")


def source_filter(spark, d):
    x = scored(spark, d).withColumn("sources", F.when(F.col("id") % 3 == 0, F.array(F.lit("csv"), F.lit("places"))).when(F.col("id") % 3 == 1, F.array(F.lit("map"))).otherwise(F.array(F.lit("csv"))))
    return query.filter_leads(x, sources=("places", "map")).select("id")


def lead_lookup(spark, d):
    return query.get_lead(scored(spark, d), 42).select("id", "company_name", "tier")


def name_distances(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    x = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.lit("BUILDINGS")).otherwise("").alias("b"))
    return x.select("id", T.name_similarity(F.col("a"), F.col("b")).alias("similarity"), T.fmt_money((F.col("id") % 40 * 500_000).cast("double")).alias("money"))


QUERIES = {
    "union_clusters": union_clusters, "csv_conform": csv_conform, "csv_rejects": csv_rejects, "matched_on": matched_on, "link_stats": link_stats, "enrichment_record": enrichment_record, "late_upsert": late_upsert,
    "site_socials": site_socials, "document_contacts": page_phone_counts, "observation_states": observation_states, "source_filter": source_filter, "lead_lookup": lead_lookup, "name_distances": name_distances,
}

_UNION = f"leads AS (SELECT * EXCLUDE (row_ord), row_number() OVER (ORDER BY true_id % 2, row_ord) AS row_ord, CASE WHEN true_id % 2 = 0 THEN row_ord ELSE row_ord - 10 END AS source_row FROM ({SQL['leads']}))"
_ENRICHED = (
    f"e0 AS (SELECT row, true_id AS k, substr(md5(CAST(true_id AS VARCHAR)),1,12) AS h, email, phone, industry, coalesce(domain IS NOT NULL AND true_id % 3 = 0, FALSE) AS site, coalesce(domain IS NOT NULL AND true_id % 2 = 0, FALSE) AS model FROM keys), "
    f"e1 AS (SELECT *, CASE WHEN site THEN {_OWNER} END AS site_owner, CASE WHEN model AND k % 3 = 0 THEN 'Ricardo Alvarez' END AS ai_owner, CASE WHEN site THEN {_TEAM} END AS site_heads, CASE WHEN model AND k % 3 = 1 THEN 12 END AS ai_heads FROM e0), "
    "e2 AS (SELECT *, coalesce(ai_owner, site_owner) AS owner_name, CASE WHEN ai_owner IS NULL AND site_owner IS NOT NULL THEN 'Founder' END AS owner_title, CASE WHEN ai_owner IS NOT NULL THEN 'ai' WHEN site_owner IS NOT NULL THEN 'website' END AS owner_from, "
    "coalesce(site_heads, ai_heads) AS employees, CASE WHEN site_heads IS NOT NULL THEN 'website' WHEN ai_heads IS NOT NULL THEN 'ai' END AS employees_from, CASE WHEN site THEN CAST(1950 + k % 60 AS INT) END AS year_founded FROM e1), "
    f"e AS (SELECT *, {_estimate('industry', 'employees')} AS revenue FROM e2) "
)
_TEXTS = f"WITH p AS ({SQL['site_pages']}), t AS (SELECT domain, page_seq, url, CASE page_seq WHEN 0 THEN regexp_extract(html, '<title>(.*)</title>', 1) ELSE '' END AS title, CASE page_seq WHEN 0 THEN 'Our story ' || regexp_extract(html, '<p>(.*)</p>', 1) || ' About Mail' ELSE replace(regexp_extract(html, '<p>(.*)</p>', 1), '</p><p>', ' ') END AS text FROM p) "
_PAGE_TAG = """</?[a-zA-Z!](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[^>]*>"""


def _page_text_sql() -> str:
    s = "coalesce(html, '')"
    for pattern, to in ((pages.HIDDEN, ""), (r"(?is)<!--.*?-->", ""), (r"(?is)<head\b.*?</head>", ""), (rf"(?i)</({pages.BLOCK_ENDS})>|<br\s*/?>", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    entities = "t"
    for name, char in pages.ENTITIES:
        quoted = char.replace("'", "''")
        entities = f"replace({entities}, '{name}', '{quoted}')"
    link = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    space = T.SPACE
    return (
        f"WITH s AS (SELECT page_id, html, regexp_replace({s}, '(?s){_PAGE_TAG}', '', 'g') AS s FROM pages), c AS (SELECT page_id, html, regexp_split_to_array(s, '&#(?:x[0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});') AS p, regexp_extract_all(s, '&#(x[0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});', 1) AS c FROM s), "
        "t AS (SELECT page_id, html, array_to_string(list_transform(generate_series(1, len(p)), lambda i: p[i] || CASE WHEN i <= len(c) THEN chr(CASE WHEN starts_with(c[i], 'x') THEN CAST('0' || c[i] AS INT) ELSE CAST(c[i] AS INT) END) ELSE '' END), '') AS t FROM c) "
        f"SELECT page_id, regexp_replace(regexp_replace({entities}, '{space}', ' ', 'g'), '^ +| +$', '', 'g') AS text, CAST(len(regexp_extract_all(coalesce(html, ''), '{link}')) AS BIGINT) AS links FROM t"
    )


def _link_stats_sql() -> str:
    """Rows less components of the links of the first stages, and how much each stage adds."""
    parts = {"domain": _exact("domain"), "phone": _exact("phone_key"), "email": _exact("email_key"), "name": _FUZZY}
    sql, total = _CONFORMED.replace("WITH ", "WITH RECURSIVE ", 1), []
    for k, stage in enumerate(parts):
        links = " UNION ".join(f"({p})" for p in list(parts.values())[: k + 1])
        sql += f", l{k} AS ({links}), b{k} AS (SELECT src, dst FROM l{k} UNION SELECT dst, src FROM l{k}), w{k}(row, hop) AS (SELECT row, row FROM keys UNION SELECT w.row, b.dst FROM w{k} w JOIN b{k} b ON w.hop = b.src), c{k} AS (SELECT row, min(hop) AS cluster FROM w{k} GROUP BY row)"
        total.append(f"SELECT {k} AS k, '{stage}' AS stage, count(*) - count(DISTINCT cluster) AS joined FROM c{k}")
    return sql + f" SELECT stage, joined - lag(joined, 1, 0) OVER (ORDER BY k) AS unions FROM ({' UNION ALL '.join(total)})"


_LATE_POINTS = _points(_HOME)
ORACLE_SQL = {
    "link_stats": _link_stats_sql(),
    "union_clusters": _clusters(True).replace(f"leads AS ({SQL['leads']})", _UNION).replace("base AS (SELECT row_ord AS row,", "base AS (SELECT row_ord AS row, source_row,")
    + "SELECT c.row, CASE WHEN true_id % 2 = 0 THEN 'csv' ELSE 'places' END AS source, source_row, cluster FROM clusters c JOIN keys k ON c.row = k.row",
    "csv_conform": _CONFORMED.replace(f"leads AS ({SQL['leads']})", f"leads AS (SELECT * FROM (SELECT * EXCLUDE (row_ord), row_ord AS old, row_number() OVER (ORDER BY row_ord) - 1 AS row_ord FROM ({SQL['leads']}) WHERE variant = 0) WHERE old % 70 <> 0)")
    + "SELECT row, company_name, domain, e164 AS phone, email, shown_city AS city FROM keys",
    "csv_rejects": f"SELECT n + 1 AS row, 'Missing company name' AS reason FROM (SELECT row_ord, row_number() OVER (ORDER BY row_ord) AS n FROM ({SQL['leads']}) WHERE variant = 0) WHERE row_ord % 70 = 0",
    "matched_on": _clusters(False) + f", all_links AS (SELECT src, dst, 'domain' AS reason FROM ({_exact('domain')}) UNION ALL SELECT src, dst, 'phone' FROM ({_exact('phone_key')}) UNION ALL SELECT src, dst, 'email' FROM ({_exact('email_key')}) "
    f"UNION ALL SELECT src, dst, 'name' FROM ({_FUZZY}) f JOIN clusters a ON a.row = f.src JOIN clusters b ON b.row = f.dst WHERE a.cluster <> b.cluster), ends AS (SELECT src AS row, reason FROM all_links UNION SELECT dst, reason FROM all_links) SELECT row, string_agg(reason, ';' ORDER BY reason) AS reasons FROM ends GROUP BY row",
    "enrichment_record": _CONFORMED + ", " + _ENRICHED + "SELECT row, CASE WHEN site THEN 2 ELSE 0 END::BIGINT AS pages, CASE WHEN site THEN 'info@' || h || '.com;rick@' || h || '.com' ELSE '' END AS emails, CASE WHEN model AND k % 3 = 0 THEN 'AC repair' WHEN model AND k % 3 = 1 THEN 'a;b' ELSE '' END AS services, owner_from, NULL::VARCHAR AS crawl_error FROM e",
    "gap_fill": _CONFORMED + ", " + _ENRICHED + "SELECT row, coalesce(email, CASE WHEN site THEN 'rick@' || h || '.com' END) AS email, owner_name, owner_title, year_founded, employees, revenue, owner_from, employees_from FROM e",
    "provenance_counts": _CONFORMED + ", " + _ENRICHED + ", f AS (SELECT 'email' AS field, CASE WHEN email IS NULL AND site THEN 'website' END AS origin FROM e UNION ALL SELECT 'phone', CASE WHEN phone IS NULL AND site THEN 'website' END FROM e UNION ALL SELECT 'owner_name', owner_from FROM e UNION ALL SELECT 'owner_title', CASE WHEN owner_title IS NOT NULL THEN 'website' END FROM e "
    "UNION ALL SELECT 'year_founded', CASE WHEN site THEN 'website' END FROM e UNION ALL SELECT 'employees', employees_from FROM e UNION ALL SELECT 'revenue', CASE WHEN revenue IS NOT NULL THEN 'estimate' END FROM e) SELECT field, origin, count(*) AS n FROM f WHERE origin IS NOT NULL GROUP BY field, origin",
    "late_upsert": _CONFORMED + ", " + _ENRICHED + ", l AS (SELECT *, 'valid' AS email_status, 'valid' AS phone_status, 'alive' AS website_status, CASE WHEN site OR model AND k % 3 = 0 THEN 'Family-owned' END AS signal, NULL AS rating, NULL AS review_count FROM e) "
    f"SELECT row, owner_name, owner_title, owner_from, employees, revenue, revenue IS NOT NULL AS revenue_estimated, CAST({' + '.join(_LATE_POINTS.values())} AS BIGINT) AS score FROM l",
    "combined_text": _TEXTS + ", o AS (SELECT domain, substr(string_agg('# ' || url || chr(10) || title || chr(10) || '' || chr(10) || text, chr(10) || chr(10) ORDER BY page_seq), 1, 7000) AS t FROM t GROUP BY domain) SELECT domain, length(t) AS n, sha256(t) AS digest FROM o",
    "page_text": _page_text_sql(),
    "site_socials": f"SELECT DISTINCT domain, 'https://facebook.com/first' AS facebook, 'https://www.linkedin.com/company/q' AS linkedin, 'https://x.com/z' AS x, NULL::VARCHAR AS yelp FROM ({SQL['site_pages']})",
    "observation_states": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'unknown' WHEN c_custkey % 3 > 0 THEN 'yes' ELSE 'no' END ELSE CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 7 = 0 THEN 'dead' WHEN (c_custkey % 5 + 1) * 100 < 500 THEN 'alive' ELSE 'dead' END END AS status FROM customer",
    "source_filter": "SELECT c_custkey::BIGINT AS id FROM customer WHERE c_custkey % 3 IN (0, 1)",
    "lead_lookup": _scored(_HOME) + "SELECT id, company_name, tier FROM scored WHERE id = 42",
    "name_distances": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein(c_mktsegment, 'BUILDINGS')::DOUBLE / greatest(length(c_mktsegment), 9) END AS similarity, "
    "CASE WHEN c_custkey % 40 < 2 THEN '$' || c_custkey % 40 * 500 || 'K' WHEN c_custkey % 2 = 0 THEN '$' || (c_custkey % 40) // 2 || 'M' ELSE '$' || (c_custkey % 40) // 2 || '.5M' END AS money FROM customer",
}
