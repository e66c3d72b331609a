"""Registered queries of the lead operators and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.functions import text as T
from leadweave.operators import golden, link, query, score, validate
from leadweave.operators.components import connected_components
from leadweave.plans.fixtures import SQL, fixture
from leadweave.sources.leads import conform
from leadweave.storage import materialise, spread

YEAR = 2026


def raw_leads(spark, d) -> DataFrame:
    return fixture(spark, d, "leads").withColumnRenamed("row_ord", "row")


def leads(spark, d) -> DataFrame:
    return conform(spread(raw_leads(spark, d), "row"), "csv", YEAR)


def scored_input(spark, d) -> DataFrame:
    x = fixture(spark, d, "scored_input")
    return x.withColumn("signals", F.when(F.col("signal").isNotNull(), F.array("signal")).otherwise(F.array().cast("array<string>")))


def scored(spark, d) -> DataFrame:
    return score.score(scored_input(spark, d), score.resolve_criteria("home_services"), YEAR)


def norm_names(spark, d):
    return raw_leads(spark, d).select("row", T.normalize_name(F.col("company_name")).alias("norm_name"), T.clean_text(F.col("company_name")).alias("name"))


def norm_domains(spark, d):
    x = raw_leads(spark, d)
    web = T.normalize_domain(F.col("website"))
    return x.select("row", web.alias("domain"), T.normalize_website(web).alias("url"), T.normalize_domain(F.col("email")).alias("email_domain"))


def norm_phones(spark, d):
    x = raw_leads(spark, d).select("row", T.normalize_phone(F.col("phone")).alias("p"))
    return x.select("row", "p.e164", "p.national", "p.valid", "p.type", T.display_phone(F.col("p.e164")).alias("shown"))


def parse_numbers(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    money = F.when(k % 3 == 0, F.concat(F.lit("$"), price)).when(k % 3 == 1, F.concat(price, F.lit("k"))).otherwise(F.concat(F.lit("about "), price))
    heads = F.concat((k % 50).cast("string"), F.lit("-"), (k % 50 + k % 7).cast("string"))
    year = F.concat(F.lit("Est. "), (F.lit(1790) + k % 260).cast("string"))
    return orders.select(k.alias("k"), T.parse_money(money).alias("money"), T.parse_int_loose(heads).cast("long").alias("heads"), T.parse_year(year, YEAR).cast("long").alias("year"))


def email_rules(spark, d):
    x = raw_leads(spark, d).select("row", T.normalize_email(F.col("email")).alias("email")).filter("email IS NOT NULL")
    x = T.flag_disposable(x.withColumn("domain", T.domain_of(F.col("email"))), "domain", validate.disposable_dimension(spark))
    e = F.col("email")
    return x.select("row", "email", T.email_syntax_ok(e).alias("ok"), T.is_role_email(e).alias("role"), T.is_free_provider(F.col("domain")).alias("free"), T.domain_typo_fix(F.col("domain")).alias("fix"), "is_disposable")


def revenue_estimate(spark, d):
    return fixture(spark, d, "scored_input").select("id", T.estimate_revenue(F.col("industry"), F.col("employees")).alias("estimate"))


def score_points(spark, d):
    made = score.points(score.resolve_criteria("home_services"), YEAR)
    return scored(spark, d).select("id", *[p.cast("long").alias(f"p_{k}") for k, p in made.items()], F.col("score").cast("long").alias("score"), "tier")


def score_reasons(spark, d):
    x = scored(spark, d).select("id", F.explode("score_reasons").alias("r"))
    keep = F.col("r.key").isin("employees", "age", "industry", "owner", "email", "phone", "website")
    return x.filter(keep).select("id", F.col("r.key").alias("key"), F.col("r.label").alias("label"), F.col("r.points").cast("long").alias("points"), F.col("r.max").cast("long").alias("most"))


def rescore(spark, d):
    c = score.resolve_criteria("b2b_services", revenue_min=500_000, target_industries=[" Plumbing ", "retail"])
    return score.score(scored_input(spark, d).filter("upload_id = 2"), c, YEAR).select("id", F.col("score").cast("long").alias("score"), "tier")


def _links(key, reason):
    def run(spark, d):
        return link.link_exact(link.link_keys(leads(spark, d)), key, reason).select("src", "dst")

    return run


def clusters_exact(spark, d):
    keys = materialise(link.link_keys(leads(spark, d)), "keys")
    found = None
    for key, reason in link.EXACT:
        e = link.link_exact(keys, key, reason)
        found = e if found is None else found.unionByName(e)
    parts = connected_components(found)
    return keys.select("row").join(parts.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("cluster"))


def links_name(spark, d):
    return link.link_fuzzy(materialise(link.link_keys(leads(spark, d)), "link-keys")).select("src", "dst")


def clusters_all(spark, d):
    return link.cluster(leads(spark, d))[0]


def golden_query(spark, d):
    rows = materialise(leads(spark, d), "leads")
    g = golden.golden_records(rows, link.cluster(rows)[0])
    return g.select("cluster", "company_name", "website", "phone", "email", "city", "industry", F.col("merged_count").cast("long").alias("merged_count"), F.array_join("sources", ";").alias("sources"))


def merge_provenance(spark, d):
    rows = materialise(leads(spark, d), "leads")
    return golden.provenance(rows, link.cluster(rows)[0]).filter("merged_count > 1").select("cluster", "row", "company_name", "email", "phone")


def dedup_stats(spark, d):
    return golden.dedup_summary(link.cluster(leads(spark, d))[0])


def validated(spark, d):
    x = leads(spark, d).withColumn("mail_domain", T.domain_of(F.col("email")))
    x = T.flag_disposable(x, "mail_domain", validate.disposable_dimension(spark))
    seen = fixture(spark, d, "observations").filter("kind = 'mx'").groupBy(F.col("domain").alias("mail_domain")).agg(F.max("outcome").alias("mx"))
    return validate.validate_email(x.join(seen, "mail_domain", "left"))


def validate_email(spark, d):
    return validated(spark, d).select("row", "email", "email_status", "email_reason", "email_suggestion")


def validate_phone(spark, d):
    return validate.validate_phone(leads(spark, d)).select("row", "phone_status", "phone_reason", "phone_type")


def validate_website(spark, d):
    seen = fixture(spark, d, "observations").filter("kind = 'web'").select("domain", F.when(F.col("outcome") == "yes", "alive").when(F.col("outcome") == "no", "dead").otherwise("unknown").alias("web"))
    pages = fixture(spark, d, "site_pages").groupBy("domain").agg(F.count("*").alias("pages_crawled"))
    x = leads(spark, d).join(seen, "domain", "left").join(pages, "domain", "left")
    return validate.validate_website(x).select("row", "website_status", "website_detail")


def _keys(spark, d):
    at = F.lit("2024-01-02 12:00:00").cast("timestamp")
    x = materialise(leads(spark, d).select("row", "domain"), "asked").filter("domain IS NOT NULL")
    return x.select("row", "domain", F.explode(F.array(F.lit("mx"), F.lit("web"))).alias("kind"), at.alias("at"))


def ttl_asof(spark, d):
    return validate.latest_observation(_keys(spark, d), fixture(spark, d, "observations")).select("row", "domain", "kind", "outcome")


def probe_backlog(spark, d):
    return validate.probe_backlog(_keys(spark, d), fixture(spark, d, "observations"))


def reuse_counts(spark, d):
    return validate.reuse_counts(_keys(spark, d), fixture(spark, d, "observations"))


def filter_search(spark, d):
    return query.filter_leads(scored(spark, d), tiers=("A", "B"), min_score=40, reachable=True, has_signals=True, industries=("HVAC", "Plumbing", "Lawn Care"), search="owner 1").select("id", F.col("score").cast("long").alias("score"))


def sort_page(spark, d):
    page, _ = query.page_leads(query.sort_leads(scored(spark, d), "revenue", descending=False), 3, 40)
    return page.select("id", "revenue", F.col("score").cast("long").alias("score"))


def summary(spark, d):
    return query.summary(scored(spark, d))


def industry_facets(spark, d):
    return query.industry_facets(scored(spark, d))


def status_facets(spark, d):
    return query.status_facets(scored(spark, d), "email_status")


def score_histogram(spark, d):
    return query.score_histogram(scored(spark, d))


def funnel(spark, d):
    rows = materialise(leads(spark, d), "leads")
    g = validate.validate_phone(golden.golden_records(rows, link.cluster(rows)[0]))
    g = g.withColumns({"email_status": F.when(T.email_syntax_ok(F.col("email")), "valid").otherwise("invalid"), "website_status": F.lit("unknown"), "owner_name": F.lit(None).cast("string"), "owner_title": F.lit(None).cast("string"), "signals": F.array().cast("array<string>"), "revenue_estimated": F.lit(False)})
    return query.funnel(score.score(g, score.resolve_criteria(), YEAR))


def recent_uploads(spark, d):
    x = scored(spark, d).groupBy("upload_id").agg(F.count("*").alias("n"), F.max("id").alias("created_at"))
    return query.recent_uploads(x, 3)


def pipeline_ranked(spark, d):
    """Leads to clusters to golden records, validated, scored and ranked: the flagship."""
    rows = materialise(leads(spark, d), "leads")
    g = golden.golden_records(rows, link.cluster(rows)[0])
    seen = fixture(spark, d, "observations").filter("kind = 'web'").select("domain", F.when(F.col("outcome") == "yes", "alive").when(F.col("outcome") == "no", "dead").otherwise("unknown").alias("web"))
    mx = fixture(spark, d, "observations").filter("kind = 'mx'").select(F.col("domain").alias("mail_domain"), F.col("outcome").alias("mx"))
    g = T.flag_disposable(g.withColumn("mail_domain", T.domain_of(F.col("email"))), "mail_domain", validate.disposable_dimension(spark))
    g = g.join(mx, "mail_domain", "left").join(seen, "domain", "left").withColumn("pages_crawled", F.lit(0))
    g = validate.validate_website(validate.validate_phone(validate.validate_email(g))).withColumns({"signals": F.array().cast("array<string>"), "revenue_estimated": F.lit(False)})
    out = query.ranked(score.score(g, score.resolve_criteria(), YEAR))
    return out.select("cluster", "company_name", F.col("score").cast("long").alias("score"), "tier", "email_status", "phone_status", "website_status")


QUERIES = {
    "norm_names": norm_names, "norm_domains": norm_domains, "norm_phones": norm_phones, "parse_numbers": parse_numbers, "email_rules": email_rules,
    "revenue_estimate": revenue_estimate, "score_points": score_points, "score_reasons": score_reasons, "rescore": rescore,
    "links_domain": _links("domain", "domain"), "links_phone": _links("phone_key", "phone"), "links_email": _links("email_key", "email"),
    "clusters_exact": clusters_exact, "links_name": links_name, "clusters_all": clusters_all, "golden_records": golden_query,
    "merge_provenance": merge_provenance, "dedup_stats": dedup_stats, "validate_email": validate_email, "validate_phone": validate_phone,
    "validate_website": validate_website, "ttl_asof": ttl_asof, "probe_backlog": probe_backlog, "reuse_counts": reuse_counts,
    "filter_search": filter_search, "sort_page": sort_page, "summary": summary, "industry_facets": industry_facets, "status_facets": status_facets,
    "score_histogram": score_histogram, "funnel": funnel, "recent_uploads": recent_uploads, "pipeline_ranked": pipeline_ranked,
}


# --- the same in SQL ---------------------------------------------------------------------------------------------


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_NAME = f"""array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(company_name), '&', ' and ', 'g'),
 '\\b([a-z])\\.([a-z])\\.([a-z])\\.', '\\1\\2\\3.', 'g'), '\\b([a-z])\\.([a-z])\\.', '\\1\\2.', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({_list(rules.NAME_STOPWORDS)})), ' ')"""


def _domain(c: str) -> str:
    s = f"regexp_extract(regexp_replace(regexp_replace(regexp_extract(lower(trim({c})), '[^@]*$'), '^[a-z]+://', ''), '^www[0-9]?\\.', ''), '^[^/?#:]*')"
    return f"CASE WHEN regexp_matches({s}, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN {s} END"


_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_LOCAL = f"CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN substr({_DIGITS}, 2) ELSE {_DIGITS} END"
_VALID = f"regexp_matches({_LOCAL}, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')"
_TYPE = f"CASE WHEN {_VALID} THEN CASE WHEN substr({_LOCAL},1,3) IN ('800','833','844','855','866','877','888') THEN 'TOLL_FREE' WHEN substr({_LOCAL},1,3) = '900' THEN 'PREMIUM_RATE' ELSE 'FIXED_LINE_OR_MOBILE' END END"
_NATIONAL = f"CASE WHEN {_VALID} THEN regexp_replace({_LOCAL}, '^([0-9]{{3}})([0-9]{{3}})([0-9]{{4}})$', '(\\1) \\2-\\3') ELSE phone END"
_EMAIL_OK = "(regexp_matches(email, '(?i)^[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$') AND email NOT LIKE '%..%' AND length(split_part(email,'@',1)) <= 64)"
_ROLE = f"(regexp_replace(split_part(email,'@',1), '[._-]', '', 'g') IN ({_list(rules.ROLE_LOCAL_PARTS)}))"
_MAIL_DOMAIN = "regexp_extract(email, '[^@]*$')"
_FIX = "CASE " + " ".join(f"WHEN {_MAIL_DOMAIN} = '{a}' THEN '{b}'" for a, b in rules.DOMAIN_TYPOS.items()) + " END"
_DISPOSABLE = "(" + " OR ".join(f"coalesce({_MAIL_DOMAIN} = '{d}' OR {_MAIL_DOMAIN} LIKE '%.{d}', FALSE)" for d in rules.DISPOSABLE_SEED) + ")"
_FREE = f"({_MAIL_DOMAIN} IN ({_list(rules.FREE_PROVIDERS)}))"


def _estimate(industry: str, employees: str) -> str:
    text = f"(' ' || lower(coalesce({industry}, '')) || ' ')"
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in keys) + f" THEN {v}" for keys, v in rules.REVENUE_PER_HEAD)
    return f"CASE WHEN {employees} > 0 THEN floor({employees} * (CASE {cases} ELSE {rules.DEFAULT_REVENUE_PER_HEAD} END) / 10000.0::DOUBLE + 0.5) * 10000.0::DOUBLE END"


def _points(c: score.Criteria) -> dict[str, str]:
    band = lambda col, lo, hi, w: f"CASE WHEN {col} IS NULL THEN 0 WHEN {col} BETWEEN {lo} AND {hi} THEN {w} WHEN {col} BETWEEN {lo * 0.5} AND {hi * 1.5} THEN {int(w / 2 + 0.5)} ELSE 0 END"
    has = lambda words: "(" + (" OR ".join(f"contains(lower(industry), '{w}')" for w in words) or "TRUE") + ")"
    reach = lambda col, good, half, w: f"CASE WHEN {col} = '{good}' THEN {w} WHEN {col} = '{half}' THEN {int(w * 0.4 + 0.5)} ELSE 0 END"
    return {
        "revenue": band("revenue", c.revenue_min, c.revenue_max, 25),
        "employees": band("employees", c.employees_min, c.employees_max, 15),
        "age": f"CASE WHEN coalesce(year_founded, 0) = 0 THEN 0 WHEN {YEAR} - year_founded >= {c.min_years} THEN 15 WHEN {YEAR} - year_founded >= {c.min_years / 2} THEN 8 ELSE 0 END",
        "industry": f"CASE WHEN industry IS NULL THEN 0 WHEN {has(c.excluded_industries)} THEN 0 WHEN {has(c.target_industries)} THEN 15 ELSE 5 END",
        "owner": f"CASE WHEN owner_name IS NULL THEN 0 WHEN regexp_matches(coalesce(owner_title, ''), '(?i){rules.OWNER_TITLES}') THEN 10 ELSE 5 END",
        "email": reach("email_status", "valid", "risky", 10),
        "phone": reach("phone_status", "valid", "risky", 5),
        "website": reach("website_status", "alive", "unknown", 5),
        "signals": f"CASE WHEN regexp_matches(coalesce(signal, ''), '(?i){rules.SUCCESSION}') THEN 5 ELSE 0 END",
        "reputation": "CASE WHEN rating >= 4.5 AND review_count >= 50 THEN 5 ELSE 0 END",
    }


def _scored(c: score.Criteria) -> str:
    p = _points(c)
    total = " + ".join(f"p_{k}" for k in p)
    return (
        f"{_with('scored_input')}, pts AS (SELECT *, {', '.join(f'CAST({v} AS BIGINT) AS p_{k}' for k, v in p.items())} FROM scored_input), "
        f"tot AS (SELECT *, greatest(0, least(100, {total})) AS score FROM pts), scored AS (SELECT *, CASE WHEN score >= 75 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS tier FROM tot) "
    )


_HOME = score.resolve_criteria("home_services")
_CONFORMED = (
    f"{_with('leads')}, base AS (SELECT row_ord AS row, true_id, company_name, {_NAME} AS norm_name, {_domain('website')} AS domain, phone, {_VALID} AS valid, {_TYPE} AS type, "
    f"CASE WHEN phone IS NOT NULL THEN '+1' || {_LOCAL} END AS e164, lower(trim(email)) AS email, lower(city) AS city, city AS shown_city, industry FROM leads), "
    f"keys AS (SELECT *, CASE WHEN valid AND type <> 'TOLL_FREE' THEN e164 END AS phone_key, CASE WHEN email LIKE '%@%' AND NOT {_ROLE} THEN email END AS email_key FROM base) "
)


def _exact(key: str) -> str:
    return f"SELECT row AS src, min(row) OVER (PARTITION BY {key}) AS dst FROM keys WHERE {key} IS NOT NULL QUALIFY src > dst"


_FUZZY = (
    "SELECT row AS src, min(row) OVER (PARTITION BY city, norm_name, domain, phone_key) AS dst FROM keys WHERE city IS NOT NULL AND norm_name <> '' QUALIFY src > dst UNION "
    "SELECT a.row AS src, b.row AS dst FROM (SELECT * FROM keys QUALIFY row = min(row) OVER (PARTITION BY city, norm_name, domain, phone_key)) a JOIN (SELECT * FROM keys QUALIFY row = min(row) OVER (PARTITION BY city, norm_name, domain, phone_key)) b ON a.city = b.city AND a.row > b.row AND a.norm_name <> '' AND b.norm_name <> '' "
    "WHERE NOT coalesce(a.domain <> b.domain, FALSE) AND NOT coalesce(a.phone_key <> b.phone_key, FALSE) "
    "AND 1 - levenshtein(a.norm_name, b.norm_name)::DOUBLE / greatest(length(a.norm_name), length(b.norm_name)) >= 0.88::DOUBLE"
)


def _clusters(fuzzy: bool) -> str:
    links = " UNION ".join(f"({_exact(k)})" for k in ("domain", "phone_key", "email_key"))
    if fuzzy:
        links += f" UNION ({_FUZZY})"
    return (
        _CONFORMED.replace("WITH ", "WITH RECURSIVE ", 1) + f", links AS ({links}), both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), "
        "walk(row, hop) AS (SELECT row, row FROM keys UNION SELECT w.row, b.dst FROM walk w JOIN both_ways b ON w.hop = b.src), "
        "clusters AS (SELECT row, min(hop) AS cluster FROM walk GROUP BY row) "
    )


_RANKED = (
    "ranked AS (SELECT k.*, cluster, row_number() OVER (PARTITION BY cluster ORDER BY -(CAST(company_name IS NOT NULL AS INT) + CAST(domain IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) + CAST(email IS NOT NULL AS INT) "
    "+ CAST(city IS NOT NULL AS INT) + CAST(industry IS NOT NULL AS INT)), k.row) AS rank FROM keys k JOIN clusters c ON k.row = c.row), "
    f"golden AS (SELECT cluster, coalesce(arg_min(company_name, rank) FILTER (WHERE company_name <> upper(company_name)), arg_min(company_name, rank)) AS company_name, "
    "arg_min('https://' || domain, rank) FILTER (WHERE domain IS NOT NULL) AS website, arg_min(domain, rank) FILTER (WHERE domain IS NOT NULL) AS domain, "
    "arg_min(e164, (CASE WHEN valid AND type <> 'TOLL_FREE' THEN 0 WHEN valid THEN 1 ELSE 2 END) * 1000 + rank) FILTER (WHERE phone IS NOT NULL) AS phone, "
    "arg_min(coalesce(type, ''), (CASE WHEN valid AND type <> 'TOLL_FREE' THEN 0 WHEN valid THEN 1 ELSE 2 END) * 1000 + rank) FILTER (WHERE phone IS NOT NULL) AS phone_type, "
    f"arg_min(email, CASE WHEN {_ROLE} THEN 1000 ELSE 0 END + rank) FILTER (WHERE email IS NOT NULL) AS email, "
    "arg_min(shown_city, rank) AS city, arg_min(industry, rank) AS industry, count(*) AS merged_count FROM ranked GROUP BY cluster) "
)
_OBS = "SELECT domain, kind, outcome FROM observations"
_EMAIL_CASE = (
    f"CASE WHEN email IS NULL THEN 'missing' WHEN NOT {_EMAIL_OK} THEN 'invalid' WHEN {_FIX} IS NOT NULL THEN 'invalid' WHEN {_DISPOSABLE} THEN 'invalid' WHEN mx = 'no' THEN 'invalid' "
    f"WHEN mx IS NULL OR mx <> 'yes' THEN 'risky' WHEN {_ROLE} THEN 'risky' ELSE 'valid' END"
)
_KEYS = "asked AS (SELECT row, domain, kind, TIMESTAMP '2024-01-02 12:00:00' AS due FROM keys, (SELECT 'mx' AS kind UNION ALL SELECT 'web') k WHERE domain IS NOT NULL), seen AS (SELECT a.row, a.domain, a.kind, arg_max(o.outcome, o.observed_at) AS outcome FROM asked a LEFT JOIN observations o ON a.domain = o.domain AND a.kind = o.kind AND o.observed_at <= a.due AND o.observed_at >= a.due - INTERVAL 24 HOUR GROUP BY ALL)"
_WITH_OBS = _CONFORMED.replace("base AS (SELECT row_ord", f"observations AS ({SQL['observations']}), base AS (SELECT row_ord", 1)
_B2B = score.resolve_criteria("b2b_services", revenue_min=500_000, target_industries=[" Plumbing ", "retail"])
_SUMMARY = ", ".join(
    ["count(*) AS total", "CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score"]
    + [f"count(*) FILTER (WHERE tier = '{t}') AS tier_{t.lower()}" for t in "ABC"]
    + [f"count(*) FILTER (WHERE {k}_status = '{v}') AS {k}_{v}" for k, vs in (("email", ("valid", "risky", "invalid", "missing")), ("phone", ("valid", "risky", "invalid", "missing")), ("website", ("alive", "dead", "unknown", "missing"))) for v in vs]
    + ["count(*) FILTER (WHERE email_status = 'valid' OR phone_status = 'valid') AS reachable", "count(owner_name) AS owner_known", "count(revenue) AS revenue_known", "count(*) FILTER (WHERE revenue_estimated) AS revenue_estimated", "count(signal) AS with_signals"]
)
_GOLDEN_SCORED = (
    _clusters(True).replace("base AS (SELECT row_ord", f"observations AS ({SQL['observations']}), base AS (SELECT row_ord", 1) + ", " + _RANKED + f", m AS (SELECT g.*, o.outcome AS mx, w.outcome AS web FROM golden g LEFT JOIN observations o ON o.kind = 'mx' AND o.domain = {_MAIL_DOMAIN} LEFT JOIN observations w ON w.kind = 'web' AND w.domain = g.domain), "
    f"v AS (SELECT *, {_EMAIL_CASE} AS email_status, CASE WHEN phone IS NULL THEN 'missing' WHEN phone_type = '' THEN 'invalid' WHEN phone_type = 'TOLL_FREE' THEN 'risky' ELSE 'valid' END AS phone_status, "
    "CASE WHEN domain IS NULL THEN 'missing' WHEN web = 'yes' THEN 'alive' WHEN web = 'no' THEN 'dead' ELSE 'unknown' END AS website_status FROM m), "
    + f"p AS (SELECT *, {_points(_HOME)['industry']} + {_points(_HOME)['email']} + {_points(_HOME)['phone']} + {_points(_HOME)['website']} AS score FROM v) "
)
_LABELS = {
    "employees": "CASE WHEN employees IS NULL THEN 'Headcount unknown' WHEN employees BETWEEN 5 AND 50 THEN employees || ' employees — real team, still owner-run' ELSE employees || ' employees (target 5–50)' END",
    "age": "CASE WHEN coalesce(year_founded, 0) = 0 THEN 'Founding year unknown' WHEN 2026 - year_founded >= 10 THEN (2026 - year_founded) || ' years in business — proven, durable' WHEN 2026 - year_founded >= 5 THEN (2026 - year_founded) || ' years in business (target 10+)' ELSE 'Only ' || (2026 - year_founded) || ' years in business' END",
    "industry": "CASE WHEN industry IS NULL THEN 'Industry unknown' WHEN industry = 'Software Startup' THEN industry || ' — outside acquisition thesis' WHEN p_industry = 15 THEN industry || ' — matches thesis' ELSE industry || ' — adjacent to thesis' END",
    "owner": "CASE WHEN owner_name IS NULL THEN 'Owner not identified' WHEN p_owner = 10 THEN 'Owner identified: ' || owner_name || ' (' || owner_title || ')' ELSE 'Contact known (' || owner_name || coalesce(', ' || owner_title, '') || ') — may not be owner' END",
    "email": "CASE email_status WHEN 'valid' THEN 'Verified email' WHEN 'risky' THEN 'Email reachable but risky' WHEN 'invalid' THEN 'Email invalid' WHEN 'missing' THEN 'No email' ELSE 'Email not checked' END",
    "phone": "CASE phone_status WHEN 'valid' THEN 'Direct phone line' WHEN 'risky' THEN 'Toll-free / shared line' WHEN 'invalid' THEN 'Phone invalid' WHEN 'missing' THEN 'No phone' ELSE 'Phone not checked' END",
    "website": "CASE website_status WHEN 'alive' THEN 'Website online' WHEN 'dead' THEN 'Website down — business may be closed' WHEN 'unknown' THEN 'Website not checked' WHEN 'missing' THEN 'No website' ELSE 'Website not checked' END",
}

ORACLE_SQL = {
    "norm_names": f"{_with('leads')} SELECT row_ord AS row, {_NAME} AS norm_name, company_name AS name FROM leads",
    "norm_domains": f"{_with('leads')} SELECT row_ord AS row, {_domain('website')} AS domain, 'https://' || {_domain('website')} AS url, {_domain('email')} AS email_domain FROM leads",
    "norm_phones": f"{_with('leads')} SELECT row_ord AS row, '+1' || {_LOCAL} AS e164, {_NATIONAL} AS national, {_VALID} AS valid, {_TYPE} AS type, CASE WHEN {_VALID} THEN {_NATIONAL} ELSE '+1' || {_LOCAL} END AS shown FROM leads",
    "parse_numbers": f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::DOUBLE WHEN o_orderkey % 3 = 1 THEN floor(o_totalprice)::DOUBLE * 1000 END AS money, "
    f"CAST(floor((2 * (o_orderkey % 50) + o_orderkey % 7) / 2.0 + 0.5) AS BIGINT) AS heads, CASE WHEN 1790 + o_orderkey % 260 BETWEEN 1800 AND {YEAR} THEN 1790 + o_orderkey % 260 END AS year FROM orders",
    "email_rules": f"{_with('leads')}, e AS (SELECT row_ord AS row, lower(trim(email)) AS email FROM leads WHERE email IS NOT NULL) SELECT row, email, {_EMAIL_OK} AS ok, {_ROLE} AS role, {_FREE} AS free, {_FIX} AS fix, {_DISPOSABLE} AS is_disposable FROM e",
    "revenue_estimate": f"{_with('scored_input')} SELECT id, {_estimate('industry', 'employees')} AS estimate FROM scored_input",
    "score_points": _scored(_HOME) + f"SELECT id, {', '.join(f'p_{k}' for k in _points(_HOME))}, score, tier FROM scored",
    "score_reasons": _scored(_HOME) + " UNION ALL ".join(f"SELECT id, '{k}' AS key, {v} AS label, p_{k} AS points, CAST({rules.WEIGHTS[k]} AS BIGINT) AS most FROM scored" for k, v in _LABELS.items()),
    "rescore": _scored(_B2B) + "SELECT id, score, tier FROM scored WHERE upload_id = 2",
    "links_domain": _CONFORMED + _exact("domain"),
    "links_phone": _CONFORMED + _exact("phone_key"),
    "links_email": _CONFORMED + _exact("email_key"),
    "clusters_exact": _clusters(False) + "SELECT row, cluster FROM clusters",
    "links_name": _CONFORMED + _FUZZY,
    "clusters_all": _clusters(True) + "SELECT row, cluster FROM clusters",
    "golden_records": _clusters(True) + ", " + _RANKED + "SELECT cluster, company_name, website, phone, email, city, industry, merged_count, 'csv' AS sources FROM golden",
    "merge_provenance": _clusters(True) + "SELECT cluster, k.row, company_name, email, e164 AS phone FROM keys k JOIN clusters c ON k.row = c.row QUALIFY count(*) OVER (PARTITION BY cluster) > 1",
    "dedup_stats": _clusters(True) + ", s AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS input_rows, count(*) AS unique_rows, CAST(sum(n) - count(*) AS BIGINT) AS merged_rows, count(*) FILTER (WHERE n > 1) AS clusters_with_duplicates FROM s",
    "validate_email": _WITH_OBS + f", m AS (SELECT k.*, mx FROM keys k LEFT JOIN (SELECT domain AS md, max(outcome) AS mx FROM observations WHERE kind = 'mx' GROUP BY domain) o ON o.md = {_MAIL_DOMAIN}) "
    f"SELECT row, email, {_EMAIL_CASE} AS email_status, CASE WHEN email IS NULL THEN 'No email on record' WHEN NOT {_EMAIL_OK} THEN 'Malformed address' WHEN {_FIX} IS NOT NULL THEN 'Typo in domain — did you mean @' || {_FIX} || '?' "
    f"WHEN {_DISPOSABLE} THEN 'Disposable / temporary inbox' WHEN mx = 'no' THEN 'Domain has no mail server (no MX records)' WHEN mx IS NULL OR mx <> 'yes' THEN 'Couldn''t verify mail server (DNS timeout)' "
    f"WHEN {_ROLE} THEN 'Shared inbox (' || split_part(email,'@',1) || '@) — may not reach the owner' WHEN {_FREE} THEN 'Personal inbox (' || {_MAIL_DOMAIN} || ') — common for owner-operators' ELSE 'Business domain with active mail server' END AS email_reason, "
    f"CASE WHEN {_EMAIL_OK} AND {_FIX} IS NOT NULL THEN split_part(email,'@',1) || '@' || {_FIX} END AS email_suggestion FROM m",
    "validate_phone": _CONFORMED + "SELECT row, CASE WHEN phone IS NULL THEN 'missing' WHEN NOT valid THEN 'invalid' WHEN type = 'TOLL_FREE' THEN 'risky' ELSE 'valid' END AS phone_status, CASE WHEN phone IS NULL THEN 'No phone on record' WHEN NOT valid THEN 'Not a valid phone number' WHEN type = 'TOLL_FREE' THEN 'Toll-free line — usually a call center, not the owner' ELSE 'Direct line' END AS phone_reason, type AS phone_type FROM keys",
    "validate_website": _WITH_OBS + f", pages AS ({SQL['site_pages']}), n AS (SELECT domain, count(*) AS n FROM pages GROUP BY domain), o AS (SELECT domain, CASE outcome WHEN 'yes' THEN 'alive' WHEN 'no' THEN 'dead' ELSE 'unknown' END AS web FROM observations WHERE kind = 'web') "
    "SELECT row, CASE WHEN k.domain IS NULL THEN 'missing' WHEN n > 0 THEN 'alive' ELSE coalesce(web, 'unknown') END AS website_status, CASE WHEN n > 0 THEN 'Crawled ' || n || CASE WHEN n = 1 THEN ' page' ELSE ' pages' END ELSE web END AS website_detail FROM keys k LEFT JOIN n ON k.domain = n.domain LEFT JOIN o ON k.domain = o.domain",
    "ttl_asof": _WITH_OBS + f", {_KEYS} SELECT row, domain, kind, outcome FROM seen",
    "probe_backlog": _WITH_OBS + f", {_KEYS} SELECT domain, kind FROM seen GROUP BY domain, kind HAVING max(outcome) IS NULL",
    "reuse_counts": _WITH_OBS + f", {_KEYS} SELECT kind, count(DISTINCT domain) AS lookups, count(DISTINCT CASE WHEN outcome IS NOT NULL THEN domain END) AS hits FROM seen GROUP BY kind",
    "filter_search": _scored(_HOME) + "SELECT id, score FROM scored WHERE tier IN ('A', 'B') AND score >= 40 AND (email_status = 'valid' OR phone_status = 'valid') AND signal IS NOT NULL AND industry IN ('HVAC', 'Plumbing', 'Lawn Care') AND (lower(company_name) LIKE '%owner 1%' OR lower(owner_name) LIKE '%owner 1%')",
    "sort_page": _scored(_HOME) + "SELECT id, revenue, score FROM scored ORDER BY revenue ASC NULLS LAST, score DESC, company_name LIMIT 40 OFFSET 80",
    "summary": _scored(_HOME) + f"SELECT {_SUMMARY} FROM scored",
    "industry_facets": _scored(_HOME) + "SELECT industry, count(*) AS n FROM scored WHERE industry IS NOT NULL GROUP BY industry",
    "status_facets": _scored(_HOME) + "SELECT email_status, count(*) AS n FROM scored GROUP BY email_status",
    "score_histogram": _scored(_HOME) + "SELECT CAST(b AS INT) AS bucket, count(score) AS n FROM range(10) r(b) LEFT JOIN scored ON least(floor(score / 10.0), 9) = b GROUP BY b",
    "funnel": _clusters(True) + ", " + _RANKED + f", v AS (SELECT *, CASE WHEN coalesce({_EMAIL_OK}, FALSE) THEN 'valid' ELSE 'invalid' END AS email_status, CASE WHEN phone IS NULL THEN 'missing' WHEN phone_type = '' THEN 'invalid' WHEN phone_type = 'TOLL_FREE' THEN 'risky' ELSE 'valid' END AS phone_status, 'unknown' AS website_status FROM golden), "
    f"p AS (SELECT *, {_points(_HOME)['industry']} + {_points(_HOME)['email']} + {_points(_HOME)['phone']} + 2 AS score FROM v), t AS (SELECT CAST(sum(merged_count) AS BIGINT) AS a, count(*) AS b, count(*) FILTER (WHERE email_status = 'valid') AS c, count(*) FILTER (WHERE score >= 75) AS d FROM p), "
    "u AS (SELECT 1 AS step, 'rows' AS name, a AS n, a FROM t UNION ALL SELECT 2, 'unique', b, a FROM t UNION ALL SELECT 3, 'verified email', c, a FROM t UNION ALL SELECT 4, 'tier A', d, a FROM t) SELECT step, name, n, CAST(floor(n * 100.0 / a + 0.5) AS INT) AS pct FROM u",
    "recent_uploads": _scored(_HOME) + "SELECT upload_id, count(*) AS n, max(id) AS created_at FROM scored GROUP BY upload_id ORDER BY created_at DESC, upload_id DESC LIMIT 3",
    "pipeline_ranked": _GOLDEN_SCORED + "SELECT cluster, company_name, CAST(score AS BIGINT) AS score, CASE WHEN score >= 75 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS tier, email_status, phone_status, website_status FROM p",
}
