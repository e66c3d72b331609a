"""Lead fixtures over the given tables, in SQL that Spark and DuckDB both accept (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "nation")

SQL = {
    "leads": """
WITH base AS (
  SELECT c_custkey AS k, n_name AS city, c_mktsegment AS seg, c_acctbal AS bal,
         md5(CAST(c_custkey AS STRING)) AS h
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v AS (
  SELECT k, city, seg, bal, h, 0 AS variant FROM base
  UNION ALL
  SELECT k, city, seg, bal, h, CAST(1 + CAST(k / 4 AS INT) % 4 AS INT) AS variant FROM base WHERE k % 4 = 0
)
SELECT CAST(k * 10 + variant AS BIGINT) AS row_ord, CAST(k AS BIGINT) AS true_id, variant,
  CASE variant WHEN 1 THEN upper(substr(h,1,12) || ' Plumbing L.L.C.')
               WHEN 3 THEN substr(h,1,3) || substr(h,5,8) || ' Plumbing Inc.'
               ELSE 'The ' || substr(h,1,12) || ' Plumbing LLC' END AS company_name,
  CASE WHEN variant IN (2,3,4) OR k % 5 = 4 THEN NULL
       WHEN variant = 1 THEN substr(h,1,12) || '.com/contact'
       ELSE 'HTTPS://www.' || substr(h,1,12) || '.com/about?x=1' END AS website,
  CASE WHEN variant IN (1,3,4) THEN NULL WHEN k % 11 = 3 THEN '(800) 555-0142' WHEN k % 13 = 5 THEN '12345'
       WHEN variant = 2 THEN '+1 512 3' || substr(CAST(100 + k % 90 AS STRING),2,2) || ' ' || lpad(CAST(k % 10000 AS STRING),4,'0')
       ELSE '(512) 3' || substr(CAST(100 + k % 90 AS STRING),2,2) || '-' || lpad(CAST(k % 10000 AS STRING),4,'0') END AS phone,
  CASE WHEN variant IN (1,2,3) THEN NULL WHEN k % 9 = 1 THEN 'info@' || substr(h,1,12) || '.com'
       WHEN k % 9 = 2 THEN 'o' || CAST(k AS STRING) || '@gmial.com' WHEN k % 9 = 3 THEN 'bad@@' || CAST(k AS STRING) || '.com'
       ELSE 'Own.' || CAST(k AS STRING) || '@gmail.com' END AS email,
  city, seg AS industry, bal
FROM v
""",
    "scored_input": """
SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS company_name, CAST(c_custkey % 5 AS INT) AS upload_id,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST((c_custkey % 200) * 100000 AS DOUBLE) END AS revenue,
  c_custkey % 10 = 8 AS revenue_estimated,
  CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE CAST(c_custkey % 80 AS INT) END AS employees,
  CASE WHEN c_custkey % 12 = 11 THEN NULL ELSE CAST(1960 + c_custkey % 66 AS INT) END AS year_founded,
  CASE c_custkey % 8 WHEN 0 THEN 'HVAC' WHEN 1 THEN 'Plumbing' WHEN 2 THEN 'Software Startup' WHEN 3 THEN 'Retail'
    WHEN 4 THEN 'Auto Repair' WHEN 5 THEN 'Commercial Cleaning' WHEN 6 THEN 'Lawn Care' ELSE NULL END AS industry,
  CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE 'Owner ' || CAST(c_custkey AS STRING) END AS owner_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Founder & Owner' WHEN 1 THEN 'Vice President' WHEN 2 THEN 'Office Manager' ELSE NULL END AS owner_title,
  CASE c_custkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'risky' WHEN 2 THEN 'invalid' WHEN 3 THEN 'missing' ELSE NULL END AS email_status,
  CASE c_custkey % 7 WHEN 0 THEN 'risky' WHEN 1 THEN 'invalid' WHEN 2 THEN 'missing' ELSE 'valid' END AS phone_status,
  CASE c_custkey % 4 WHEN 0 THEN 'alive' WHEN 1 THEN 'dead' WHEN 2 THEN 'unknown' ELSE 'missing' END AS website_status,
  CASE c_custkey % 3 WHEN 0 THEN 'Family-owned' WHEN 1 THEN 'Hiring' ELSE NULL END AS signal,
  CAST(35 + c_custkey % 16 AS DOUBLE) / 10 AS rating, CAST(c_custkey % 120 AS INT) AS review_count
FROM customer
""",
    "site_pages": """
WITH b AS (SELECT c_custkey AS k, substr(md5(CAST(c_custkey AS STRING)),1,12) AS h FROM customer WHERE c_custkey % 3 = 0)
SELECT h || '.com' AS domain, CAST(0 AS INT) AS page_seq, 'https://' || h || '.com/' AS url,
 '<html><head><title>Co ' || h || '</title></head><body><script>var a="x@y.com";</script><h1>Our story</h1><p>Family-owned and serving town since '
 || CAST(1950 + k % 60 AS STRING) || '.</p><a href="/about-us">About</a><a href="mailto:info@' || h || '.com">Mail</a></body></html>' AS html FROM b
UNION ALL
SELECT h || '.com', CAST(1 AS INT), 'https://' || h || '.com/about-us',
 '<html><body><p>Founded by ' || CASE k % 4 WHEN 0 THEN 'Rick Alvarez' WHEN 1 THEN 'Jane Doe' WHEN 2 THEN 'Meet Us Today' ELSE 'Mary Ann Smith' END
 || ', a second-generation business with a team of ' || CAST(1 + k % 40 AS STRING) || ' technicians.</p><p>rick@' || h || '.com or (512) 355-'
 || lpad(CAST(k % 10000 AS STRING),4,'0') || '</p></body></html>' FROM b
""",
    "robots_rules": """
SELECT substr(md5(CAST(c_custkey AS STRING)),1,12) || '.com' AS domain, '*' AS agent, CAST(r AS INT) AS rule_seq,
 CASE r WHEN 0 THEN '/about' ELSE '/about-us' END AS path, CASE WHEN r = 0 THEN FALSE ELSE c_custkey % 2 = 0 END AS allow
FROM customer CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 AS r) x WHERE c_custkey % 6 = 0
""",
    "observations": """
SELECT substr(md5(CAST(c_custkey AS STRING)),1,12) || '.com' AS domain, kind,
 CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (c_custkey % 48 + CASE kind WHEN 'mx' THEN 0 ELSE 1 END) * INTERVAL '1' HOUR AS observed_at,
 CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 7 = 1 THEN 'no' ELSE 'yes' END AS outcome
FROM customer CROSS JOIN (SELECT 'mx' AS kind UNION ALL SELECT 'web' AS kind) x WHERE c_custkey % 5 <> 4
""",
    "model_replies": """
SELECT substr(md5(CAST(c_custkey AS STRING)),1,12) || '.com' AS domain,
 CASE c_custkey % 3 WHEN 0 THEN '```json {"owner_name":"Ricardo Alvarez","year_founded":"1985","services":"AC repair","family_owned":"yes","summary":"S."}```'
  WHEN 1 THEN 'Sure: {"owner_name":"","employee_estimate":"12 people","services":["a","b"],"family_owned":false} ok' ELSE 'no json here' END AS reply
FROM customer WHERE c_custkey % 2 = 0
""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the Parquet tables of sf_dir."""
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(SQL[name])
