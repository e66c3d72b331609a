"""The registered queries against their SQL twins at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from leadweave.plans import registry

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    def cell(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([cell(r[k]) for k in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["norm_names", "norm_phones", "email_rules", "score_points", "links_phone", "links_name", "clusters_all", "validate_email", "ttl_asof", "summary", "site_rollup", "model_facts", "union_clusters", "csv_conform", "csv_rejects", "late_upsert", "page_text", "gap_fill", "site_socials"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_entry_has_no_strays():
    assert set(entry.oracle_sql()) <= set(entry.queries())
