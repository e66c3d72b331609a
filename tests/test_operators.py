"""Linking, golden records, scoring, validation and enrichment on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from leadweave.operators import components, enrich, golden, link, pages, score, sites, validate
from leadweave.operators.components import connected_components
from leadweave.sources import files, listings
from leadweave.sources.leads import conform, map_columns, split_rejects, union_sources
from leadweave.storage import materialise, small_or_merge

COLUMNS = "row long, company_name string, website string, phone string, email string, city string"


def clusters(spark, rows):
    leads = conform(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS), "csv", 2026)
    found, links = link.cluster(leads)
    return leads, found, links, {r.row: r.cluster for r in found.collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if None not in (a, b):
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(1000, k) for k in range(900, 1100)] + [(1100 + k, 2000 + k % 7) for k in range(90)] + [(2003, 950), (3000, 3001), (3001, 3000)]
    table = spark.createDataFrame(edges, "src long, dst long")
    plain = {r.node: r.component for r in connected_components(table).collect()}
    made = []
    monkeypatch.setattr(components, "materialise", lambda df, name: made.append(df) or materialise(df, name))
    monkeypatch.setattr(components, "HUB_LINKS", 6)
    monkeypatch.setattr(components, "HUBS", 30)
    assert {r.node: r.component for r in connected_components(table).collect()} == plain
    assert all("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in made[1:-1])
    assert len(set(plain.values()) & set(range(900, 3001))) == 8


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_names(spark):
    rows = [("Copperline Electric", None, None, None, "Austin"), ("Coperline Electric", None, None, None, "austin "), ("Copperline Electric", None, None, None, "Dallas")]
    assert clusters(spark, rows)[3] == {0: 0, 1: 0, 2: 2}
    rows = [("Copperline Electric", "a.com", None, None, "Austin"), ("Coperline Electric", "b.com", None, None, "Austin")]
    assert clusters(spark, rows)[3] == {0: 0, 1: 1}


def test_fuzzy_join_loses_nothing(spark):
    """Against all pairs."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(3, 30))).strip() for _ in range(40)]
    names = base + [b[: (k := rng.randrange(len(b) + 1))] + rng.choice(["", "x", "yz"]) + b[k + rng.randrange(2) :] for b in base for _ in range(2)]
    names = list(dict.fromkeys(names))
    keys = spark.createDataFrame([(i, "c", n, None, None, None) for i, n in enumerate(names)], "row long, city string, norm_name string, domain string, phone_key string, email_key string")
    got = {(r.dst, r.src) for r in link.link_fuzzy(keys).collect()}
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and a and b and 1 - edits(a, b) / max(len(a), len(b)) >= 0.88}
    assert got == want


def test_fuzzy_components_are_those_of_all_pairs(spark):
    """Equal names, shared words, conflicts and ready components, against all pairs."""
    rng = random.Random(6)
    words = ["plumbing", "plumbing", "plumbing", "heating", "air"]
    names = [f"{rng.choice(['acme', 'acmo', 'bolt', 'bolts', 'crane'])}{rng.randrange(3)} {rng.choice(words)} {rng.choice(words)}" for _ in range(150)]
    rows = [(i, rng.choice("xy"), n, rng.choice([None, None, "a.com", "b.com"]), rng.choice([None, None, "1", "2"]), None) for i, n in enumerate(names)]
    rows += [(900, None, names[0], None, None, None), (901, "x", "", None, None, None)]
    keys = spark.createDataFrame(rows, "row long, city string, norm_name string, domain string, phone_key string, email_key string")
    differ = lambda a, b: a is not None and b is not None and a != b
    links = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] and b[2] and not differ(a[3], b[3]) and not differ(a[4], b[4]) and 1 - edits(a[2], b[2]) / max(len(a[2]), len(b[2])) >= 0.88:
                links.append((a[0], b[0]))
    label = {r[0]: r[0] for r in rows}
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    found = link.link_fuzzy(keys)
    assert {(r.dst, r.src) for r in found.collect()} <= set(links)
    got = {r.node: r.component for r in connected_components(found).collect()}
    assert {i: got.get(i, i) for i in label} == label and len(set(label.values())) < len(label) / 2


def named(spark, tmp_path, names):
    spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(names)], "name long, city string, norm_name string").write.parquet(f"{tmp_path}/names")
    return spark.read.parquet(f"{tmp_path}/names")


def test_similar_names_lose_nothing(spark, tmp_path):
    """Names of all lengths with random edits, shared words and few letters, against all pairs."""
    rng = random.Random(8)
    names = set()
    for k in range(60):
        letters = rng.choice(["ab", "abcde", "abcdefghijklmnopqrstuvwxyz0123456789 "])
        base = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 9, 17, 25, 40, 70]))) + rng.choice(["", " heating cooling", " plumbing", "é"])
        for _ in range(5):
            edit = list(base)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(edit) + 1)
                edit[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "é"])
            names.add((rng.choice("xxy"), "".join(edit).strip() or "q"))
    names = sorted(names)
    want = {(i, j) for i in range(len(names)) for j in range(i) if names[i][0] == names[j][0] and 1 - edits(names[i][1], names[j][1]) / max(len(names[i][1]), len(names[j][1])) >= 0.88}
    assert len(want) > 100
    assert {(r.a, r.b) for r in link.similar_names(named(spark, tmp_path, names)).collect()} == want


def test_names_of_a_trade_give_few_candidates(spark, tmp_path):
    rng = random.Random(9)
    for k, suffix in enumerate((" heating cooling", " heating cooling services", " plumbing")):
        names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) + suffix for _ in range(1000)})
        table = named(spark, tmp_path / str(k), [("x", n) for n in names])
        assert link.candidate_pairs(table).distinct().count() < 0.02 * len(names) * (len(names) - 1)


def test_exact_keys(spark):
    rows = [("A", "x.com", None, None, None), ("B", "http://www.x.com/y", "(800) 555-0142", None, None), ("C", None, "(800) 555-0142", "info@q.com", None), ("D", None, None, "info@q.com", None)]
    assert clusters(spark, rows)[3] == {0: 0, 1: 0, 2: 2, 3: 3}


def test_golden_record(spark):
    rows = [("ACME PLUMBING", "acme.com", "(800) 555-0142", "info@acme.com", None), ("Acme Plumbing", "acme.com", "(512) 555-2671", "bob@acme.com", "Austin")]
    leads, found, links, _ = clusters(spark, rows)
    rows = golden.provenance(leads, found, link.matched_on(links))
    g = golden.attach_provenance(golden.golden_records(leads, found), rows).collect()[0]
    assert (g.company_name, g.phone, g.email, g.city, g.merged_count) == ("Acme Plumbing", "+15125552671", "bob@acme.com", "Austin", 2)
    assert [m.row for m in g.merged_from] == [0, 1] and g.merged_from[0].matched_on == ["domain"] and g.sources == ["csv"] and g.source_ids == []
    assert golden.attach_provenance(golden.golden_records(leads, found), rows, most=1).collect()[0].merged_from is None
    assert [(r.cluster, r.merged_count, r.row) for r in rows.orderBy("row").collect()] == [(0, 2, 0), (0, 2, 1)]


LEAD = "id int, company_name string, revenue double, revenue_estimated boolean, employees int, year_founded int, industry string, owner_name string, owner_title string, email_status string, phone_status string, website_status string, signals array<string>, rating double, review_count int"


def test_score(spark):
    ideal = (1, "A", 3e6, False, 20, 1990, "HVAC", "Bob", "Owner", "valid", "valid", "alive", [], None, None)
    empty = (2, "B", None, None, None, None, None, None, None, None, None, None, None, None, None)
    half = (3, "C", 3e6, True, 20, 1990, "HVAC", "Bob", "Owner", "valid", "valid", "alive", ["Hiring", "Family-owned"], 4.6, 80)
    df = spark.createDataFrame([ideal, empty, half], LEAD)
    got = {r.id: r for r in score.score(df, score.resolve_criteria(), 2026).collect()}
    assert got[1].score == 100 and got[1].tier == "A" and len(got[1].score_reasons) == 8
    assert got[2].score == 0 and got[2].tier == "C"
    got = {r.id: r for r in score.score(df, score.resolve_criteria(revenue_min=5_000_000), 2026).collect()}
    assert got[1].score_reasons[0].points == 13
    assert got[3].score == 98 and [x.key for x in got[3].score_reasons][-2:] == ["signals", "reputation"]
    assert all(r.score == max(0, min(100, sum(x.points for x in r.score_reasons))) for r in got.values())
    assert score.resolve_criteria("nothing") == score.resolve_criteria("home_services")


def test_robots_and_best_email(spark):
    p = spark.createDataFrame([("a.com", "https://a.com/about-us"), ("a.com", "https://a.com/x")], "domain string, url string")
    r = spark.createDataFrame([("a.com", "*", 0, "/about", False), ("a.com", "*", 1, "/about-us", True), ("a.com", "*", 2, "", False)], "domain string, agent string, rule_seq int, path string, allow boolean")
    assert all(x.allowed for x in sites.robots_allowed(p, r).collect())
    df = spark.createDataFrame([(["info@a.com", "bob@gmail.com", "jane@a.com"], "a.com")], "e array<string>, d string")
    assert df.select(sites.best_email(F.col("e"), F.col("d"))).first()[0] == "jane@a.com"


def test_page_facts(spark):
    html = '<html><head><title> T </title></head><body><h1>Our story</h1><p>Founded by Rick Alvarez, est. 1987.</p><a href="mailto:Bob%40x.com?s=1">m</a><a href="tel:(512) 555-2671">t</a><a href="https://facebook.com/q">f</a><script>a@b.com</script></body></html>'
    r = pages.extract_pages(spark.createDataFrame([("x.com", 0, "https://x.com/", html), ("x.com", 1, "u", None)], "domain string, page_seq int, url string, html string"), 2026).orderBy("page_seq").collect()
    assert (r[0].emails, r[0].phones, r[0].year_founded, r[0].owner_name, r[0].owner_title, r[0].title) == (["bob@x.com"], ["+15125552671"], 1987, "Rick Alvarez", "Founder", "T")
    assert r[0].socials == {"facebook": "https://facebook.com/q"} and r[1].text == ""


def test_validation(spark):
    df = spark.createDataFrame([("kelly@gmial.com", False, "yes"), ("a@mailinator.com", True, "yes"), ("info@x.com", False, "yes"), ("b@x.com", False, None), (None, False, None)], "email string, is_disposable boolean, mx string")
    got = [(r.email_status, r.email_suggestion) for r in validate.validate_email(df).collect()]
    assert got == [("invalid", "kelly@gmail.com"), ("invalid", None), ("risky", None), ("risky", None), ("missing", None)]


def test_model_replies(spark):
    r = spark.createDataFrame([("a", '```json {"year_founded":"1985","services":"AC"}```'), ("b", 'x {"employee_estimate":"12 people","services":["a","b"],"family_owned":"yes"}'), ("c", None)], "domain string, reply string")
    got = {x.domain: x for x in enrich.parse_model_replies(r).collect()}
    assert got["a"].year_founded == 1985 and got["a"].services == ["AC"] and got["b"].employee_estimate == 12 and got["b"].family_owned and got["c"].services == []


def test_sources(spark, tmp_path):
    found, rest = map_columns(["Business Name", "URL", "Telephone", "E-mail Address", "Town", "Annual Revenue", "Headcount", "Other"])
    assert found["company_name"] == "Business Name" and found["email"] == "E-mail Address" and rest == ["Other"]
    (tmp_path / "x.csv").write_text('Company; Phone \n"A; B";1\n;\n;2\n')
    df = files.read_leads_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(tuple(r) for r in df.select("row", "company_name", "phone").collect()) == [(0, "A; B", "1"), (1, None, "2")]
    good, bad = split_rejects(df)
    assert good.count() == 1 and [tuple(r) for r in bad.collect()] == [(3, "Missing company name")]
    found, _ = link.cluster(conform(good, "csv", 2026))
    assert [tuple(r) for r in found.collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        split_rejects(df.drop("company_name"))
    (tmp_path / "y.csv").write_text("a;b\n1;2\n1;2;3\n")
    assert [r[0] for r in files.parse_errors(spark, str(tmp_path / "y.csv"), ["a", "b"], sep=";").collect()] == ["1;2;3"]
    tags = spark.createDataFrame([("HVAC contractors",), ("General contractor",), ("Lawn care",)], "i string").select(F.array_join(listings.industry_tags(F.col("i")), ";")).collect()
    assert [t[0] for t in tags] == ["craft=hvac", "craft=builder;office=construction_company", "craft=gardener;shop=garden_centre;office=lawyer"]


def test_union_numbers_rows_anew(spark):
    a = conform(spark.createDataFrame([(0, "Alpha Works", None, None, None, "Austin"), (5, "Beta", None, None, None, None)], COLUMNS), "csv", 2026)
    b = conform(spark.createDataFrame([(0, "Totally Other", None, None, None, "Boston")], COLUMNS), "places", 2026).drop("linkedin")
    both = union_sources({"csv": a, "none": a.limit(0), "places": b})
    assert sorted((r.row, r.source, r.source_row) for r in both.collect()) == [(1, "csv", 0), (2, "csv", 5), (3, "places", 0)]
    assert sorted(tuple(r) for r in link.cluster(both)[0].collect()) == [(1, 1), (2, 2), (3, 3)]


def test_page_text_oddities(spark):
    pages_of = ["<script>var s='</style>';var secret=1</script>a<STYLE>b</style >c", "<div title='a>b'>x</div>y", "&#65;&#x42; &amp;lt; &#39;q&apos;&#0;", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(pages_of)], "i int, h string").orderBy("i").select(pages.page_text(F.coalesce("h", F.lit("")))).collect()]
    assert got == ["ac", "x y", "AB &lt; 'q'\ufffd", "", ""]
    links = spark.createDataFrame([("<a href='/a'>x</a><a class=b href=/c>y</a><A HREF=\"d?x=1&amp;y=2\">z</a><abbr href='no'>",)], "h string").select(pages.page_links(F.col("h"))).first()[0]
    assert links == ["/a", "/c", "d?x=1&y=2"]


def test_small_or_merge(spark):
    df = spark.range(5)
    assert "BroadcastHashJoin" in spark.range(9).join(small_or_merge(df, 5), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in spark.range(9).join(small_or_merge(df, 4), "id")._jdf.queryExecution().executedPlan().toString()
