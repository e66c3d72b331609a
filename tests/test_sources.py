"""Sources, sinks, skewed look-ups, phone plans and late facts on small tables."""

from __future__ import annotations

import csv
import io
import itertools
import random
import re
import string

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from leadweave.operators import enrich, pages, phones, sites, validate
from leadweave.operators.link import link_statistics
from leadweave.plans import registry
from leadweave.sources import files, listings
from leadweave.sources.leads import load_sources, source_counts, split_rejects, union_sources
from leadweave.streaming import late


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split of a file has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "1")
    yield lambda size: spark.conf.set(names[0], size)
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("sep", [",", "|"])
def test_csv_with_line_breaks_is_read_alike_in_any_splits(spark, splits, tmp_path, sep):
    rng = random.Random(sep)
    files_of = []
    for k in range(2):
        cell = lambda: "".join(rng.choice(["a", "b", sep, '"', "\n", '\n"', " ", '""', f'x{sep}"y', '5" pipe']) for _ in range(rng.randrange(8)))
        rows = [[f"c{k}-{i}", cell(), cell()] for i in range(150)]
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep, lineterminator="\r\n" if k else "\n")
        w.writerow([" Company Name", "Website", "Odd"])
        w.writerows(rows)
        (tmp_path / f"{k}.csv").write_bytes(out.getvalue().encode())
        files_of += [[a, b.replace("\r\n", "\n"), c] for a, b, c in rows]
    for size in ("128m", "90"):
        splits(size)
        got = files.read_leads_csv(spark, str(tmp_path)).orderBy("row").collect()
        assert [[r.company_name, r.website or "", r.Odd or ""] for r in got] == files_of, size
        assert [r.row for r in got] == list(range(300))


def test_csv_quotes_within_fields_open_nothing(spark, splits, tmp_path):
    """A quote that isn't at the start of a field is a letter; one that isn't closed takes the rest of its file."""
    (tmp_path / "a.csv").write_text('name,url\nTom 5" pipe,a.com\nBob,b.com\n"open,c.com\nlast,d.com\n')
    (tmp_path / "b.csv").write_text("name,url\nAnn,e.com\n\n , \nname,url\n")
    for size in ("128m", "12"):
        splits(size)
        got = [r.company_name for r in files.read_leads_csv(spark, str(tmp_path)).orderBy("row").collect()]
        assert got[:2] == ['Tom 5" pipe', "Bob"] and got[-2:] == ["Ann", "name"] and got[2].startswith("open,c.com\nlast"), got
    (tmp_path / "c").mkdir()
    (tmp_path / "c/empty.csv").write_text("")
    assert files.read_leads_csv(spark, str(tmp_path / "c")).count() == 0


def test_plain_lines_are_read_without_a_shuffle_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company;Phone\nA;1\nB;2\n")
    for multiline in (True, False):
        assert [(r.company_name, r.phone) for r in files.read_leads_csv(spark, str(tmp_path), multiline=multiline).orderBy("row").collect()] == [("A", "1"), ("B", "2")]


def test_parse_errors_and_row_cap(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n1,2,3\n4\n5,6\n")
    bad = files.parse_errors(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted(r._corrupt for r in bad) == ["1,2,3", "4"] and len(files.parse_errors(spark, str(tmp_path), ["a", "b"], first=1).collect()) == 1
    assert files.check_rows(spark.range(3), 3).count() == 3 and files.check_rows(spark.range(3), None).count() == 3
    with pytest.raises(ValueError):
        files.check_rows(spark.range(4), 3)


def test_rejects_of_a_table_without_rows_or_names(spark):
    with pytest.raises(ValueError):
        split_rejects(spark.createDataFrame([], "row long, company_name string"))
    with pytest.raises(ValueError):
        split_rejects(spark.createDataFrame([(0, "x")], "row long, other string"))
    good, bad = split_rejects(spark.createDataFrame([(0, "A"), (1, " n/a ")], "row long, company_name string"))
    assert good.count() == 1 and [tuple(r) for r in bad.collect()] == [(3, "Missing company name")]


def test_sources_that_fail_or_are_empty(spark):
    t = "row long, company_name string"
    some, none = spark.createDataFrame([(1, "A"), (2, "B")], t), spark.createDataFrame([], t)
    late_failure = spark.createDataFrame([(1, "x")], t).withColumn("company_name", F.raise_error("broken while read").cast("string"))

    def missing():
        raise OSError("no connection")

    rows, status = load_sources({"a": some, "b": none, "c": missing, "d": late_failure, "e": some})
    told = {r.source: r for r in status.collect()}
    assert {k: r.n for k, r in told.items()} == {"a": 2, "b": 0, "c": 0, "d": 0, "e": 2}
    assert told["c"].error == "no connection" and "broken while read" in told["d"].error and told["b"].error is None
    assert [(r.row, r.source_row, r.company_name) for r in rows.orderBy("row").collect()] == [(1, 1, "A"), (2, 2, "B"), (3, 1, "A"), (4, 2, "B")]
    for sources in ({"b": none}, {"c": missing, "b": none}):
        with pytest.raises(ValueError, match="no connection" if "c" in sources else "no source"):
            load_sources(sources)
    with pytest.raises(ValueError):
        union_sources({})
    assert {(r.source, r.n) for r in source_counts(some.withColumn("source", F.lit("a")), ["a", "z"]).collect()} == {("a", 2), ("z", 0)}


def test_closed_listings_are_counted_and_searches_capped(spark):
    x = spark.createDataFrame([(f'{{"id":"{k}","businessStatus":"{"CLOSED_PERMANENTLY" if k % 2 else "OPERATIONAL"}"}}',) for k in range(9)], "json string")
    seen = Observation()
    assert listings.places_to_leads(x, skipped=seen).count() == 5 and seen.get["skipped"] == 4
    assert listings.places_to_leads(x, most=3).count() == 2


def test_area_search_reads_the_cells_of_its_box(spark, tmp_path):
    x = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 80 - 40).cast("double").alias("lat"), (F.col("id") % 170 - 85).cast("double").alias("lon"), F.create_map(F.lit("name"), F.lit("n"), F.lit("craft"), F.lit("plumber")).alias("tags"))
    x = x.unionByName(x.limit(1).withColumn("lat", F.lit(None).cast("double")))
    listings.save_elements(x, str(tmp_path / "cells"), 10.0)
    saved, box = spark.read.parquet(str(tmp_path / "cells")), (-12.0, 3.0, 7.5, 19.0)
    near = listings.elements_in(saved, box, 10.0)
    read = lambda df: df.select(F.input_file_name()).distinct().count()
    assert read(near) < read(saved) / 20
    assert "PartitionFilters: [isnotnull(cell_lat" in near._jdf.queryExecution().executedPlan().toString()
    ids = lambda e: [r.seq for r in listings.search_elements(e, ["craft=plumber"], None, box, 30).collect()]
    assert ids(near) == ids(x) and len(ids(x)) == 30


def test_subpages_of_all_kinds(spark):
    rows = [("a.com", "https://a.com/x/", ["/history", "our-story", "https://b.com/story?q=/about", "mailto:about@a.com", "#team", "/prices?about", "/MEET-us"])]
    got = pages.subpage_candidates(spark.createDataFrame(rows, "domain string, url string, links array<string>")).orderBy("position").collect()
    assert [(r.url, r.position) for r in got] == [("https://a.com/history", 0), ("https://a.com/x/our-story", 1), ("https://b.com/story?q=/about", 2), ("https://a.com/MEET-us", 6)]


def test_robots_by_longest_prefix(spark):
    rng = random.Random(3)
    path = lambda n: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randrange(n)))
    rule = [(rng.choice(["a.com", "b.com"]), rng.choice(["*", "Bot", "other"]), k, path(5) if k % 9 else "", rng.random() < 0.5) for k in range(80)]
    page = [(d, f"https://{d}{p}") for d in ("a.com", "b.com", "c.com") for p in [path(9) for _ in range(60)] + [""]]
    p, r = spark.createDataFrame(page, "domain string, url string"), spark.createDataFrame(rule, "domain string, agent string, rule_seq int, path string, allow boolean")
    for agent in ("bot", "*", "nobody"):
        def allowed(d, u):
            own = [x for x in rule if x[0] == d and x[1].lower() == agent] or [x for x in rule if x[0] == d and x[1] == "*"]
            hit = [x for x in own if x[3] and u.removeprefix(f"https://{d}").startswith(x[3])]
            return max(hit, key=lambda x: (len(x[3]), -x[2]))[4] if hit else True

        assert {(x.domain, x.url): x.allowed for x in sites.robots_allowed(p, r, agent).collect()} == {(d, u): allowed(d, u) for d, u in page}


def test_as_of_reuse_brute_force(spark):
    rng = random.Random(4)
    obs = [(rng.choice(["hot", "hot", "b", None]), rng.choice(["mx", "web"]), rng.choice([None, *range(0, 900_000, 7)]), rng.choice(["yes", "no", None])) for _ in range(400)]
    obs += [("hot", "mx", 500, o) for o in ("no", "yes", "no")]
    keys = [(k, rng.choice(["hot", "b", "c", None]), rng.choice(["mx", "web"]), rng.choice([None, *range(0, 1_000_000, 13)]), "old") for k in range(300)] + [(900, "hot", "mx", 500, "old")] * 2
    at = lambda c: F.timestamp_seconds(c)
    o = spark.createDataFrame(obs, "domain string, kind string, observed_at long, outcome string").withColumn("observed_at", at("observed_at"))
    k = spark.createDataFrame(keys, "row long, domain string, kind string, at long, outcome string").withColumn("at", at("at"))
    got = validate.latest_observation(k, o, 5)

    def last(d, kind, t):
        hit = [(x[2], x[3] is not None, x[3]) for x in obs if d is not None and t is not None and x[0] == d and x[1] == kind and x[2] is not None and t - 5 * 3600 <= x[2] <= t]
        return max(hit)[2] if hit else None

    assert sorted((r.row, r.outcome) for r in got.collect() if r.outcome) == sorted((x[0], v) for x in keys if (v := last(*x[1:4])))
    assert got.count() == len(keys) and validate.latest_observation(k.limit(0), o).count() == 0 and validate.latest_observation(k, o.limit(0)).filter("outcome IS NOT NULL").count() == 0


def test_combined_text_gathers_what_it_needs(spark):
    rows = [("hot.com", k, f"u{k}", "t", "m", "x" * (k % 50)) for k in range(3000)] + [("b.com", 2, "u", "", "", "second"), ("b.com", 1, "u", "", "", "f" * 9000), ("c.com", 1, None, "", "", "x")]
    facts = spark.createDataFrame(rows, "domain string, page_seq int, url string, title string, meta string, text string")
    one = lambda r: f"# {r[2]}\n{r[3]}\n{r[4]}\n{r[5]}"
    want = {d: "\n\n".join(one(r) for r in sorted(rows[:-1]) if r[0] == d)[:7000] for d in ("hot.com", "b.com")}
    assert {r.domain: r.text for r in sites.combined_text(facts).collect()} == want


def test_phones_by_longest_prefix(spark):
    rows = ["+44 7911 123456", "+44 (0)20 7946 0018", "0033 6 12 34 56 78", "+1 (800) 555-0142", "+1 512 555 2671", "+49 151 12345678", "+34 600 123 456", "512 555 2671", "+999 1", "+", None, "", "+44 7911", "tel +44"]
    x = spark.createDataFrame([(k, p) for k, p in enumerate(rows)], "id int, phone string")
    got = {r.id: r.phone_plan and (r.phone_plan.e164, r.phone_plan.country, r.phone_plan.type, r.phone_plan.valid) for r in phones.classify_phones(x, "phone", phones.phone_plan(spark)).collect()}
    assert [got[k] for k in range(8)] == [
        ("+447911123456", "GB", "MOBILE", True), ("+442079460018", "GB", "FIXED_LINE", True), ("+33612345678", "FR", "MOBILE", True), ("+18005550142", "US", "TOLL_FREE", True),
        ("+15125552671", "US", "FIXED_LINE_OR_MOBILE", True), ("+4915112345678", "DE", "MOBILE", True), ("+34600123456", "ES", "MOBILE", True), None,
    ]
    assert got[8] == ("+9991", None, None, False) and [got[k] for k in (9, 10, 11, 13)] == [None] * 4 and got[12] == ("+447911", "GB", None, False)


def test_disposable_domains_from_a_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Mail.Test\n\n# note\n bad.org \nbad.org\n")
    assert sorted(r.domain for r in validate.disposable_dimension(spark, str(tmp_path)).collect()) == ["bad.org", "mail.test"]


def test_saved_uploads(spark, tmp_path):
    path = str(tmp_path / "u")
    x = spark.createDataFrame([(k, k % 3) for k in range(9)], "id long, upload_id int")
    files.save_leads(x, path)
    files.save_leads(x.filter("id = 4"), path)
    assert sorted((r.id, r.upload_id) for r in spark.read.parquet(path).collect()) == [(0, 0), (2, 2), (3, 0), (4, 1), (5, 2), (6, 0), (8, 2)]
    assert files.delete_upload(spark.read.parquet(path), 0).count() == 4


def test_replayed_batches_change_nothing(spark, tmp_path):
    schema = "domain string, observed_at timestamp, employees int"
    batches = [[("a", 1, 10), ("a", 3, 11), ("b", 5, 1), (None, 9, 9)], [("a", 2, 99), ("c", 1, 7), ("c", 1, 8)], [("b", 6, 2), ("d", None, 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "domain string, t long, employees int").select("domain", F.timestamp_seconds("t").alias("observed_at"), "employees").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kind = spark.createDataFrame([], schema).schema
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = lambda at: sorted((r.domain, r.employees) for r in late.current_facts(spark, str(tmp_path / at), kind).collect())
    late.upsert_facts(stream(), str(tmp_path / "store"), str(tmp_path / "c1"), availableNow=True).awaitTermination()
    want = [("a", 11), ("b", 2), ("c", 8), ("d", 4)]
    assert state("store") == want
    late.upsert_facts(stream(), str(tmp_path / "store"), str(tmp_path / "c2"), availableNow=True).awaitTermination()  # all over again
    late.upsert_batch(str(tmp_path / "store"))(spark.createDataFrame([("c", None, 7)], schema).unionByName(spark.read.schema(kind).parquet(str(tmp_path / "store/batch=1"))), 1)
    assert state("store") == want
    late.compact(spark, str(tmp_path / "store"), kind, str(tmp_path / "new"))
    assert state("new") == want
    late.upsert_batch(str(tmp_path / "new"))(late.newest(spark.read.schema(kind).parquet(str(tmp_path / "in"))), 0)
    assert state("new") == want


def test_link_statistics_by_stage(spark):
    links = [(2, 1, "domain"), (3, 1, "domain"), (3, 2, "phone"), (5, 4, "phone"), (5, 1, "email"), (4, 2, "name"), (7, 6, "name"), (8, 3, "name")]
    got = link_statistics(spark.createDataFrame(links, "src long, dst long, reason string"))
    assert {r.stage: r.unions for r in got.collect()} == {"domain": 2, "phone": 1, "email": 1, "name": 2}


def test_candidates_skipped_by_the_cap(spark):
    leads = spark.range(30).select("id", F.lit(1).alias("upload_id"), F.col("id").cast("string").alias("domain"), F.col("id").alias("score"), F.lit(0).alias("review_count"))
    texts = leads.filter("id < 25").select("domain", F.repeat(F.lit("x"), 300).alias("text"))
    seen = Observation()
    assert enrich.model_candidates(leads, texts, k=10, skipped=seen).count() == 10 and seen.get["readable"] == 25


def test_replies_without_facts_say_so(spark):
    rows = [("a", '{"owner_name":"X"}', None), ("b", "sorry", None), ("c", None, "429"), ("d", '{"owner_name":"Y"}', "cut")]
    got = {r.domain: (r.owner_name, r.error) for r in enrich.parse_model_replies(spark.createDataFrame(rows, "domain string, reply string, error string")).collect()}
    assert got == {"a": ("X", None), "b": (None, "no JSON object in the reply"), "c": (None, "429"), "d": ("Y", "cut")}
    assert re.match("no JSON", enrich.parse_model_replies(spark.createDataFrame([("b", "")], "domain string, reply string")).first().error)


def _contacts(text):
    """Addresses and numbers of a text, by hand: the forms of a number one by one, an address from its @."""
    local, host, letters = string.ascii_letters + string.digits + "._%+-", string.ascii_letters + string.digits + ".-", string.ascii_letters
    numbers, at = set(), 0
    forms = ["".join(f) for f in itertools.product([a + b for a in ("+1", "1") for b in ("s", "")] + [""], ["(", ""], ["eDD"], [")", ""], ["s", ""], ["eDD"], ["s", ""], ["DDDD"])]
    fits = {"s": " .-", "e": "23456789", "D": string.digits}
    while at < len(text):
        for form in forms:
            end = at + len(form)
            clear = (at == 0 or text[at - 1] not in letters + string.digits) and (end >= len(text) or text[end] not in letters + string.digits)
            if end <= len(text) and clear and all(c in fits.get(f, f) for c, f in zip(text[at:end], form, strict=True)):
                numbers.add("".join(c for c in text[at:end] if c in string.digits)[-10:])
                at = end
                break
        else:
            at += 1
    addresses, begin = set(), 0
    for k, c in enumerate(text):
        if c != "@" or k < begin:
            continue
        a = k
        while a > begin and text[a - 1] in local:
            a -= 1
        b = k + 1
        while b < len(text) and text[b] in host:
            b += 1
        while b > k + 1 and not (text[k + 1 : b].rpartition(".")[1] and text[k + 1 : b].rpartition(".")[0] and len(text[k + 1 : b].rpartition(".")[2]) > 1 and all(x in letters for x in text[k + 1 : b].rpartition(".")[2])):
            b -= 1
        if a == k or b == k + 1:
            continue
        found, begin = text[a:b].lower(), b
        name, _, domain = found.partition("@")
        labels = domain.split(".")
        sound = all(x and len(x) < 64 and x[0] != "-" and x[-1] != "-" for x in labels) and len(name) <= 64 and ".." not in found and len(labels[-1]) > 1
        junk = found.endswith((".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")) or labels[0] in ("example", "domain", "email", "sentry", "wixpress", "sentry-next") or name in ("name", "your", "you", "user", "email")
        if sound and not junk:
            addresses.add(found)
    return len(addresses), len(numbers)


def test_document_contacts_brute_force(spark, tmp_path):
    rng = random.Random(11)
    bits = ["(512) 355-0142", "+1 512.355.0142", "1-800-555-0100", "512 155 0000", "5123550142", "x5123550142", "ann@firm.com", "Ann@Firm.com", "a..b@firm.com", "pic@2x.png", "you@firm.com", "b@example.com", "c@-firm.com", "d@firm", "e@x.co.uk", "@", "1", "-", " ", "  ", "(", "word", "."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += ["", None, "x" * 60_000 + " call 512-355-0199 or mail z@firm.com"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.emails, r.phones) for r in registry.QUERIES["document_contacts"](spark, str(tmp_path)).collect()}
    assert got == {k: _contacts(t or "") for k, t in enumerate(texts)}
    assert len(set(got.values())) > 10
