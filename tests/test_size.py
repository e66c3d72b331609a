"""What keeps work in proportion to the input: costly steps run on all cores, once, and ask only for what can be found."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.llm import positional
from leadweave.operators import components, link, validate
from leadweave.plans import facts, more, queries
from leadweave.storage import materialise

D = "/root/testdata/sf0.001"


def test_trimming_knows_all_white_space(spark):
    spaces = [c for c in map(chr, range(0xFFFF)) if re.fullmatch("[\\s\\x0b\\ufeff]", c) and c not in "\x1c\x1d\x1e\x1f\x85"]
    assert sorted(T.SPACES) == sorted(spaces)
    told = [(None, None, None), ("", "", ""), (" ", "", ""), ("a \x85", "a \x85", "a \x85")]
    told += [(f"{c}a{c} {c}b{c}{c}", f"a{c} {c}b", "a b") for c in spaces]
    x = spark.createDataFrame(told, "s string, trimmed string, collapsed string")
    wrong = x.filter(~T.strip(F.col("s")).eqNullSafe(F.col("trimmed")) | ~T.collapse(F.col("s")).eqNullSafe(F.col("collapsed")))
    assert wrong.count() == 0


def test_leads_pages_and_listings_are_conformed_by_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for df in (queries.leads(spark, D), facts.page_facts(spark, D), facts.places_to_leads(spark, D)):
        assert df.rdd.getNumPartitions() == cores


def test_only_places_that_names_are_joined_on_are_asked_for(spark):
    words = [f"{i * 7919 % 100_003:05d}{i * 104_729 % 99_991:05d} heating" for i in range(300)]
    table = materialise(spark.createDataFrame([(i, "x", w) for i, w in enumerate(words)], "name long, city string, norm_name string"))
    for small in (True, False):
        assert "LeftSemi" in link.candidate_pairs(table, small=small)._jdf.queryExecution().optimizedPlan().toString()


def test_observations_are_looked_up_from_rows_written_once(spark):
    asked, seen = queries._keys(spark, D), queries.fixture(spark, D, "observations")
    assert all("asked-" in f for f in asked.inputFiles())
    assert all("asked-seen-" in f for f in validate.latest_observation(asked, seen).inputFiles())


def test_site_facts_are_worked_out_once(spark):
    assert all("/sites-" in f for f in more._site_models(spark, D)[0].inputFiles())


@pytest.mark.parametrize("few", [True, False])
def test_rounds_of_components_are_short_plans(spark, monkeypatch, few):
    """The driver holds the plan of each round and the states of its tasks, so that neither may pile up."""
    rng = random.Random(11)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, k) for k in range(900, 1100)]
    links += [(k, k + 1) for k in range(2000, 2030)] + [(2005, 2004), (950, 2010), (5000, 5000), (7, 7), (None, 1)]
    parent = {x: x for e in links if None not in e for x in e}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    table, plans = materialise(spark.createDataFrame(links, "src long, dst long")), []
    for name, value in (("HUB_LINKS", 6), ("HUBS", 30), *([] if few else [("FEW_NODES", 0)])):
        monkeypatch.setattr(components, name, value, raising=False)
    monkeypatch.setattr(components, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialise(df, name))
    assert {r.node: r.component for r in components.connected_components(table).collect()} == parent
    assert max(p.count("Exchange") for p in plans) <= 12


def test_no_task_holds_much_of_the_index(spark, monkeypatch):
    """What a writer or reader of the index holds of it is a row group, whatever the size of its file."""
    held = 1 << 16
    for name, value in (("HELD_BYTES", held), ("SEGMENT_BYTES", 1 << 12)):
        monkeypatch.setattr(positional, name, value, raising=False)
    rng = random.Random(7)
    texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for i in range(2000)]
    index = positional.positional_index(spark.createDataFrame(texts, "doc_id long, text string"))
    groups = [m.row_group(k).total_byte_size for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) > 8 * held and max(groups) < 2 * held
    assert positional.indexed_documents(index).filter("n_words = 100").count() == 2000


def test_hits_are_shuffled_without_a_table_of_their_own(spark, monkeypatch):
    """Each file that a task writes forks the executor, which counts its memory twice meanwhile."""
    written = []
    monkeypatch.setattr(positional, "materialise", lambda df, name, *more: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or materialise(df, name, *more))
    d = spark.createDataFrame([(i, "a b c d" if i % 2 else "x") for i in range(20)], "doc_id long, text string")
    found = positional.contamination(d, spark.createDataFrame([(1, "b c"), (2, "d")], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in found.collect()) == [(i, 3 if i % 2 else 0, ("1", "2") if i % 2 else ()) for i in range(20)]
    over_index = [plan for _, plan in written if "MapInArrow" in plan and "postings" in plan]
    assert len(over_index) == 1 and "ObjectHashAggregate" in over_index[0]
