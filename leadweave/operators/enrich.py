"""Filling gaps of leads from site facts and model facts, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.operators import score

MODEL_FACTS = "owner_name string, owner_title string, year_founded string, employee_estimate string, family_owned string, ownership_signals string, summary string, services string, industry string, acquisition_notes string"
FILLED = ("email", "phone", "linkedin", "owner_name", "owner_title", "year_founded", "employees", "revenue")


def attach_facts(leads: DataFrame, sites: DataFrame, models: DataFrame) -> DataFrame:
    """Leads with structs `site` and `model` of their domain, null where there is none."""
    pack = lambda df, name: df.select("domain", F.struct(*[c for c in df.columns if c != "domain"]).alias(name))
    return leads.join(pack(sites, "site"), "domain", "left").join(pack(models, "model"), "domain", "left")


def _set(c: Column) -> Column:
    return T.blank_to_null(c.cast("string"))


def fill_gaps(df: DataFrame, late: bool = False) -> DataFrame:
    """Fills empty fields and adds provenance (map of field to website, ai or estimate).

    Owners come from the model before the site, years and head counts from the site before the model, titles only
    with the name. With `late`, an owner guessed from the website gives way to one that the model names.
    """
    s, m = F.col("site"), F.col("model")
    prior = F.coalesce("provenance", F.create_map().cast("map<string,string>")) if "provenance" in df.columns else F.create_map().cast("map<string,string>")
    df = df.withColumn("_prior", prior)
    if late:
        guessed = (F.element_at("_prior", "owner_name") == "website") & _set(m["owner_name"]).isNotNull()
        guessed = F.coalesce(guessed, F.lit(False))
        df = df.withColumn("owner_title", F.when(~guessed, F.col("owner_title"))).withColumn("owner_name", F.when(~guessed, F.col("owner_name")))
        df = df.withColumn("_prior", F.when(guessed, F.map_filter("_prior", lambda k, v: ~k.isin("owner_name", "owner_title"))).otherwise(F.col("_prior")))
    choices = {
        "email": ((s["best_email"], "website"),),
        "phone": ((F.get(s["phones"], F.lit(0)), "website"),),
        "linkedin": ((F.element_at(s["socials"], "linkedin"), "website"),),
        "owner_name": ((m["owner_name"], "ai"), (s["owner_name"], "website")),
        "year_founded": ((s["year_founded"], "website"), (m["year_founded"], "ai")),
        "employees": ((s["employees"], "website"), (m["employee_estimate"], "ai")),
    }
    values, origin = {}, {}
    for field, found in choices.items():
        have = _set(F.col(field))
        kind = df.schema[field].dataType
        values[field] = F.coalesce(F.when(have.isNotNull(), F.col(field)), *[_set(v).cast(kind) for v, _ in found])
        step = F.when(have.isNotNull(), F.element_at("_prior", field))
        for v, name in found:
            step = step.when(_set(v).isNotNull(), name)
        origin[field] = step
    empty = _set(F.col("owner_title")).isNull()
    took_ai, took_site = (_set(F.col("owner_name")).isNull() & _set(m["owner_name"]).isNotNull()), (_set(F.col("owner_name")).isNull() & _set(m["owner_name"]).isNull() & _set(s["owner_name"]).isNotNull())
    title = F.when(took_ai, _set(m["owner_title"])).when(took_site, _set(s["owner_title"]))
    values["owner_title"] = F.when(empty, title).otherwise(F.col("owner_title"))
    origin["owner_title"] = F.when(empty & title.isNotNull(), F.when(took_ai, "ai").otherwise("website")).when(~empty, F.element_at("_prior", "owner_title"))
    estimate = F.when(F.col("revenue").isNull(), T.estimate_revenue(F.col("industry"), values["employees"]))
    values["revenue"] = F.coalesce("revenue", estimate)
    origin["revenue"] = F.when(estimate.isNotNull(), "estimate").otherwise(F.element_at("_prior", "revenue"))
    estimated = estimate.isNotNull() | (F.coalesce("revenue_estimated", F.lit(False)) if "revenue_estimated" in df.columns else F.lit(False))
    made = F.map_from_arrays(F.array(*[F.lit(f) for f in FILLED]), F.array(*[origin[f] for f in FILLED]))
    return df.withColumns({**values, "revenue_estimated": estimated, "provenance": F.map_filter(made, lambda k, v: v.isNotNull())}).drop("_prior")


def merge_signals(*parts: Column) -> Column:
    """Signals of all parts, the first of those that differ only in case, punctuation or the words business and company."""
    every = F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    keys = F.transform(every, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "business|company", ""), "[^a-z]", ""))
    return F.filter(every, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def merge_socials(lead: Column, site: Column) -> Column:
    """Both maps, the lead's values first."""
    lead, site = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (lead, site))
    return F.map_concat(F.map_filter(site, lambda k, v: ~F.map_contains_key(lead, k)), lead)


def enrichment_record(df: DataFrame) -> DataFrame:
    """Adds enrichment to gap-filled leads with site and model: where fields come from, what was found, and errors."""
    empty = F.array().cast("array<string>")
    s, m = F.col("site"), F.col("model")
    said = lambda c, kind: c["error"].cast("string") if "error" in df.schema[kind].dataType.names else F.lit(None).cast("string")
    error, ai_error = said(s, "site"), said(m, "model")
    record = F.struct(
        F.col("provenance"), F.coalesce(s["pages"], empty).alias("pages_crawled"), F.coalesce(s["emails"], empty).alias("emails_found"), F.coalesce(s["phones"], empty).alias("phones_found"), F.coalesce(m["services"], empty).alias("services"),
        T.blank_to_null(m["industry"]).alias("ai_industry"), T.blank_to_null(m["acquisition_notes"]).alias("acquisition_notes"), error.alias("crawl_error"), ai_error.alias("ai_error"),
    )
    return df.withColumn("enrichment", record)


#: The columns of a stored lead that model facts may change.
UPDATABLE = ("owner_name", "owner_title", "year_founded", "employees", "revenue", "revenue_estimated", "signals", "ai_summary", "enrichment", "score", "tier", "score_reasons")


def upsert_enrichment(leads: DataFrame, sites: DataFrame, models: DataFrame, criteria, as_of_year: int) -> DataFrame:
    """Stored leads (domain, provenance, signals ...) after model facts came in: filled, merged and scored again.

    Leads of domains with model facts change in the columns of UPDATABLE and provenance, all others stay as they are.
    """
    asked = models.select("domain").distinct()
    known = leads.join(asked.hint("merge"), "domain", "left_semi")
    filled = enrichment_record(fill_gaps(attach_facts(known, sites, models), late=True))
    family = F.when(F.col("model")["family_owned"], F.array(F.lit("Family-owned")))
    made = filled.withColumn("signals", merge_signals(F.col("signals"), F.col("site")["signals"], F.col("model")["ownership_signals"], family)).withColumn("ai_summary", T.blank_to_null(F.col("model")["summary"]))
    made = score.score(made, criteria, as_of_year)
    changed = [c for c in (*UPDATABLE, "provenance") if c in made.columns]
    fresh = known.drop(*[c for c in changed if c in known.columns]).join(made.select("row", *changed).hint("merge"), "row")
    return leads.join(asked.hint("merge"), "domain", "left_anti").unionByName(fresh, allowMissingColumns=True)


def filled_counts(df: DataFrame) -> DataFrame:
    """field, origin, n of the filled fields."""
    return df.select(F.explode("provenance").alias("field", "origin")).groupBy("field", "origin").agg(F.count("*").alias("n"))


def model_candidates(leads: DataFrame, texts: DataFrame, k: int = 40, min_text: int = 200, skipped: Observation | None = None) -> DataFrame:
    """The first k leads of each upload whose site has more than min_text characters, by score, then reviews.

    skipped: counts, as `readable` in the same pass, the leads that were to choose from, before the cap; with
    the rows that come out, that tells how many the cap left out.
    """
    readable = leads.join(texts.filter(F.length("text") > min_text).select("domain"), "domain", "left_semi")
    if skipped is not None:
        readable = readable.observe(skipped, F.count(F.lit(1)).alias("readable"))
    by = W.partitionBy("upload_id").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("review_count"), "id")
    return readable.withColumn("pick", F.row_number().over(by)).filter(F.col("pick") <= k)


def parse_model_replies(replies: DataFrame) -> DataFrame:
    """domain and typed facts of replies (domain, reply): fences stripped, numbers found in text, scalars made lists.

    A reply without a JSON object gives nulls and empty lists, and an error; an `error` of the replies goes first.
    """
    body = F.regexp_extract(F.regexp_replace("reply", "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    given = F.col("error").cast("string") if "error" in replies.columns else F.lit(None).cast("string")
    error = F.coalesce(given, F.when(F.coalesce(body, F.lit("")) == "", "no JSON object in the reply"))
    x = replies.select("domain", F.from_json(F.when(body != "", body), MODEL_FACTS).alias("f"), error.alias("error"))
    text = lambda c: T.clean_text(F.col(f"f.{c}"))
    number = lambda c: F.regexp_extract(F.col(f"f.{c}"), "[0-9]+", 0).try_cast("int")

    def strings(c):
        v = F.col(f"f.{c}")
        return F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")).when(T.blank_to_null(v).isNotNull(), F.array(v)), F.array().cast("array<string>"))

    yes = F.lower(F.col("f.family_owned"))
    return x.select(
        "domain", text("owner_name").alias("owner_name"), text("owner_title").alias("owner_title"), number("year_founded").alias("year_founded"), number("employee_estimate").alias("employee_estimate"),
        F.when(yes.isin("true", "yes"), True).when(yes.isin("false", "no"), False).alias("family_owned"), strings("ownership_signals").alias("ownership_signals"), F.coalesce(text("summary"), F.lit("")).alias("summary"),
        strings("services").alias("services"), text("industry").alias("industry"), F.coalesce(text("acquisition_notes"), F.lit("")).alias("acquisition_notes"), "error",
    )


def context_rows(leads: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id, facts (JSON of the given fields) and prompt, for a model run elsewhere."""
    facts = F.to_json(F.struct(*fields))
    return leads.select("id", facts.alias("facts"), F.concat(F.lit("Use only these facts about the business: "), facts).alias("prompt"))
