"""Roll-up of page facts to sites, and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.operators.pages import SOCIALS


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Adds allowed to pages (domain, url) by rules (domain, agent, rule_seq, path, allow).

    Rules of the agent, else of `*`, count; the longest path that the page's begins with wins, the first of equals.
    A page's path is cut at the lengths that its domain's rules have, and what is cut off is looked up by its hash, so
    that the rows joined grow with the length of paths and not with the number of rules.
    """
    own = rules.filter(F.lower("agent").isin(agent.lower(), "*") & (F.col("path") != ""))
    named = own.filter(F.lower("agent") == agent.lower()).select("domain").distinct().withColumn("named", F.lit(True))
    own = own.join(named, "domain", "left").filter((F.lower("agent") == agent.lower()) | F.col("named").isNull())
    own = own.groupBy("domain", "path").agg(F.min_by("allow", "rule_seq").alias("allow"))
    lengths = own.groupBy("domain").agg(F.collect_set(F.length("path")).alias("lengths"))  # no more than the longest path
    asked = pages.select("domain", "url", F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1).alias("path")).join(lengths.hint("merge"), "domain")
    asked = asked.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).select("domain", "url", "n", F.expr("left(path, n)").alias("start"))
    asked = asked.withColumn("key", F.xxhash64("domain", "start"))
    own = own.select(F.xxhash64("domain", "path").alias("key"), F.col("domain").alias("of"), F.col("path").alias("rule"), "allow")
    found = asked.join(own.hint("merge"), (asked["key"] == own["key"]) & (F.col("domain") == F.col("of")) & (F.col("start") == F.col("rule")))
    found = found.groupBy("domain", "url").agg(F.max_by("allow", "n").alias("allow"))
    return pages.join(found.hint("merge"), ["domain", "url"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def best_email(emails: Column, domain: Column) -> Column:
    """A person's address on the site's domain, else a person's, else a shared inbox; the first of equals."""
    value = lambda e: F.when(T.is_role_email(e), 0).otherwise(3) + F.when(F.coalesce(T.domain_of(e).endswith(domain), F.lit(False)), 2).otherwise(0)
    return F.array_max(F.transform(emails, lambda e, i: F.struct(value(e).alias("value"), (-i).alias("at"), e.alias("email"))))["email"]


def rollup_sites(facts: DataFrame) -> DataFrame:
    """One row for each domain: everything in page order, the first of what there is one of, also of each kind of social link."""
    seq = F.col("page_seq")
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_seq", c))), lambda x: x[c]))).alias(c)
    link = lambda kind: F.struct(F.lit(kind).alias("k"), F.min_by(F.element_at("socials", kind), F.when(F.map_contains_key("socials", kind), seq)).alias("v"))
    socials = F.map_from_entries(F.filter(F.array(*[link(kind) for kind, _ in SOCIALS]), lambda x: x["v"].isNotNull())).alias("socials")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), seq)).alias(c)
    titled = F.min_by("owner_title", F.when(F.col("owner_name").isNotNull(), seq)).alias("owner_title")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page_seq", "url"))), lambda x: x["url"]).alias("pages")
    out = facts.groupBy("domain").agg(union("emails"), union("phones"), union("signals"), first("year_founded"), first("owner_name"), titled, first("employees"), pages, socials)
    return out.withColumn("best_email", best_email(F.col("emails"), F.col("domain")))


#: What a page adds to a combined text at least: marks and line breaks.
LEAST_PART = 5


def combined_text(facts: DataFrame, max_chars: int = 7000) -> DataFrame:
    """domain, text: the pages' addresses, titles, descriptions and texts in order (page_seq, url), cut at max_chars.

    Only the pages that reach into the first max_chars, told by a running sum of lengths, are gathered; and only as many
    as could are sorted, so that a domain of very many pages is as light as others.
    """
    one = F.concat(F.lit("# "), "url", F.lit("\n"), "title", F.lit("\n"), "meta", F.lit("\n"), "text")
    parts = facts.select("domain", "page_seq", "url", F.substring(one, 1, max_chars).alias("part")).filter("part IS NOT NULL")
    order = W.partitionBy("domain").orderBy("page_seq", "url")
    parts = parts.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max_chars // LEAST_PART + 1)
    before = F.sum(F.length("part") + 2).over(W.partitionBy("domain").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_chars)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("domain").agg(F.substring(joined, 1, max_chars).alias("text"))


def select_pages(candidates: DataFrame, allowed: DataFrame, max_extra: int = 3) -> DataFrame:
    """domain, url: the first distinct allowed sub-pages of the domain itself (allowed: domain, url, allowed)."""
    same = F.regexp_extract("url", "^[a-z]+://(?:www[0-9]?[.])?([^/?#:]+)", 1) == F.col("domain")
    firsts = candidates.filter(same).groupBy("domain", "url").agg(F.min("position").alias("position"))
    firsts = firsts.join(allowed.filter("NOT allowed").select("domain", "url").hint("merge"), ["domain", "url"], "left_anti")
    kept = firsts.groupBy("domain").agg(F.slice(F.sort_array(F.collect_list(F.struct("position", "url"))), 1, max_extra).alias("top"))
    return kept.select("domain", F.explode("top").alias("x")).select("domain", "x.url")


def crawl_counts(sites: DataFrame) -> DataFrame:
    """status, n: sites by how their crawl ended."""
    return sites.groupBy("status").agg(F.count("*").alias("n"))
