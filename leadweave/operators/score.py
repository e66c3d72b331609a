"""Explainable 0-100 score: points for each criterion, reasons and a tier."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.functions import text as T


@dataclass(frozen=True)
class Criteria:
    revenue_min: float
    revenue_max: float
    employees_min: int
    employees_max: int
    min_years: int
    target_industries: tuple[str, ...]
    excluded_industries: tuple[str, ...]


def resolve_criteria(preset: str | None = None, **overrides) -> Criteria:
    """A preset (home_services if unknown) with those overrides that aren't empty; lists are trimmed and lower-cased."""
    base = Criteria(**rules.PRESETS.get(preset or "", rules.PRESETS["home_services"]))
    given = {k: v for k, v in overrides.items() if v is not None and v != ""}
    for k in ("target_industries", "excluded_industries"):
        if k in given:
            given[k] = tuple(x.strip().lower() for x in given[k] if x.strip())
    return replace(base, **given)


def half_up(x: float) -> int:
    return int(x + 0.5)


def band_points(c: Column, low: float, high: float, weight: int) -> Column:
    """Full within the band, half within half its lower and one and a half its upper end."""
    return F.when(c.isNull(), 0).when(c.between(low, high), weight).when(c.between(low * 0.5, high * 1.5), half_up(weight / 2)).otherwise(0)


def _any(text: Column, words) -> Column:
    """Whether the text holds one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def points(c: Criteria, as_of_year: int) -> dict[str, Column]:
    """Points by criterion, over the columns of a validated lead."""
    w = rules.WEIGHTS
    years = F.lit(as_of_year) - F.col("year_founded")
    industry = F.lower(F.coalesce("industry", F.lit("")))
    target = _any(industry, c.target_industries) if c.target_industries else F.lit(True)
    titled = F.coalesce(F.col("owner_title").rlike(f"(?i){rules.OWNER_TITLES}"), F.lit(False))
    named = F.coalesce(F.col("owner_name") != "", F.lit(False))
    reach = lambda col, good, half, weight: F.when(F.col(col) == good, weight).when(F.col(col) == half, half_up(weight * 0.4)).otherwise(0)
    return {
        "revenue": band_points(F.col("revenue"), c.revenue_min, c.revenue_max, w["revenue"]),
        "employees": band_points(F.col("employees"), c.employees_min, c.employees_max, w["employees"]),
        "age": F.when(F.coalesce("year_founded", F.lit(0)) == 0, 0).when(years >= c.min_years, w["age"]).when(years >= c.min_years / 2, half_up(w["age"] / 2)).otherwise(0),
        "industry": F.when(industry == "", 0).when(_any(industry, c.excluded_industries), 0).when(target, w["industry"]).otherwise(half_up(w["industry"] / 3)),
        "owner": F.when(named & titled, w["owner"]).when(named, half_up(w["owner"] / 2)).otherwise(0),
        "email": reach("email_status", "valid", "risky", w["email"]),
        "phone": reach("phone_status", "valid", "risky", w["phone"]),
        "website": reach("website_status", "alive", "unknown", w["website"]),
        "signals": F.when(F.exists(F.coalesce("signals", F.array().cast("array<string>")), lambda s: s.rlike(f"(?i){rules.SUCCESSION}")), rules.BONUS["signals"]).otherwise(0),
        "reputation": F.when((F.col("rating") >= 4.5) & (F.col("review_count") >= 50), rules.BONUS["reputation"]).otherwise(0),
    }


def labels(c: Criteria, as_of_year: int) -> dict[str, Column]:
    """The text of each criterion's reason."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    money = lambda v: f"${v / 1e6:.0f}M" if v >= 1e6 and v % 1e6 == 0 else f"${v / 1e6:.1f}M" if v >= 1e6 else f"${half_up(v / 1e3)}K"
    band = f"target band ({money(c.revenue_min)}–{money(c.revenue_max)})"
    revenue, heads = F.col("revenue"), F.col("employees")
    shown = F.when(F.coalesce("revenue_estimated", F.lit(False)), text("Est. revenue ~", T.fmt_money(revenue), " (from headcount)")).otherwise(text("Revenue ", T.fmt_money(revenue)))
    years = (F.lit(as_of_year) - F.col("year_founded")).cast("string")
    whole_years = F.lit(as_of_year) - F.col("year_founded")
    industry = F.lower(F.coalesce("industry", F.lit("")))
    target = _any(industry, c.target_industries) if c.target_industries else F.lit(True)
    titled = F.coalesce(F.col("owner_title").rlike(f"(?i){rules.OWNER_TITLES}"), F.lit(False))
    named = F.coalesce(F.col("owner_name") != "", F.lit(False))
    choice = lambda col, values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(col)), F.lit(other))
    signal = F.get(F.filter(F.coalesce("signals", F.array().cast("array<string>")), lambda s: s.rlike(f"(?i){rules.SUCCESSION}")), F.lit(0))
    # The texts of reasons.
    return {
        "revenue": F.when(revenue.isNull(), "Revenue unknown").when(revenue.between(c.revenue_min, c.revenue_max), text(shown, " in ", band)).when(revenue < c.revenue_min, text(shown, " below ", band)).otherwise(text(shown, " above ", band)),
        "employees": F.when(heads.isNull(), "Headcount unknown").when(heads.between(c.employees_min, c.employees_max), text(heads.cast("string"), " employees — real team, still owner-run")).otherwise(text(heads.cast("string"), f" employees (target {c.employees_min}–{c.employees_max})")),
        "age": F.when(F.coalesce("year_founded", F.lit(0)) == 0, "Founding year unknown").when(whole_years >= c.min_years, text(years, " years in business — proven, durable")).when(whole_years >= c.min_years / 2, text(years, f" years in business (target {c.min_years}+)")).otherwise(text("Only ", years, " years in business")),
        "industry": F.when(industry == "", "Industry unknown").when(_any(industry, c.excluded_industries), text(F.col("industry"), " — outside acquisition thesis")).when(target, text(F.col("industry"), " — matches thesis")).otherwise(text(F.col("industry"), " — adjacent to thesis")),
        "owner": F.when(named & titled, text("Owner identified: ", F.col("owner_name"), " (", F.col("owner_title"), ")")).when(named, text("Contact known (", F.concat_ws(", ", "owner_name", T.blank_to_null(F.col("owner_title"))), ") — may not be owner")).otherwise("Owner not identified"),
        "email": choice("email_status", {"valid": "Verified email", "risky": "Email reachable but risky", "invalid": "Email invalid", "missing": "No email"}, "Email not checked"),
        "phone": choice("phone_status", {"valid": "Direct phone line", "risky": "Toll-free / shared line", "invalid": "Phone invalid", "missing": "No phone"}, "Phone not checked"),
        "website": choice("website_status", {"alive": "Website online", "dead": "Website down — business may be closed", "unknown": "Website not checked", "missing": "No website"}, "Website not checked"),
        "signals": text("Ownership signal: ", signal),
        "reputation": text("Strong reputation: ", F.col("rating").cast("string"), "★ from ", F.col("review_count").cast("string"), " reviews"),
    }


def score(df: DataFrame, criteria: Criteria, as_of_year: int) -> DataFrame:
    """Adds score (0 to 100), tier (A, B, C) and score_reasons: array<struct<key, label, points, max>>."""
    made, said = points(criteria, as_of_year), labels(criteria, as_of_year)
    total = F.lit(0)
    for p in made.values():
        total = total + p
    limits = rules.WEIGHTS | rules.BONUS
    reasons = []
    for k, p in made.items():
        reason = F.struct(F.lit(k).alias("key"), said[k].alias("label"), p.alias("points"), F.lit(limits[k]).alias("max"))
        reasons.append(F.when(p > 0, reason) if k in rules.BONUS else reason)
    value = F.greatest(F.lit(0), F.least(F.lit(100), total))
    out = df.withColumn("score", value).withColumn("score_reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("tier", F.when(F.col("score") >= rules.TIER_A, "A").when(F.col("score") >= rules.TIER_B, "B").otherwise("C"))
