"""Column expressions that turn raw contact values into comparable ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.storage import small_or_merge

#: White space of any script; the regular expression's own class holds ASCII only.
SPACE = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
#: The characters of that class. Trimming and translating them is several times as fast as the expression.
SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    """Trimmed, white space collapsed; blank, n/a and na are null."""
    return not_blank(collapse(c))


def collapse(c: Column) -> Column:
    """Trimmed, each stretch of white space one space."""
    s = F.translate(strip(c), SPACES, " " * len(SPACES))
    return F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " +", " ")).otherwise(s)


def not_blank(s: Column) -> Column:
    """Null for blank, n/a and na."""
    return F.when((s != "") & ~F.lower(s).isin("n/a", "na"), s)


def normalize_name(c: Column) -> Column:
    """The words that identify a business; empty if none."""
    # The patterns of initials and of what isn't a letter or digit.
    s = F.regexp_replace(F.lower(c), "&", " and ")
    s = F.regexp_replace(s, r"\b([a-z])\.(?=[a-z]\.)", "$1")
    s = F.regexp_replace(s, r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.isin(*rules.NAME_STOPWORDS))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def normalize_domain(c: Column) -> Column:
    """The bare domain of an URL, an address or a domain; else null."""
    return is_domain(host(c))


def host(c: Column) -> Column:
    """What stands where an URL or an address has its domain."""
    s = F.substring_index(F.lower(strip(c)), "@", -1)
    s = F.regexp_replace(F.regexp_replace(s, "^[a-z]+://", ""), r"^www[0-9]?\.", "")
    return F.regexp_extract(s, "^[^/?#:]*", 0)


def is_domain(s: Column) -> Column:
    return F.when(s.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), s)


def normalize_website(domain: Column) -> Column:
    return F.concat(F.lit("https://"), domain)


def _phone(raw: Column, digits: Column, local: Column) -> Column:
    """The struct of normalize_phone from the trimmed text, its digits, and those without a leading 1 of eleven."""
    foreign = raw.startswith("+") & ~raw.rlike(r"^\+[^0-9]*1")
    valid = F.when(foreign, F.length(digits).between(8, 15)).otherwise(local.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"))
    kind = F.when(F.substring(local, 1, 3).isin("800", "833", "844", "855", "866", "877", "888"), "TOLL_FREE").when(F.substring(local, 1, 3) == "900", "PREMIUM_RATE").otherwise("FIXED_LINE_OR_MOBILE")
    e164 = F.when(digits == "", None).when(foreign, F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+1"), local))
    national = F.when(valid & ~foreign, F.regexp_replace(local, r"^(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")).otherwise(raw)
    made = F.struct(raw.alias("raw"), e164.alias("e164"), national.alias("national"), valid.alias("valid"), F.when(valid & ~foreign, kind).alias("type"))
    return F.when((raw != "") & ~F.lower(raw).isin("n/a", "na"), made)


def _local(digits: Column) -> Column:
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def normalize_phone(c: Column) -> Column:
    """struct<raw, e164, national, valid, type>; null for blanks. North American unless it starts with another +code."""
    raw = strip(c)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return _phone(raw, digits, _local(digits))


def with_phone(df: DataFrame, column: str, out: str) -> DataFrame:
    """The rows with normalize_phone of a column, in steps, so that no expression is worked out again for each use."""
    df = df.withColumn("_raw", strip(F.col(column))).withColumn("_digits", F.regexp_replace("_raw", "[^0-9]", ""))
    df = df.withColumn("_local", _local(F.col("_digits")))
    return df.withColumn(out, _phone(F.col("_raw"), F.col("_digits"), F.col("_local"))).drop("_raw", "_digits", "_local")


def normalize_email(c: Column) -> Column:
    return blank_to_null(F.lower(strip(c)))


def parse_money(c: Column) -> Column:
    """Leading number with optional k, m or b, rounded half up."""
    s = F.regexp_replace(F.lower(strip(c)), r"[$,\s]", "")
    number = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)([kmb])?", 1)
    unit = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)([kmb])?", 2)
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.when(number != "", F.floor(number.cast("double") * scale + 0.5).cast("double"))


def parse_int_loose(c: Column) -> Column:
    """The only number, or the mean of the first two rounded half up."""
    runs = F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit("[0-9]+"), F.lit(0))
    a, b = F.get(runs, F.lit(0)).cast("double"), F.get(runs, F.lit(1)).cast("double")
    value = F.when(F.size(runs) >= 2, F.floor((a + b) / 2 + 0.5)).otherwise(a)
    return F.when(value < 2**31, value.cast("int"))


def parse_year(c: Column, as_of_year: int) -> Column:
    n = parse_int_loose(c)
    return F.when(n.between(1800, as_of_year), n)


# The pattern of an address.
EMAIL = r"(?i)^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def local_part(c: Column) -> Column:
    return F.lower(F.substring_index(c, "@", 1))


def domain_of(c: Column) -> Column:
    return F.lower(F.substring_index(c, "@", -1))


def email_syntax_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL) & ~F.contains(c, F.lit("..")) & (F.length(local_part(c)) <= 64), F.lit(False))


def is_role_email(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(local_part(c), "[._-]", "").isin(*rules.ROLE_LOCAL_PARTS), F.lit(False))


def is_free_provider(domain: Column) -> Column:
    return F.coalesce(domain.isin(*rules.FREE_PROVIDERS), F.lit(False))


def domain_typo_fix(domain: Column) -> Column:
    pairs = [F.lit(x) for kv in rules.DOMAIN_TYPOS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), domain)


#: Most disposable domains that are broadcast.
BROADCAST_DOMAINS = 100_000


def flag_disposable(df: DataFrame, domain_col: str, dimension: DataFrame) -> DataFrame:
    """Adds is_disposable: the domain or a parent of two labels or more is in the dimension table (domain)."""
    asked = df.select(F.col(domain_col).alias("_domain")).filter(F.col("_domain").isNotNull()).distinct()
    labels = F.split("_domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = asked.select("_domain", F.explode(suffixes).alias("domain"))
    hits = spread.join(small_or_merge(dimension.select("domain").distinct(), BROADCAST_DOMAINS), "domain", "left_semi").select("_domain").distinct().withColumn("_hit", F.lit(True))
    return df.join(hits.hint("merge"), F.col(domain_col) == F.col("_domain"), "left").withColumn("is_disposable", F.coalesce("_hit", F.lit(False))).drop("_domain", "_hit")


def name_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance by the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def fmt_money(c: Column) -> Column:
    """$2M, $2.5M or $750K."""
    whole = F.format_string("$%.0fM", c / 1e6)
    return F.when(c >= 1e6, F.when(c % 1e6 == 0, whole).otherwise(F.format_string("$%.1fM", c / 1e6))).otherwise(F.format_string("$%dK", F.floor(c / 1e3 + 0.5)))


def display_pct(part: Column, whole: Column) -> Column:
    """Whole per cent, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("int")


def display_years_since(year: Column, as_of_year: int) -> Column:
    return F.when(year > 0, F.lit(as_of_year) - year)


def display_phone(e164: Column) -> Column:
    """(512) 555-2671 for a North American number, else as it is."""
    return F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")


def estimate_revenue(industry: Column, employees: Column) -> Column:
    """Revenue by head of the first industry group that the text holds, to the nearest 10,000; null without heads."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(industry, F.lit(""))), F.lit(" "))
    per_head = None
    for keys, value in rules.REVENUE_PER_HEAD:
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(text, F.lit(k))
        per_head = F.when(hit, value) if per_head is None else per_head.when(hit, value)
    made = F.floor(employees * per_head.otherwise(rules.DEFAULT_REVENUE_PER_HEAD) / 10_000 + 0.5) * 10_000.0
    return F.when(employees > 0, made)
