r"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: which trigrams every match must hold.
The index has a posting (trigram, doc_id) for each of the asked trigrams that a document holds. Postings are
intersected by document, the rules whose query holds are the document's candidates, and only these are run over
its text. Rules without mandatory trigrams run over every text.

A match that a rule's own condition (length, group) rejects is dropped after matching, so that it still covers
its characters. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.storage import materialise, small_or_merge

#: Most candidate documents whose ids and rule names are broadcast.
BROADCAST_CANDIDATES = 200_000
#: Most strings to which a run of literals, small classes and options is expanded.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind; the pattern; the characters that the whole match, or `group` of it, needs at least."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The base rules, in the order in which ties of start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}=*"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(op, arg) -> list[str] | None:
    """All strings that a small pattern element matches, lower case; None if too many or unknown."""
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return sorted({chr(a).lower() for _, a in arg})
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else [s for p in parts for s in p]
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner + [""] * (arg[0] == 0)
    return None


def _sequence_strings(items) -> list[str] | None:
    strings = [""]
    for op, arg in items:
        if (more := _strings(op, arg)) is None or len(strings) * len(more) > MAX_STRINGS:
            return None
        strings = [a + b for a, b in product(strings, more)]
    return strings


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over the list, OR over each inner list, AND over the trigrams of a set; [] if nothing is mandatory.

    Trigrams are of lower-cased ASCII: a document holds a trigram if its lower-cased text does. Literals beyond
    ASCII end a run, as their case may change length.
    """
    clauses: list[list[frozenset[str]]] = []
    run = [""]

    def flush() -> None:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(grams):  # a set that holds another one adds nothing to an OR
            clauses.append(sorted((g for g in grams if not any(x < g for x in grams)), key=sorted))

    for op, arg in sre_parser.parse(pattern):
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS and "".join(more).isascii():
            run = [a + b for a, b in product(run, more)]
            continue
        flush()
        run = more if more is not None and len(more) <= MAX_STRINGS and "".join(more).isascii() else [""]
    flush()
    return clauses


def asked_trigrams(rules=RULES) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for grams in clause for g in grams})


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over whole texts, written to shared storage."""
    # the lower-cased text is one subexpression of generated code, which array functions of a lambda would leave
    lower = F.lower(F.col("text"))
    held = F.concat_ws("\n", *[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in trigrams])
    # the outer form infers no filter on the list, which would be worked out twice
    rows = docs.select("doc_id", held.alias("held")).select("doc_id", F.explode_outer(F.split("held", "\n")).alias("trigram"))
    return materialise(rows.filter("trigram <> ''"), "trigrams")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, rules: the kinds whose trigram query the document's postings fulfil."""
    held = index.groupBy(F.col("doc_id").alias("candidate")).agg(F.collect_set("trigram").alias("held"))

    def holds(rule: Rule) -> Column:
        every = F.lit(True)
        for clause in trigram_query(rule.pattern):
            some = F.lit(False)
            for grams in clause:
                some = some | (F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in sorted(grams)]))) == len(grams))
            every = every & some
        return every

    asked = [r for r in rules if trigram_query(r.pattern)]
    kinds = F.filter(F.array(*[F.when(holds(r), F.lit(r.kind)) for r in asked]), lambda k: k.isNotNull())
    return held.select("candidate", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _lean(rule: Rule) -> str:
    """The pattern itself, or where a class is repeated up to the match's end, one that finds long enough matches only.

    A repeated class takes all that it can, so that where the match is too short, each later start in the same
    stretch gives a shorter one still.
    """
    if rule.group or not rule.pattern.endswith("]+") or rule.least < 2:
        return rule.pattern
    fixed = rule.pattern[: rule.pattern.rindex("[")]
    return f"{rule.pattern[:-1]}{{{rule.least - len(fixed)},}}" if not fixed or fixed.isalnum() else rule.pattern


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's leftmost non-overlapping matches that it accepts."""
    pattern = _lean(rule)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    # what lies before each match; the last piece, after all matches, meets null
    pieces = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    steps = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("value"))), pieces, lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        done = F.when(x["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), done.alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def _scanned(rows: DataFrame, rules) -> DataFrame:
    """Rows with doc_id and non-null text, and found: array<struct<start, rank, end, kind>>."""
    index = trigram_index(rows, asked_trigrams(rules))
    held = materialise(candidates(index, rules), "secret-candidates")
    rows = rows.join(small_or_merge(held, BROADCAST_CANDIDATES), F.col("doc_id").eqNullSafe(F.col("candidate")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.col("text").rlike(_lean(rule))
        parts.append(F.when(asked, matches(F.col("text"), rule, rank)).otherwise(none))
    return rows.withColumn("found", F.array_sort(F.concat(*parts))).drop("candidate", "kinds")


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text and found: array<struct<start, rank, end, kind>> sorted by start, then order of the rules.

    Null text counts as empty and holds nothing; a null doc_id is an id like any other; rows that share an id are
    scanned each by itself. Texts of any length are scanned whole. Only doc_id and text are read. An empty table gives an empty one.
    """
    return _scanned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents, all columns as they were, with the characters of every secret replaced by [KIND].

    Overlapping spans are replaced as one, under the kind of the first. Null text stays null. Texts of any length are
    scanned whole, repeated rows and ids each by itself; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _scanned(docs.select(whole.alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)

    def step(state, x):
        fresh = x["start"] >= state["at"]
        put = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, put).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(F.col("found"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    clean = F.when(F.size("found") > 0, clean).otherwise(F.col("row")["text"])
    return rows.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and offsets of the secrets in every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "found")
    base = F.filter("found", lambda x: x["rank"] < len(BASE_RULES))
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _oracle() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        group = f", {r.group}" if r.group else ""
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, i, length(m[i]) AS n, "
            f"list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS pos FROM ("
            f"SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, "
            f"regexp_extract_all(text, '{pattern}'{group}) AS v, regexp_split_to_array(text, '{pattern}') AS p FROM d) WHERE len(m) > 0) "
            f"WHERE length(v[i]) >= {r.least}"
        )
    listing = "coalesce(string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + n AS BIGINT), ',' ORDER BY pos, rank) {}, '')"
    base = listing.format(f"FILTER (WHERE rank < {len(BASE_RULES)})")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT d.doc_id, {counts}, sha256({base}) AS base_sha256, {listing.format('')} AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"
    )


ORACLE_SQL = _oracle()
