"""Links between rows of one business: exact keys, and similar names within a city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import rules
from leadweave.functions import text as T
from leadweave.operators.components import connected_components, grow_components
from leadweave.storage import materialise, small_or_merge


def usable_phone(phone: Column) -> Column:
    """The number, if it is valid and a business's own."""
    own = phone["valid"] & ~F.coalesce(phone["type"].isin("TOLL_FREE", "SHARED_COST"), F.lit(False))
    return F.when(own, phone["e164"])


def linkable_email(email: Column, require_valid: bool = False) -> Column:
    """An address that isn't a shared inbox; malformed ones count unless require_valid."""
    good = F.contains(email, F.lit("@")) & ~T.is_role_email(email)
    return F.when(good & T.email_syntax_ok(email) if require_valid else good, email)


def link_keys(leads: DataFrame, require_valid_email: bool = False) -> DataFrame:
    """row, city, norm_name, domain, phone_key, email_key of conformed leads."""
    city = T.blank_to_null(F.lower(T.strip(F.col("city"))))
    return leads.select("row", city.alias("city"), "norm_name", "domain", usable_phone(F.col("phone_parsed")).alias("phone_key"), linkable_email(F.col("email"), require_valid_email).alias("email_key"))


def link_exact(keys: DataFrame, key: str, reason: str) -> DataFrame:
    """src, dst, reason: every row of a key with the first row that holds it. Keys of one row give no link."""
    held = keys.filter(F.col(key).isNotNull()).select("row", F.col(key).alias("key"))
    first = held.groupBy("key").agg(F.min("row").alias("dst"), F.count("*").alias("n")).filter("n > 1")
    return held.join(first, "key").filter("row > dst").select(F.col("row").alias("src"), "dst", F.lit(reason).alias("reason"))


def conflicts(a: str, b: str) -> Column:
    """Both have domains that differ, or both have usable phones that differ."""
    differ = lambda k: F.coalesce(F.col(f"{a}.{k}") != F.col(f"{b}.{k}"), F.lit(False))
    return differ("domain") | differ("phone_key")


#: Segments of a coarse cut beyond those that the similarity needs; letters of a segment of a fine cut, and the longest name that gets one.
SPARE, FINE, FINE_NAME = 2, 2, 64
#: Most segments (some 40 bytes each) and most names and bytes of names, that are broadcast.
BROADCAST_SEGMENTS, BROADCAST_NAMES, BROADCAST_BYTES = 2_000_000, 200_000, 16 << 20
def _unary(first: str, last: str, bits: int, at: int) -> str:
    """Of a long s: the letter c, from `first` to `last`, counted once more in its own bits, of those from `at` on."""
    k, mask = f"({bits} * (ascii(c) - {ord(first)}) + {at})", (1 << bits) - 1
    return f"when c between '{first}' and '{last}' then s | shiftleft(2 * (shiftright(s, {k}) & {mask >> 1}L) + 1, {k})"


def signature(name: str) -> list[Column]:
    """Two longs that hold how often letters, spaces (up to three times each) and digits (up to twice) occur, in unary.

    An edit changes one letter or two counts by one, so the signatures of names that are k edits apart differ in 2 * k
    bits at most.
    """
    longs = (_unary("a", "u", 3, 0), f"{_unary('v', 'z', 3, 0)} {_unary(' ', ' ', 3, 15)} {_unary('0', '9', 2, 18)}")
    return [F.expr(f"aggregate(split({name}, ''), 0L, (s, c) -> case {x} else s end)").alias(f"letters_{k}") for k, x in enumerate(longs)]


def _cuts(df: DataFrame) -> DataFrame:
    """For a length lb that may differ in `edits` places: the numbers of segments of the cuts, coarse and fine."""
    fine = f"if(lb <= {FINE_NAME}, greatest(coarse, lb div {FINE}), coarse)"
    return df.withColumn("coarse", F.expr(f"least(lb, edits + 1 + {SPARE})")).withColumn("cuts", F.expr(f"array_distinct(array(coarse, {fine}))")).drop("coarse")


def _segments(df: DataFrame) -> DataFrame:
    """A row for each of `pieces` segments of a length lb: its number i, start p and width w."""
    df = df.withColumn("i", F.explode(F.expr("sequence(0, pieces - 1)"))).selectExpr("*", "lb div pieces AS base", "pieces - lb % pieces AS short")
    return df.selectExpr("*", "i * base + greatest(0, i - short) AS p", "base + int(i >= short) AS w").drop("base", "short")


def _key(piece: str) -> Column:
    return F.expr(f"xxhash64(city, lb, edits, pieces, i, {piece})")


#: Most places of segments (a long each) that are broadcast.
BROADCAST_SLOTS = 200_000
#: A segment's place: of which cut of which names it is.
SLOT = "xxhash64(city, lb, edits, pieces, i)"


def _edits(similarity: float) -> tuple[str, str]:
    """Places in which names may differ, of a length n: where it is the longer one, and where it is the shorter one at most."""
    return tuple(f"int(floor({x} * n + 1e-9))" for x in (1 - similarity, (1 - similarity) / similarity))


def _broadcastable(names: DataFrame, similarity: float) -> tuple[bool, bool]:
    """Whether the segments of all cuts, and the names, are few enough for a broadcast; a bound that nothing exceeds."""
    least, most = _edits(similarity)
    segments = F.expr(f"({most} - {least} + 1L) * (n div {FINE} + 2 * ({most} + 1 + {SPARE}))")
    size = names.withColumn("n", F.length("norm_name")).agg(F.count("*"), F.sum(F.octet_length("norm_name") + F.octet_length("city")), F.sum(segments)).first()
    return (size[2] or 0) <= BROADCAST_SEGMENTS, size[0] <= BROADCAST_NAMES and (size[1] or 0) <= BROADCAST_BYTES


def candidate_pairs(names: DataFrame, similarity: float = rules.NAME_SIMILARITY, small: bool | None = None) -> DataFrame:
    """a, b: pairs of written names (name, city, norm_name) among which all similar ones of a city are.

    The longer name a says how many places the two may differ in. A shorter one b is cut into more segments than that,
    coarse or fine, and any segment that no edit touches stands in a, at most so many places off. So it is enough to
    join on as many of b's rarest segments as there are edits, and one more (the partition-based join of PassJoin,
    VLDB 2011, with rare pieces preferred); each name takes the cut whose rarest segments are least common. Words that many
    names of a city share are thus not joined on unless a name has nearly nothing else. Pairs whose letter counts
    differ too much leave the join no more. Keys are hashed, so a pair may be of different cities, or come twice.
    """
    least, most = _edits(similarity)
    small = _broadcastable(names, similarity)[0] if small is None else small
    # a name gives some hundred rows, so few bytes of names are work for many tasks
    wide = names.repartition(names.sparkSession.sparkContext.defaultParallelism, "name")
    rows = wide.select("name", "city", "norm_name", F.length("norm_name").alias("n"), *signature("norm_name"))
    # the names as b: for each number of edits that some longer name allows
    have = _cuts(rows.withColumn("lb", F.col("n")).withColumn("edits", F.explode(F.expr(f"sequence({least}, {most})"))).filter("edits > 0"))
    have = _segments(have.withColumn("pieces", F.explode("cuts")))
    have = have.select("name", "edits", "pieces", "letters_0", "letters_1", _key("substring(norm_name, p + 1, w)").alias("key"), F.expr(SLOT).alias("slot"))
    often = have.groupBy("key").agg(F.count("*").alias("often"))
    kept = [F.first(f"letters_{k}").alias(f"letters_{k}") for k in range(2)]
    cut = have.join(F.broadcast(often) if small else often.hint("merge"), "key").groupBy("name", "edits", "pieces").agg(*kept, F.sort_array(F.collect_list(F.struct("often", "key", "slot"))).alias("keys"))
    cut = cut.withColumn("keys", F.expr("slice(keys, 1, edits + 1)")).withColumn("cost", F.expr("aggregate(keys, 0L, (s, k) -> s + k.often)"))
    best = cut.groupBy("name", "edits").agg(F.min_by(F.struct("letters_0", "letters_1", "keys"), F.struct("cost", "pieces")).alias("best"))
    rarest = best.select(F.col("name").alias("b"), F.col("best.letters_0").alias("of_b_0"), F.col("best.letters_1").alias("of_b_1"), F.explode("best.keys").alias("k")).select("*", "k.key", "k.slot").drop("k")
    rarest = materialise(rarest, "rarest")
    # and as a: all places where a segment of a shorter one can stand; |off| edits before it, the rest after
    ask = rows.withColumn("edits", F.expr(least)).filter("edits > 0").withColumn("lb", F.explode(F.expr("sequence(greatest(1, n - edits), n)")))
    ask = _segments(_cuts(ask).withColumn("pieces", F.explode("cuts"))).selectExpr("*", "greatest(0, p - (edits - n + lb) div 2) AS low", "least(n - w, p + (edits + n - lb) div 2) AS high")
    ask = ask.filter("low <= high")
    # places that no name is joined on, which are most, are not asked for
    slots = rarest.select("slot").distinct()
    if slots.limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS:
        ask = ask.join(F.broadcast(slots), F.expr(SLOT) == F.col("slot"), "left_semi")
    ask = ask.withColumn("s", F.explode(F.expr("sequence(low, high)")))
    ask = ask.select(F.col("name").alias("a"), "edits", "letters_0", "letters_1", _key("substring(norm_name, s + 1, w)").alias("key"))
    differ = sum((F.bit_count(F.col(f"letters_{k}").bitwiseXOR(F.col(f"of_b_{k}"))) for k in range(2)), F.lit(0))
    rarest = rarest.drop("slot")
    rarest = F.broadcast(rarest) if small else rarest.hint("merge")
    pairs = ask.join(rarest, (ask["key"] == rarest["key"]) & (F.col("a") != F.col("b")) & (differ <= 2 * F.col("edits")))
    return pairs.select("a", "b")


def similar_names(names: DataFrame, similarity: float = rules.NAME_SIMILARITY) -> DataFrame:
    """a, b: the pairs of written names (name, city, norm_name: not empty, no two alike) of a city that are similar.

    Nothing is lost; a > b. Only ids are joined to find candidates, names follow for those. A name of n letters is
    looked up in the cube of n / 8 ways or so, so names of many hundred letters are costly.
    """
    few_segments, few_names = _broadcastable(names, similarity)
    pairs = candidate_pairs(names, similarity, few_segments).distinct()
    text = names.select("name", "city", "norm_name")
    text = F.broadcast(text) if few_names else text.hint("merge")
    for k in ("a", "b"):
        pairs = pairs.join(text.toDF(k, f"city_{k}", f"name_{k}"), k)
    longest = F.greatest(F.length("name_a"), F.length("name_b"))
    most = F.floor((1 - similarity) * longest + 1e-9).cast("int")
    edits = F.levenshtein("name_a", "name_b")
    near = (F.col("city_a") == F.col("city_b")) & (F.abs(F.length("name_a") - F.length("name_b")) <= most) & (1 - edits / longest >= similarity)
    return pairs.filter(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def link_fuzzy(keys: DataFrame, parts: DataFrame | None = None, similarity: float = rules.NAME_SIMILARITY) -> DataFrame:
    """src, dst, reason: rows of one city with names of at least `similarity`, unless they conflict.

    Rows of one city, name, domain and phone are linked as a star with the first of them, which stands for them in all
    other links: conflicts depend on nothing else, so that components are those of all pairs. Rows of one component in
    `parts` (node, component) are linked already and left out.
    """
    rows = keys.filter("city IS NOT NULL AND norm_name <> ''").select("row", "city", "norm_name", "domain", "phone_key")
    if parts is not None:
        rows = rows.join(parts.withColumnRenamed("node", "row").hint("merge"), "row", "left")
    rows = materialise(rows.withColumn("part", F.coalesce("component", "row") if parts is not None else F.col("row")), "named")
    heads = rows.groupBy("city", "norm_name", "domain", "phone_key").agg(F.min(F.struct("row", "part")).alias("head"))
    names = materialise(heads.groupBy("city", "norm_name").agg(F.min("head.row").alias("name"), F.count("*").alias("heads")), "names")
    heads = heads.select("city", "norm_name", "domain", "phone_key", F.col("head.row").alias("row"), F.col("head.part").alias("part"))
    heads = materialise(heads.hint("merge").join(names.select("city", "norm_name", "name"), ["city", "norm_name"]), "heads")
    near = similar_names(names, similarity).unionByName(names.filter("heads > 1").select(F.col("name").alias("a"), F.col("name").alias("b")))
    near = materialise(near, "similar")
    side = lambda k, as_: heads.select(F.col("name").alias(k), F.struct("row", "part", "domain", "phone_key").alias(as_))
    pairs = near.hint("merge").join(side("a", "x"), "a").hint("merge").join(side("b", "y"), "b").select("x", "y")
    pairs = pairs.filter((F.col("x.row") != F.col("y.row")) & (F.col("x.part") != F.col("y.part")) & ~conflicts("x", "y"))
    pairs = pairs.select(F.greatest("x.row", "y.row").alias("src"), F.least("x.row", "y.row").alias("dst")).distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("city", "norm_name", "domain", "phone_key")]
    star = rows.alias("r").hint("merge").join(heads.alias("h"), same[0] & same[1] & same[2] & same[3])
    star = star.filter((F.col("r.row") != F.col("h.row")) & (F.col("r.part") != F.col("h.part"))).select(F.col("r.row").alias("src"), F.col("h.row").alias("dst"))
    return pairs.unionByName(star).withColumn("reason", F.lit("name"))


EXACT = (("domain", "domain"), ("phone_key", "phone"), ("email_key", "email"))


def cluster(leads: DataFrame, require_valid_email: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, cluster) of every row, and all links; a cluster is known by its smallest row."""
    keys = materialise(link_keys(leads, require_valid_email), "link-keys")
    links = None
    for key, reason in EXACT:
        found = link_exact(keys, key, reason)
        links = found if links is None else links.unionByName(found)
    links = materialise(links, "exact-links")
    parts = connected_components(links)
    names = materialise(link_fuzzy(keys, parts), "name-links")
    links = links.unionByName(names)
    parts, _ = grow_components(parts, names)
    rows = keys.select("row").join(parts.withColumnRenamed("node", "row"), "row", "left")
    return materialise(rows.select("row", F.coalesce("component", "row").alias("cluster")), "clusters"), links


def matched_on(links: DataFrame) -> DataFrame:
    """row, reasons (sorted) of all rows that a link touches."""
    ends = links.select(F.col("src").alias("row"), "reason").unionByName(links.select(F.col("dst").alias("row"), "reason"))
    return ends.groupBy("row").agg(F.sort_array(F.collect_set("reason")).alias("matched_on"))


STAGES = ("domain", "phone", "email", "name")


def link_statistics(links: DataFrame) -> DataFrame:
    """stage, unions: rows that each stage's links add to components beyond those of the stages before.

    Each stage runs over what it joins alone: its links are contracted to the components so far.
    """
    links = materialise(links.select("src", "dst", "reason"), "links")
    labels, out = None, []
    for stage in STAGES:
        own = links.filter(F.col("reason") == stage)
        if labels is None:
            labels = connected_components(own)
            moved = labels.filter("node <> component")
        else:
            labels, moved = grow_components(labels, own)
        out.append((stage, moved.count()))
    return links.sparkSession.createDataFrame(out, "stage string, unions long")
