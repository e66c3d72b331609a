"""Place listings and map elements as leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadweave.functions import text as T
from leadweave.rules import GENERIC_GROUP, INDUSTRY_TAGS

PLACE = (
    "id string, displayName struct<text:string>, formattedAddress string, addressComponents array<struct<longText:string,shortText:string,types:array<string>>>, internationalPhoneNumber string, "
    "nationalPhoneNumber string, websiteUri string, rating double, userRatingCount int, primaryTypeDisplayName struct<text:string>, businessStatus string"
)


def _component(kind: str, part: str) -> Column:
    return F.get(F.filter("p.addressComponents", lambda c: F.array_contains(c["types"], kind)), F.lit(0))[part]


def places_to_leads(listings: DataFrame, industry: str | None = None, skipped: Observation | None = None, most: int | None = None) -> DataFrame:
    """Lead columns of listings (json); permanently closed ones are left out, and counted as `skipped` in the same pass.

    most: how many listings of a search are looked at, the first by id; None: all.
    """
    x = listings.select(F.from_json("json", PLACE).alias("p"))
    if most is not None:
        x = x.orderBy("p.id").limit(most)
    closed = F.col("p.businessStatus").eqNullSafe("CLOSED_PERMANENTLY")
    if skipped is not None:
        x = x.observe(skipped, F.count_if(closed).alias("skipped"))
    x = x.filter(~closed)
    return x.select(
        F.col("p.id").alias("source_id"), F.col("p.displayName.text").alias("company_name"), F.coalesce("p.internationalPhoneNumber", "p.nationalPhoneNumber").alias("phone"), F.col("p.websiteUri").alias("website"),
        F.col("p.formattedAddress").alias("address"), F.coalesce(_component("locality", "longText"), _component("postal_town", "longText"), _component("sublocality", "longText")).alias("city"),
        _component("administrative_area_level_1", "shortText").alias("state"), F.coalesce(F.lit(industry), F.col("p.primaryTypeDisplayName.text")).alias("industry"), F.col("p.rating").alias("rating"), F.col("p.userRatingCount").alias("review_count"),
    )


def osm_to_leads(elements: DataFrame, industry: str | None = None) -> DataFrame:
    """Lead columns of map elements (type, id, tags: map)."""
    tag = lambda *keys: F.coalesce(*[T.blank_to_null(F.element_at("tags", k)) for k in keys])
    street = T.blank_to_null(F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")))
    year = F.regexp_extract(tag("start_date"), "^[0-9]{4}", 0)
    return elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_id"), tag("name").alias("company_name"), tag("website", "contact:website", "url").alias("website"), tag("phone", "contact:phone").alias("phone"),
        tag("email", "contact:email").alias("email"), T.blank_to_null(F.concat_ws(", ", street, tag("addr:city"), tag("addr:state"), tag("addr:postcode"))).alias("address"), tag("addr:city").alias("city"), tag("addr:state").alias("state"),
        F.lit(industry).cast("string").alias("industry"), T.blank_to_null(year).alias("year_founded"),
    )


def industry_tags(industry: Column) -> Column:
    """Map tags of the industry's keyword groups in order; the generic group's only if no other fits."""
    text = F.lower(F.coalesce(industry, F.lit("")))

    def tags(k: int) -> Column:
        keys, found = INDUSTRY_TAGS[k]
        hit = F.lit(False)
        for w in keys:
            hit = hit | F.contains(text, F.lit(w))
        return F.when(hit, F.array(*[F.lit(t) for t in found])).otherwise(F.array().cast("array<string>"))

    specific = F.concat(*[tags(k) for k in range(len(INDUSTRY_TAGS)) if k != GENERIC_GROUP])
    return F.array_distinct(F.when(F.size(specific) > 0, specific).otherwise(tags(GENERIC_GROUP)))


#: Degrees of a cell's sides.
CELL = 1.0


def save_elements(elements: DataFrame, path: str, degrees: float = CELL) -> None:
    """Write map elements (lat, lon) in folders of grid cells, so that a search reads the cells of its box alone.

    Elements without a place are in no cell and never found, so they are left out.
    """
    cell = lambda c: F.floor(F.col(c) / degrees).cast("int")
    placed = elements.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"cell_lat": cell("lat"), "cell_lon": cell("lon")})
    # cells are dealt out with their elements' hash, so that a crowded cell is written by several tasks
    placed.repartition("cell_lat", "cell_lon", F.pmod(F.xxhash64("seq"), F.lit(8))).write.mode("overwrite").partitionBy("cell_lat", "cell_lon").parquet(path)


def elements_in(elements: DataFrame, bbox: tuple[float, float, float, float], degrees: float = CELL) -> DataFrame:
    """The saved elements of the cells that a box (south, west, north, east) touches: a filter on folders."""
    south, west, north, east = (int(x // degrees) for x in bbox)
    return elements.filter(F.col("cell_lat").between(south, north) & F.col("cell_lon").between(west, east)).drop("cell_lat", "cell_lon")


def search_elements(elements: DataFrame, tags: list[str], keyword: str | None, bbox: tuple[float, float, float, float], limit: int) -> DataFrame:
    """Named elements (seq, lat, lon, tags) in the box (south, west, north, east) with a tag, or the keyword in their name.

    The first max(2 * limit, 50) by seq are looked at; those with a phone, website or email come first.
    """
    south, west, north, east = bbox
    name = F.element_at("tags", "name")
    hit = F.lit(False)
    for t in tags:
        k, _, v = t.partition("=")
        hit = hit | (F.coalesce(F.element_at("tags", k) == v, F.lit(False)) if v else F.map_contains_key("tags", k))
    if keyword and len(keyword) >= 3:
        hit = hit | F.contains(F.lower(name), F.lit(keyword.lower()))
    found = elements.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east) & (F.coalesce(name, F.lit("")) != "") & hit)
    found = found.orderBy("seq").limit(max(2 * limit, 50))
    contact = F.coalesce(*[F.element_at("tags", k) for k in ("phone", "contact:phone", "website", "contact:website", "email", "contact:email")]).isNotNull()
    return found.orderBy(contact.desc(), "seq").limit(limit)
