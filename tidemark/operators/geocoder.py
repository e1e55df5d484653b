"""Parts of a typed location → places and areas, as joins with the list of places.

Every part of every location, with the one or two behind it, is decided on by itself: it meets the
names, regions and countries of the list in equi-joins, the namesakes it meets are aggregated, and one
chain of conditions picks what it means and how many parts that takes. A fold over the parts of a
location then walks from one to the next. Only distinct parts are joined, so hot values cost once.

What a part can mean, the first that holds: a ZIP code; a continent; a country's code in front of a
place ("XX-RR-Town"); a town with its own region behind it, and perhaps its country; a small place by
ZIP code and region; a town with its country; a region with its country; a country; a region; a town
that dwarfs its namesakes; a region's code; a town with a code inside the part ("Town RR").

Defined results
  null or no parts                                → no rows
  nothing of the list                             → unresolved, with the area that the next part names
  a name of a country and of another's region     → unresolved
  a region's name that a large town elsewhere has → unresolved, unless the region is much larger
  equally large namesakes                         → the one with the larger place_id
  repeated values                                 → decided once
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normalize
from tidemark.session import cut

# Continents and their codes, and first words of names that are spelt out in the list.
CONTINENTS = {"europe": "EU", "asia": "AS", "africa": "AF", "oceania": "OC", "north america": "NA", "south america": "SA"}
SPELT_OUT = {"ft": "fort", "mt": "mount", "pt": "point"}
# Countries whose regions' codes count without a name, and the one whose regions come first.
CODED, FIRST = ["US", "CA", "AU"], "US"
# From this size a town wins over a region of its name; from this size it makes the name
# ambiguous, unless the region is so many times larger; so many times larger than its namesakes a town is meant without a region.
TOWN_WINS, TOWN_RIVALS, REGION_OUTWEIGHS, DOMINANT = 1_000_000, 100_000, 10, 10
PLACE = "struct<place_id bigint, area string>"


def spelt_out(name: Column) -> Column:
    first = F.element_at(F.create_map(*[F.lit(x) for kv in SPELT_OUT.items() for x in kv]), F.substring_index(name, " ", 1))
    return F.when(first.isNotNull() & name.contains(" "), F.concat(first, F.substring(name, F.instr(name, " "), 1 << 20))).otherwise(name)


class Dimensions:
    """The lookups that a list of places gives. places: place_id, place_name, ascii_name, alternates, admin_code, admin_name, country_code, country_name, population."""

    def __init__(self, places: DataFrame, postal: DataFrame | None = None):
        """postal: zip, place, state of one country's ZIP codes, if there are any."""
        rows = places.where("place_id IS NOT NULL").select("place_id", "country_code", "admin_code", F.coalesce("population", F.lit(0)).alias("population"), F.array("place_name", "ascii_name").alias("own"), F.split(F.coalesce("alternates", F.lit("")), ",").alias("other"), "admin_name", "country_name")
        spell = lambda c, rank: rows.select("place_id", "country_code", "admin_code", "population", F.explode(c).alias("n"), F.lit(rank).alias("rank")).where("n IS NOT NULL").withColumn("name", normalize(F.col("n"))).where("name <> ''").drop("n")
        named = spell("own", 0).unionByName(spell("other", 1)).groupBy("name", "place_id").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("country_code", "admin_code", "population")])
        # other names count where no place bears the name itself
        least = named.groupBy("name").agg(F.min("rank").alias("rank"))
        self.names = named.join(least, ["name", "rank"], "left_semi")
        self.countries = rows.select("country_code", F.explode(F.array("country_code", "country_name")).alias("n")).select(normalize(F.col("n")).alias("name"), "country_code").where("name <> ''").groupBy("name").agg(F.min("country_code").alias("country"))
        known = rows.where("admin_code IS NOT NULL AND country_code IS NOT NULL")
        self.regions = known.select("country_code", "admin_code", F.explode(F.array("admin_code", "admin_name")).alias("n")).select("country_code", normalize(F.col("n")).alias("name"), "admin_code").where("name <> ''").groupBy("country_code", "name").agg(F.min("admin_code").alias("code"))
        alone = known.select(normalize(F.col("admin_name")).alias("name"), F.struct(F.col("country_code").alias("country"), F.col("admin_code").alias("code")).alias("r")).where("name <> ''").distinct()
        alone = alone.groupBy("name").agg(F.min(F.when(F.col("r.country") == FIRST, F.col("r"))).alias("first"), F.min("r").alias("r"), F.count("*").alias("n"))
        self.alone = alone.select("name", F.coalesce("first", F.when(F.col("n") == 1, F.col("r"))).alias("region")).where("region IS NOT NULL")
        self.sizes = known.groupBy(F.col("country_code").alias("country"), F.col("admin_code").alias("code")).agg(F.sum("population").alias("people"))
        self.postal = postal


def _area(kind: str, *parts: Column) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("place_id"), F.concat_ws(":", F.lit(kind), F.concat_ws("-", *parts)).alias("area"))


def _qualifier(rows: DataFrame, column: str, out: str, d: Dimensions) -> DataFrame:
    """rows with ``out``: the area that a text names on its own, a country, a coded region or a region of one name."""
    coded = d.regions.where(F.col("country_code").isin(CODED)).withColumn("order", F.array_position(F.array(*map(F.lit, CODED)), F.col("country_code"))).groupBy("name").agg(F.min(F.struct("order", "country_code", "code")).alias("coded"))
    texts = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("name", normalize(F.col(column)))
    named = texts.join(d.countries, "name", "left").join(coded, "name", "left").join(d.alone, "name", "left")
    area = F.coalesce(F.when(F.col("country").isNotNull(), _area("country", F.col("country"))["area"]), F.when(F.col("coded").isNotNull(), _area("region", F.col("coded.country_code"), F.col("coded.code"))["area"]), F.when(F.col("region").isNotNull(), _area("region", F.col("region.country"), F.col("region.code"))["area"]))
    return rows.join(named.select(column, area.alias(out)), column, "left")


def _decide(triples: DataFrame, d: Dimensions) -> DataFrame:
    """part, next, after (distinct) with used (parts taken, 0 if undecided) and found: PLACE."""
    rows = triples.select("part", "next", "after", normalize(F.col("part")).alias("n0"), normalize(F.col("next")).alias("n1"), normalize(F.col("after")).alias("n2"), F.concat_ws("\x1f", "part", F.coalesce("next", F.lit("\x1e")), F.coalesce("after", F.lit("\x1e"))).alias("id"))
    for k in (0, 1, 2):
        rows = rows.join(d.countries.select(F.col("name").alias(f"n{k}"), F.col("country").alias(f"c{k}")), f"n{k}", "left")
    rows = rows.join(d.alone.select(F.col("name").alias("n0"), "region"), "n0", "left")
    rows = rows.join(d.sizes.select(F.struct("country", "code").alias("region"), "people"), "region", "left")
    met = rows.select("id", "n1", "c1", "c2", "region", spelt_out(F.col("n0")).alias("name")).join(d.names, "name")
    met = met.join(d.regions.select("country_code", F.col("name").alias("n1"), F.col("code").alias("asked")), ["country_code", "n1"], "left")
    mine = F.coalesce(F.col("asked") == F.col("admin_code"), F.lit(False))
    outside = ~(F.col("country_code").eqNullSafe(F.col("region.country")) & F.col("admin_code").eqNullSafe(F.col("region.code")))
    biggest = F.struct("population", "place_id")
    by_region = met.groupBy("id", "country_code", "admin_code").agg(
        F.max(biggest).alias("top"), F.max(F.when(mine, biggest)).alias("in_region"), F.max(F.when(mine & (F.col("country_code") == F.col("c2")), biggest)).alias("in_both"),
        F.max(F.when(F.col("country_code") == F.col("c1"), biggest)).alias("in_country"), F.max(F.when(outside, F.col("population"))).alias("rival"),
    )
    tops = F.reverse(F.array_sort(F.collect_list(F.struct("top", "country_code"))))
    towns = by_region.groupBy("id").agg(tops.alias("tops"), *[F.max(c).alias(c) for c in ("in_region", "in_both", "in_country", "rival")])
    rows = rows.join(towns, "id", "left")
    if d.postal is not None:
        zips = d.postal.groupBy(F.col("zip").alias("part")).agg(F.min("state").alias("zip_state"))
        small = d.postal.select(spelt_out(normalize(F.col("place"))).alias("s0"), normalize(F.col("state")).alias("n1")).distinct().withColumn("small", F.lit(True))
        rows = rows.join(zips, "part", "left").withColumn("s0", spelt_out(F.col("n0"))).join(small, ["s0", "n1"], "left")
    else:
        rows = rows.withColumns({"zip_state": F.lit(None).cast("string"), "small": F.lit(None).cast("boolean")})
    rows = _qualifier(rows, "part", "alone_area", d)
    top, second = F.get("tops", F.lit(0)), F.get("tops", F.lit(1))
    people = F.coalesce(top["top"]["population"], F.lit(0))
    rival = F.coalesce("rival", F.lit(0))
    rivaled = F.col("region").isNotNull() & (rival >= TOWN_RIVALS) & (rival < TOWN_WINS) & (F.coalesce("people", F.lit(0)) < REGION_OUTWEIGHS * rival)
    town = lambda c: F.struct(F.col(f"{c}.place_id").alias("place_id"), F.lit(None).cast("string").alias("area"))
    region_area = _area("region", F.col("region.country"), F.col("region.code"))
    continent = F.element_at(F.create_map(*[F.lit(x) for kv in CONTINENTS.items() for x in kv]), F.col("n0"))
    found = lambda used, what: F.struct(F.lit(used).alias("used"), what.cast(PLACE).alias("found"))
    nothing = found(0, F.lit(None).cast(PLACE))
    town_wins = top.isNotNull() & ((top["country_code"] == F.col("c0")) | (people >= TOWN_WINS))
    decided = (
        F.when(F.col("zip_state").isNotNull(), found(1, _area("zip", F.col("part")))).when(continent.isNotNull(), found(1, _area("continent", continent)))
        .when(F.col("in_both").isNotNull(), found(3, town("in_both"))).when(F.col("in_region").isNotNull(), found(2, town("in_region"))).when(F.col("small"), found(2, _area("small", F.col("n1"), F.col("n0"))))
        .when(rivaled & (F.col("c1") == F.col("region.country")), nothing).when(F.col("in_country").isNotNull(), found(2, town("in_country"))).when(F.col("c1") == F.col("region.country"), found(2, region_area))
        .when(F.col("c0").isNotNull() & (F.col("region.country") != F.col("c0")), nothing).when(F.col("c0").isNotNull() & ~F.coalesce(town_wins, F.lit(False)), found(1, _area("country", F.col("c0"))))
        .when(rivaled, nothing).when(F.col("region").isNotNull() & (people < TOWN_WINS), found(1, region_area))
        .when(top.isNotNull() & (people >= DOMINANT * F.coalesce(second["top"]["population"], F.lit(0))), found(1, F.struct(top["top"]["place_id"].alias("place_id"), F.lit(None).cast("string").alias("area"))))
        .when(F.col("part").rlike("^[A-Z]{1,3}$") & F.col("alone_area").isNotNull(), found(1, F.struct(F.lit(None).cast("bigint").alias("place_id"), F.col("alone_area").alias("area")))).otherwise(nothing)
    )
    return rows.select("part", "next", "after", decided.alias("d")).select("part", "next", "after", "d.used", "d.found")


def _same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} <=> {b}.{c}" for c in ("part", "next", "after"))


def decide_parts(triples: DataFrame, d: Dimensions) -> DataFrame:
    """part, next, after, step, place_id, area, unresolved for each distinct triple: what the part means and how many parts that takes."""
    base = triples.select("part", "next", "after").where("part IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    # a country's code in front ("XX-RR-Town", "XX-Town") and a code behind ("Town RR") are read as parts of their own
    coded = base.select(F.col("part").alias("whole")).distinct().where(F.col("whole").rlike("^[A-Z]{2}-.+")).select("whole", F.left("whole", F.lit(2)).alias("country"), F.substring("whole", 4, 1 << 20).alias("rest"))
    coded = coded.join(d.countries.select("country").distinct(), "country", "left_semi").withColumn("r", F.substring_index("rest", "-", 1)).withColumn("name", normalize(F.col("r")))
    coded = coded.join(d.regions.withColumnRenamed("country_code", "country"), ["country", "name"], "left")
    three = F.struct(F.expr("substring(rest, length(r) + 2)").alias("part"), F.col("r").alias("next"), F.col("country").alias("after"))
    two = F.struct(F.col("rest").alias("part"), F.col("country").alias("next"), none.alias("after"))
    coded = coded.select("whole", F.when(F.col("code").isNotNull() & F.col("rest").contains("-"), three).otherwise(two).alias("x")).select("whole", "x.*")
    behind = base.select("part").distinct().where(F.col("part").rlike("\\S \\S+$")).select(F.col("part").alias("whole"), F.regexp_extract("part", "^(.*) (\\S+)$", 1).alias("part"), F.regexp_extract("part", "^(.*) (\\S+)$", 2).alias("next"), none.alias("after"))
    all_of = cut(_decide(base.unionByName(coded.drop("whole")).unionByName(behind.drop("whole")).distinct(), d))
    inner = lambda split, ok: split.alias("s").join(all_of.where(ok).alias("t"), F.expr(_same("s", "t"))).groupBy(F.col("s.whole").alias("part")).agg(F.max("t.found").alias("found"))
    rows = base.alias("b").join(all_of.alias("t"), F.expr(_same("b", "t"))).select("b.*", "t.used", "t.found")
    rows = rows.join(inner(coded, "used > 0").withColumnRenamed("found", "as_code"), "part", "left").join(inner(behind, "used = 2").withColumnRenamed("found", "as_tail"), "part", "left")
    rows = _qualifier(rows, "next", "next_area", d)
    zip_or_continent = F.col("found.area").startswith("zip") | F.col("found.area").startswith("continent")
    use_code = F.col("as_code").isNotNull() & ~F.coalesce(zip_or_continent, F.lit(False))
    meant = F.when(use_code, F.col("as_code")).when(F.col("used") > 0, F.col("found")).otherwise(F.col("as_tail"))
    step = F.when(use_code, 1).when(F.col("used") > 0, F.col("used")).when(F.col("as_tail").isNotNull() | F.col("next_area").isNull(), 1).otherwise(2)
    lost = meant.isNull()
    unresolved = F.when(lost, F.when(F.col("next_area").isNotNull(), F.concat_ws(", ", "part", "next")).otherwise(F.col("part")))
    return rows.select("part", "next", "after", step.alias("step"), meant["place_id"].alias("place_id"), F.when(lost, F.col("next_area")).otherwise(meant["area"]).alias("area"), unresolved.alias("unresolved"))


def resolve(entries: DataFrame, key: list[str], parts: str, d: Dimensions) -> DataFrame:
    """key…, at, place_id, area, unresolved: one row per place or area of each entry, at being its first part. entries: key (unique) and an array of parts."""
    ps = F.col(parts)
    each = entries.select(*key, F.posexplode(ps).alias("at", "part"), F.size(ps).alias("n"), ps.alias("_all")).select(*key, "at", "part", F.get("_all", F.col("at") + 1).alias("next"), F.get("_all", F.col("at") + 2).alias("after"))
    decided = decide_parts(each, d)
    told = each.alias("e").join(decided.alias("t"), F.expr(_same("e", "t"))).select(*[F.col(f"e.{k}") for k in key], "e.at", F.struct("e.at", "t.step", "t.place_id", "t.area", "t.unresolved").alias("x"))
    walked = told.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).alias("next"), F.filter("xs", lambda x: F.lit(False)).alias("out"))
    step = lambda acc, x: F.when(x["at"] == acc["next"], F.struct((x["at"] + x["step"]).alias("next"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    return walked.select(*key, F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select(*key, "x.at", "x.place_id", "x.area", "x.unresolved")


def locate(resolved: DataFrame, key: list[str]) -> DataFrame:
    """key…, place_id: the first place of each key."""
    return resolved.where("place_id IS NOT NULL").groupBy(*key).agg(F.min_by("place_id", "at").alias("place_id"))


def describe_place(name: Column, admin: Column, country: Column) -> Column:
    """ "Town, RR, XX"; a region that is only a number is left out."""
    return F.concat_ws(", ", name, F.when(~admin.rlike("^[0-9]*$"), admin), country)
