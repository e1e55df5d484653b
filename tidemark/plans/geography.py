"""Queries over typed locations and the list of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import geocoder
from tidemark.plans.reference import sql_norm
from tidemark.session import table


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "lever_postings").select(F.col("categories.location_name").alias("location")).where("location IS NOT NULL").distinct()
    entries = values.select("location", F.filter(F.transform(F.split("location", ","), lambda x: F.trim(x)), lambda x: x != "").alias("parts"))
    return geocoder.resolve(entries, ["location"], "parts", geocoder.Dimensions(table(spark, sf, "places")))


def places_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """What the comma-separated parts of every typed location mean."""
    return _resolved(spark, sf)


def places_located(spark: SparkSession, sf: str) -> DataFrame:
    """The first place of every typed location, described."""
    found = geocoder.locate(_resolved(spark, sf), ["location"])
    places = table(spark, sf, "places").select("place_id", geocoder.describe_place(F.col("place_name"), F.col("admin_code"), F.col("country_code")).alias("description")).distinct()
    return found.join(places, "place_id").select("location", "place_id", "description")


_SPELT = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{k} ') THEN '{v}' || substring({{0}}, {len(k) + 1})" for k, v in geocoder.SPELT_OUT.items()) + " ELSE {0} END"
_CODED = ", ".join(f"'{c}'" for c in geocoder.CODED)
_CONTINENT = "CASE n0 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in geocoder.CONTINENTS.items()) + " END"
_Q_AREA = "coalesce('country:' || {q}c.country, 'region:' || {q}d.c || '-' || {q}d.code, 'region:' || {q}a.rc || '-' || {q}a.rcode)"
_Q_JOINS = "LEFT JOIN co {q}c ON {q}c.name = {n} LEFT JOIN cd {q}d ON {q}d.name = {n} LEFT JOIN al {q}a ON {q}a.name = {n}"
_RIVALED = f"(rc IS NOT NULL AND rival >= {geocoder.TOWN_RIVALS} AND rival < {geocoder.TOWN_WINS} AND coalesce(people, 0) < {geocoder.REGION_OUTWEIGHS} * rival)"
_PEOPLE = "coalesce(tops[1][1][1], 0)"
_IDS = "coalesce({0}.part = {1}.part, false) AND {0}.nxt IS NOT DISTINCT FROM {1}.nxt AND {0}.aft IS NOT DISTINCT FROM {1}.aft"
_RESOLVED = (
    "WITH RECURSIVE e AS (SELECT location, list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM (SELECT DISTINCT categories.location_name AS location FROM lever_postings WHERE categories.location_name IS NOT NULL)), "
    "k AS (SELECT location, i AS at, ps[i + 1] AS part, ps[i + 2] AS nxt, ps[i + 3] AS aft FROM e, unnest(range(len(ps))) AS r(i)), "
    "p AS (SELECT DISTINCT place_id, country_code AS c, admin_code AS a, coalesce(population, 0) AS pop, place_name, ascii_name, coalesce(alternates, '') AS alternates, admin_name, country_name FROM places WHERE place_id IS NOT NULL), "
    f"s AS (SELECT {sql_norm('n')} AS name, place_id, c, a, pop, rank FROM (SELECT unnest([place_name, ascii_name]) AS n, 0 AS rank, * FROM p UNION ALL SELECT unnest(string_split(alternates, ',')) AS n, 1 AS rank, * FROM p)), nm AS (SELECT DISTINCT name, place_id, c, a, pop FROM s WHERE name <> '' QUALIFY rank = min(rank) OVER (PARTITION BY name)), "
    f"co AS (SELECT {sql_norm('n')} AS name, min(c) AS country FROM (SELECT c, unnest([c, country_name]) AS n FROM p) GROUP BY 1 HAVING name <> ''), re AS (SELECT c, {sql_norm('n')} AS name, min(a) AS code FROM (SELECT c, a, unnest([a, admin_name]) AS n FROM p WHERE a IS NOT NULL AND c IS NOT NULL) GROUP BY 1, 2 HAVING name <> ''), "
    f"an AS (SELECT DISTINCT {sql_norm('admin_name')} AS name, c, a FROM p WHERE a IS NOT NULL AND c IS NOT NULL AND {sql_norm('admin_name')} <> ''), ar AS (SELECT name, coalesce(min((c, a)) FILTER (WHERE c = '{geocoder.FIRST}'), CASE WHEN count(*) = 1 THEN min((c, a)) END) AS r FROM an GROUP BY 1), al AS (SELECT name, r[1] AS rc, r[2] AS rcode FROM ar WHERE r IS NOT NULL), "
    "sz AS (SELECT c, a, sum(pop) AS people FROM p WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2), "
    f"cd AS (SELECT name, c, code FROM re WHERE c IN ({_CODED}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY list_position([{_CODED}], c)) = 1), "
    "b AS (SELECT DISTINCT part, nxt, aft FROM k), h AS (SELECT DISTINCT part AS whole, left(part, 2) AS head, substring(part, 4) AS rest FROM b WHERE regexp_matches(part, '^[A-Z]{2}-.+') AND left(part, 2) IN (SELECT country FROM co)), "
    f"cx AS (SELECT whole, CASE WHEN code IS NOT NULL AND contains(rest, '-') THEN substring(rest, length(split_part(rest, '-', 1)) + 2) ELSE rest END AS part, CASE WHEN code IS NOT NULL AND contains(rest, '-') THEN split_part(rest, '-', 1) ELSE head END AS nxt, CASE WHEN code IS NOT NULL AND contains(rest, '-') THEN head END AS aft FROM h LEFT JOIN re ON re.c = head AND re.name = {sql_norm('split_part(rest, chr(45), 1)')}), "
    "bx AS (SELECT DISTINCT part AS whole, regexp_extract(part, '^(.*) (\\S+)$', 1) AS part, regexp_extract(part, '^(.*) (\\S+)$', 2) AS nxt, NULL::VARCHAR AS aft FROM b WHERE regexp_matches(part, '\\S \\S+$')), "
    f"t AS (SELECT DISTINCT part, nxt, aft, {sql_norm('part')} AS n0, {sql_norm('nxt')} AS n1, {sql_norm('aft')} AS n2 FROM (SELECT * FROM b UNION SELECT part, nxt, aft FROM cx UNION SELECT part, nxt, aft FROM bx)), "
    "x AS (SELECT t.*, row_number() OVER () AS id, o0.country AS c0, o1.country AS c1, o2.country AS c2, al.rc, al.rcode, sz.people FROM t LEFT JOIN co o0 ON o0.name = n0 LEFT JOIN co o1 ON o1.name = n1 LEFT JOIN co o2 ON o2.name = n2 LEFT JOIN al ON al.name = n0 LEFT JOIN sz ON sz.c = al.rc AND sz.a = al.rcode), "
    f"m AS (SELECT x.*, nm.place_id, nm.c, nm.a, nm.pop, re.code FROM x JOIN nm ON nm.name = {_SPELT.format('n0')} LEFT JOIN re ON re.c = nm.c AND re.name = n1), "
    "g AS (SELECT id, c, a, max((pop, place_id)) AS top, max((pop, place_id)) FILTER (WHERE code = a) AS in_region, max((pop, place_id)) FILTER (WHERE code = a AND c = c2) AS in_both, max((pop, place_id)) FILTER (WHERE c = c1) AS in_country, max(pop) FILTER (WHERE NOT (c IS NOT DISTINCT FROM rc AND a IS NOT DISTINCT FROM rcode)) AS rival FROM m GROUP BY 1, 2, 3), "
    "w AS (SELECT id, list((top, c) ORDER BY top DESC) AS tops, max(in_region) AS in_region, max(in_both) AS in_both, max(in_country) AS in_country, max(rival) AS rival FROM g GROUP BY 1), "
    f"y AS (SELECT x.*, tops, in_region, in_both, in_country, coalesce(rival, 0) AS rival, {_Q_AREA.format(q='q')} AS alone FROM x LEFT JOIN w USING (id) {_Q_JOINS.format(q='q', n='n0')}), "
    f"z AS (SELECT *, CASE WHEN {_CONTINENT} IS NOT NULL THEN (1, NULL::BIGINT, 'continent:' || {_CONTINENT}) WHEN in_both IS NOT NULL THEN (3, in_both[2], NULL) WHEN in_region IS NOT NULL THEN (2, in_region[2], NULL) WHEN {_RIVALED} AND c1 = rc THEN (0, NULL, NULL) WHEN in_country IS NOT NULL THEN (2, in_country[2], NULL) WHEN c1 = rc THEN (2, NULL, 'region:' || rc || '-' || rcode) "
    f"WHEN c0 IS NOT NULL AND rc <> c0 THEN (0, NULL, NULL) WHEN c0 IS NOT NULL AND NOT coalesce(tops IS NOT NULL AND (tops[1][2] = c0 OR {_PEOPLE} >= {geocoder.TOWN_WINS}), false) THEN (1, NULL, 'country:' || c0) WHEN {_RIVALED} THEN (0, NULL, NULL) WHEN rc IS NOT NULL AND {_PEOPLE} < {geocoder.TOWN_WINS} THEN (1, NULL, 'region:' || rc || '-' || rcode) "
    f"WHEN tops IS NOT NULL AND {_PEOPLE} >= {geocoder.DOMINANT} * coalesce(tops[2][1][1], 0) THEN (1, tops[1][1][2], NULL) WHEN regexp_matches(part, '^[A-Z]{{1,3}}$') AND alone IS NOT NULL THEN (1, NULL, alone) ELSE (0, NULL, NULL) END AS d FROM y), "
    "dd AS (SELECT part, nxt, aft, d[1] AS used, d[2] AS place_id, d[3] AS area FROM z), "
    f"ac AS (SELECT whole, any_value(dd.place_id) AS place_id, any_value(dd.area) AS area FROM cx JOIN dd ON {_IDS.format('cx', 'dd')} WHERE used > 0 GROUP BY 1), ab AS (SELECT whole, any_value(dd.place_id) AS place_id, any_value(dd.area) AS area FROM bx JOIN dd ON {_IDS.format('bx', 'dd')} WHERE used = 2 GROUP BY 1), "
    f"f AS (SELECT b.part, b.nxt, b.aft, used, dd.place_id AS p1, dd.area AS a1, ac.whole IS NOT NULL AND NOT coalesce(starts_with(dd.area, 'continent'), false) AS use_code, ac.place_id AS p2, ac.area AS a2, ab.whole IS NOT NULL AS has_tail, ab.place_id AS p3, ab.area AS a3, {_Q_AREA.format(q='q')} AS next_area FROM b JOIN dd ON {_IDS.format('b', 'dd')} LEFT JOIN ac ON ac.whole = b.part LEFT JOIN ab ON ab.whole = b.part {_Q_JOINS.format(q='q', n=sql_norm('b.nxt'))}), "
    "r AS (SELECT part, nxt, aft, CASE WHEN use_code THEN 1 WHEN used > 0 THEN used WHEN has_tail OR next_area IS NULL THEN 1 ELSE 2 END AS step, CASE WHEN use_code THEN p2 WHEN used > 0 THEN p1 WHEN has_tail THEN p3 END AS place_id, CASE WHEN use_code THEN a2 WHEN used > 0 THEN a1 WHEN has_tail THEN a3 ELSE next_area END AS area, CASE WHEN NOT use_code AND used = 0 AND NOT has_tail THEN part || CASE WHEN next_area IS NOT NULL THEN ', ' || nxt ELSE '' END END AS unresolved FROM f), "
    f"j AS (SELECT k.location, k.at, r.* FROM k JOIN r ON {_IDS.format('k', 'r')}), walk AS (SELECT location, 0 AS at FROM e WHERE len(ps) > 0 UNION ALL SELECT j.location, j.at + j.step FROM walk JOIN j ON j.location = walk.location AND j.at = walk.at), "
    "found AS (SELECT j.location, CAST(j.at AS INTEGER) AS at, CAST(place_id AS BIGINT) AS place_id, area, unresolved FROM walk JOIN j ON j.location = walk.location AND j.at = walk.at)"
)
SQL = {
    "places_resolved": f"{_RESOLVED} SELECT * FROM found",
    "places_located": f"{_RESOLVED} SELECT location, place_id, concat_ws(', ', place_name, CASE WHEN NOT regexp_full_match(admin_code, '[0-9]*') THEN admin_code END, country_code) AS description FROM (SELECT location, arg_min(place_id, \"at\") AS place_id FROM found WHERE place_id IS NOT NULL GROUP BY 1) JOIN (SELECT DISTINCT place_id, place_name, admin_code, country_code FROM places) USING (place_id)",
}

QUERIES = {f.__name__: f for f in (places_resolved, places_located)}
