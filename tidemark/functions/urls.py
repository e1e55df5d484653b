"""What a URL points at, and one spelling for pages reached in different ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only say where a click came from; utm_ ones beside them.
TRACKING = ["ref", "src", "source", "gh_src", "lever-source", "lever-origin"]
# Hosts of board providers.
BOARD_HOSTS = {
    "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "boards.eu.greenhouse.io": "greenhouse", "job-boards.eu.greenhouse.io": "greenhouse",
    "jobs.lever.co": "lever", "jobs.eu.lever.co": "lever_eu", "jobs.ashbyhq.com": "ashby",
}
_URL = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TOKEN, DIGITS, UUID = r"^[A-Za-z0-9._ -]{1,100}$", r"^[0-9]{1,20}$", r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", "")), F.lit(""))


def segments_of(url: Column) -> Column:
    """Decoded, non-empty path segments."""
    decode = lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    return F.transform(F.filter(F.split(_part(url, 3), "/"), lambda s: s != ""), decode)


def query_value(url: Column, name: str) -> Column:
    """Value of the first parameter of that name; null where it is missing."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.get(pairs, F.lit(0))
    return F.try_url_decode(F.when(value.contains("="), F.substring(value, len(name) + 2, 1 << 30)).otherwise(F.when(value.isNotNull(), "")))


def clean_url(url: Column) -> Column:
    """The http(s) URL without fragment and tracking parameters, others in order; null for anything else."""
    scheme, query = F.lower(_part(url, 1)), _part(url, 4)
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING)), "&")
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    return F.when(scheme.isin("http", "https") & (_part(url, 2) != ""), F.concat(scheme, F.lit("://"), F.lower(_part(url, 2)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolve(url: Column) -> Column:
    """struct<kind, ats, board_token, job_id, url>: 'posting', 'board', 'embed', 'external', or null for what is no web address."""
    host, seg = host_of(url), segments_of(url)
    at = lambda i: F.get(seg, F.lit(i))
    ats = F.element_at(F.create_map(*[F.lit(x) for kv in BOARD_HOSTS.items() for x in kv]), host)
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")

    def found(kind: str, board: Column = none, job: Column = none, link: Column = none) -> Column:
        token = F.when(ats.isin("greenhouse", "ashby"), F.lower(board)).otherwise(board)
        return F.struct(F.lit(kind).alias("kind"), text(ats).alias("ats"), text(token).alias("board_token"), F.lower(job).alias("job_id"), text(link).alias("url"))

    is_embed = (ats == "greenhouse") & (at(0) == "embed")
    board, job = F.when(is_embed, query_value(url, "for")).otherwise(at(0)), F.when(is_embed, query_value(url, "token")).when(ats == "greenhouse", F.when(at(1) == "jobs", at(2))).otherwise(at(1))
    good_job = F.when(ats == "greenhouse", job.rlike(DIGITS)).otherwise(job.rlike(UUID))
    alone = F.when(is_embed, job.isNull()).otherwise(at(1).isNull())
    jid = query_value(url, "gh_jid")
    web = clean_url(url)
    return (
        F.when(web.isNull(), F.lit(None))
        .when(ats.isNotNull() & board.rlike(TOKEN) & good_job, found("posting", board, job))
        .when(ats.isNotNull() & board.rlike(TOKEN) & alone, found("board", board))
        .when(ats.isNull() & jid.rlike(DIGITS), found("embed", job=jid, link=host))
        .otherwise(found("external", link=web))
    )
