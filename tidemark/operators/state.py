"""Current-state tables kept from observations: pure functions (state, observations, now) → next state.

``now`` is always an argument. Keys with nulls match nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import hamming
from tidemark.session import cut

#: Differing SimHash bits within which two texts count as one; misses that close a record.
NEAR_BITS, MISSES = 3, 2


def upsert(state: DataFrame, seen: DataFrame, key: list[str], content: str, now: int, keep: list[str] | None = None) -> DataFrame:
    """key, content, keep…, first_seen, last_seen, closed_at, missed, status ('new', 'reopened', 'updated', 'unchanged', or null if not seen).

    seen has key and content, one row per key; state has key, content, first_seen, last_seen, closed_at, missed.
    keep: columns of both whose known value stays where the one seen is null.
    """
    both = state.alias("o").join(seen.withColumn("here", F.lit(True)).alias("n"), key, "full")
    here, known = F.col("n.here").isNotNull(), F.col("o.first_seen").isNotNull()
    status = F.when(~here, None).when(~known, "new").when(F.col("o.closed_at").isNotNull(), "reopened").when(~F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}")), "updated").otherwise("unchanged")
    return both.select(
        *key, F.when(here, F.col(f"n.{content}")).otherwise(F.col(f"o.{content}")).alias(content), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep or []], F.coalesce("o.first_seen", F.lit(now)).alias("first_seen"),
        F.when(here, F.lit(now)).otherwise(F.col("o.last_seen")).alias("last_seen"), F.when(~here, F.col("o.closed_at")).alias("closed_at"), F.when(here, 0).otherwise(F.col("o.missed")).alias("missed"), status.alias("status"),
    )


def add_sources(sources: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """key, first_seen (the earliest), seen_at (the latest) and url (of the latest); both sides have these columns."""
    latest = F.max(F.struct("seen_at", "url"))
    return sources.unionByName(seen).groupBy(*key).agg(F.min("first_seen").alias("first_seen"), latest.alias("l")).select(*key, "first_seen", "l.seen_at", "l.url")


def take_misses(state: DataFrame, listed: DataFrame, key: list[str], now: int, unchanged: Column | None = None) -> DataFrame:
    """Open records not listed miss once, and close at MISSES; listed ones start over.

    unchanged: true where the source said "not modified", which counts as listed unless a miss is open.
    """
    flagged = state.join(listed.select(*key).distinct().withColumn("listed", F.lit(True)), key, "left")
    kept = F.coalesce(unchanged, F.lit(False)) & (F.col("missed") == 0) if unchanged is not None else F.lit(False)
    is_open, is_listed = F.col("closed_at").isNull(), F.col("listed").isNotNull() | kept
    missed = F.when(~is_open, F.col("missed")).when(is_listed, 0).otherwise(F.col("missed") + 1)
    closed = F.when(~is_open, F.col("closed_at")).when(~is_listed & (F.col("missed") + 1 >= MISSES), F.lit(now))
    return flagged.withColumns({"missed": missed, "closed_at": closed}).drop("listed")


def only_from(sources: DataFrame, key: list[str], source: str, name: str) -> DataFrame:
    """Keys that this source lists and no other does."""
    other = sources.where(F.col(source) != name).select(*key).distinct()
    return sources.where(F.col(source) == name).select(*key).distinct().join(other, key, "left_anti")


def add_if_known(sources: DataFrame, offered: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """add_sources() of those offered rows whose key is known; the others are left out."""
    return add_sources(sources, offered.join(known.select(*key).distinct(), key, "left_semi"), key)


def mark_seen(state: DataFrame, seen: DataFrame, sources: DataFrame, key: list[str], now: int, feed_prefix: str = "feed:") -> DataFrame:
    """state with the seen records open again and without misses, but for those that a source other than a feed lists: it decides on them."""
    polled = sources.where(~F.col("source").startswith(feed_prefix)).select(*key).distinct()
    again = seen.select(*key).distinct().join(polled, key, "left_anti").withColumn("_again", F.lit(True))
    flag = F.col("_again").isNotNull()
    changed = {"closed_at": F.when(~flag, F.col("closed_at")), "missed": F.when(flag, 0).otherwise(F.col("missed")), "last_seen": F.when(flag, F.lit(now)).otherwise(F.col("last_seen"))}
    return state.join(again, key, "left").withColumns(changed).drop("_again")


def set_fact(state: DataFrame, offered: DataFrame, key: list[str], fact: str, source: str = "feed") -> DataFrame:
    """state with the offered fact (one row per key) where it has none yet or one of the same source; facts of other sources stay.

    The column ``<fact>_source`` says where a fact comes from.
    """
    new = offered.select(*key, F.col(fact).alias("_new"), F.lit(True).alias("_offered"))
    free = F.col("_offered").isNotNull() & (F.col(fact).isNull() | (F.col(f"{fact}_source") == source))
    joined = state.join(new, key, "left")
    value = F.when(free, F.col("_new")).otherwise(F.col(fact))
    return joined.withColumns({fact: value, f"{fact}_source": F.when(free, F.when(F.col("_new").isNotNull(), F.lit(source))).otherwise(F.col(f"{fact}_source"))}).drop("_new", "_offered")


def replace_rows(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows in the place of those of the same key; of rows one per key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def upsert_boards(boards: DataFrame, offered: DataFrame, key: list[str], name: str, flag: str) -> DataFrame:
    """boards and those offered (one row per key) that are new; a name that only repeats the board's token is replaced, the flag where one is given."""
    new = offered.select(*key, F.col(name).alias("_name"), F.col(flag).alias("_flag"))
    stand_in = F.col(name).isNull() | (F.lower(name) == F.lower(key[-1]))
    return boards.join(new, key, "full").select(*key, F.when(stand_in, F.coalesce("_name", name)).otherwise(F.col(name)).alias(name), F.coalesce("_flag", flag).alias(flag))


def retire(state: DataFrame, boards: DataFrame, listed: DataFrame, board: list[str], now: int) -> tuple[DataFrame, DataFrame]:
    """(boards still listed, state with the open records of all others closed)."""
    gone = boards.select(*board).distinct().join(listed.select(*board).distinct(), board, "left_anti").withColumn("_gone", F.lit(True))
    closed = F.when(F.col("_gone") & F.col("closed_at").isNull(), F.lit(now)).otherwise(F.col("closed_at"))
    return boards.join(gone.drop("_gone"), board, "left_anti"), state.join(gone, board, "left").withColumn("closed_at", closed).drop("_gone")


def attach(pending: DataFrame, known: DataFrame, polled: DataFrame, key: list[str], board: list[str]) -> DataFrame:
    """pending listings with ``fate``: 'attach' to a known record, 'stand_in' for one whose board wasn't polled, 'drop' where the polled board lacks it."""
    there = known.select(*key).distinct().withColumn("_known", F.lit(True))
    asked = polled.select(*board).distinct().withColumn("_polled", F.lit(True))
    fate = F.when(F.col("_known"), "attach").when(F.col("_polled").isNull(), "stand_in").otherwise("drop")
    return pending.join(there, key, "left").join(asked, board, "left").withColumn("fate", fate).drop("_known", "_polled")


def listing(state: DataFrame, evaluations: DataFrame, sources: DataFrame, key: list[str], where: list[Column], order: list[Column], limit: int) -> DataFrame:
    """The first page of the records that all of ``where`` hold for, each with its evaluation and its sources in order; the limit is the feature.

    evaluations: key and passed (one row per key). The sources are gathered for the rows of the page only.
    """
    status = F.when(F.col("passed").isNull(), "not_evaluated").when(F.col("passed"), "passed").otherwise("filtered_out")
    rows = state.join(evaluations.select(*key, "passed"), key, "left").withColumn("status", status)
    for condition in where:
        rows = rows.where(condition)
    page = rows.orderBy(*order).limit(limit)
    named = page.join(sources.select(*key, F.col("source").alias("_source")), key, "left").groupBy(*page.columns).agg(F.array_join(F.array_sort(F.collect_set("_source")), "|").alias("sources"))
    return named.orderBy(*order)


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table and those rows whose key it lacks; of repeated new keys one."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def cached(probes: DataFrame, probed_at: str, hit: str, now: int, ttl: int) -> DataFrame:
    """The recorded probes that still count: hits for good, misses for ``ttl`` seconds."""
    return probes.where(F.col(hit) | (F.col(probed_at) >= now - ttl))


def work_queue(queue: DataFrame, tried_at: str, added_at: str, name: str, now: int, ttl: int, limit: int) -> DataFrame:
    """What to try next: never tried first, then what was tried longer ago than ttl; a report of ``limit`` rows."""
    due = queue.where(F.col(tried_at).isNull() | (F.col(tried_at) < now - ttl))
    return due.orderBy(F.col(tried_at).isNotNull(), added_at, name).limit(limit)


#: Parts of a fingerprint; two that differ in NEAR_BITS bits agree in one of them at least.
BANDS = NEAR_BITS + 1


def link_reposts(rows: DataFrame, block: list[str], row_id: str, first_seen: str, fingerprint: str) -> DataFrame:
    """row_id, duplicate_of: the root of the first earlier row in the block (first_seen, then id) whose fingerprint is within NEAR_BITS.

    The row found may itself be a repost; then its root counts, however far that is from the row.
    Rows of one block and fingerprint are one before the comparison, so copies never meet in pairs, and
    fingerprints meet only where one of BANDS parts is equal, which no near pair can avoid.
    A row counts as a root if no earlier row of its block is near it.
    """
    keyed = rows.where(F.col(fingerprint).isNotNull() & (F.col(fingerprint) != 0))
    groups = cut(keyed.groupBy(*block, fingerprint).agg(F.min(F.struct(first_seen, row_id)).alias("head")))
    width = 64 // BANDS
    bands = F.array(*[F.struct(F.lit(k).alias("n"), F.shiftrightunsigned(F.col(fingerprint), k * width).bitwiseAND((1 << width) - 1).alias("bits")) for k in range(BANDS)])
    banded = groups.select(*block, fingerprint, "head", F.explode(bands).alias("band"))
    a, b = (banded.select(*block, "band", F.col(fingerprint).alias(f"f{side}"), F.col("head").alias(f"h{side}")) for side in "ab")
    near = a.join(b, [*block, "band"]).where((F.col("hb") < F.col("ha")) & (hamming(F.col("fa"), F.col("fb")) <= NEAR_BITS))
    found = near.groupBy(*block, F.col("ha").alias("head")).agg(F.min("hb").alias("root"))
    chosen = _to_roots(found, block)
    linked = keyed.join(groups, [*block, fingerprint]).join(chosen, [*block, "head"], "left")
    target = F.coalesce(F.col("root"), F.col("head"))[row_id]
    return linked.select(F.col(row_id), F.when(target != F.col(row_id), target).alias("duplicate_of")).where("duplicate_of IS NOT NULL")


def _to_roots(links: DataFrame, block: list[str]) -> DataFrame:
    """links (block, head, root) with each root replaced by the end of its chain.

    Every round a root takes its own root, which halves the chains, so the number of rounds grows
    with the logarithm of the longest one. A root is earlier than its head, so there are no cycles.
    """
    links = cut(links)
    while True:
        up = links.select(*block, F.col("head").alias("root"), F.col("root").alias("higher"))
        step = cut(links.join(up, [*block, "root"], "left").select(*block, "head", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            return links


def changes(rows: DataFrame, key: list[str], order: list[str], content: Column) -> DataFrame:
    """rows with status against the row before it of the same key: 'new', 'updated' or 'unchanged'."""
    w = Window.partitionBy(*key).orderBy(*order)
    n, before = F.row_number().over(w), F.lag("_content").over(w)
    return rows.withColumn("_content", content).withColumn("status", F.when(n == 1, "new").when(before.eqNullSafe(F.col("_content")), "unchanged").otherwise("updated")).drop("_content")
