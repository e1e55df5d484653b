"""Free-typed values → entries of a reference list of places.

Every name, ASCII name and alternate name of the list is a path in one trie. A typed value loses its
wrapping (work mode, "office", "Greater … Area", postcode), is split into a name and its qualifiers,
and its name walks the trie as a Levenshtein automaton whose state is one row of edit distances (a
swap of neighbours is one edit): all entries within a distance that depends on the length come back,
aliases included. Qualifiers (region, country, by name or code) then decide among them.

The list is a reference table: below MAX_REFERENCE rows the trie is built once per Python worker, and as
values repeat, each worker keeps what it found. A longer list meets the distinct values in a join on
spellings with up to two letters left out, and each value's few candidates form a trie of their own.

Defined results
  null value                                   → null
  empty value, work mode, region or country    → -1
  a qualifier that contradicts the entry       → that entry is no candidate
  several entries equally near                 → the one with the larger population, then the smaller id
  names or codes with digits, short names      → must match exactly
  names cut short (five letters or more)       → the one place that begins so, if a stop marks the cut, or its region
                                                 or country stands beside it and no more than half of it is missing
  very long values                             → read whole; they are too far from any entry
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.folding import fold

MAX_REFERENCE = 200_000
#: Edits allowed from so many letters on.
REACH = ((7, 2), (5, 1))
#: Letters that a cut-off name must keep.
STEM = 5
# Abbreviated first words of place names.
SHORT_WORDS = {"mt": "mount", "ft": "fort", "st": "saint", "ste": "sainte", "lk": "lake", "pt": "port", "no": "north", "n": "north", "so": "south", "s": "south", "e": "east", "w": "west", "nw": "new"}
# Values that name no place, folded.
NOWHERE = frozenset(["", "remote", "hybrid", "onsite", "on-site", "anywhere", "worldwide", "distributed", "multiple locations", "various", "various locations", "tbd", "n/a", "global", "flexible"])
_MODES = r"(?:remote(?: ok)?|hybrid|on-?site|in office)"
_WRAPS = [
    (re.compile(rf"^{_MODES}\s*[-–—:]\s*(.+)$"), r"\1"),
    (re.compile(rf"^(.+?)\s*[-–—]\s*{_MODES}$"), r"\1"),
    (re.compile(rf"^(.+?)\s*\({_MODES}\)$"), r"\1"),
    (re.compile(rf"^{_MODES}\s*\((.+)\)$"), r"\1"),
    (re.compile(rf"^(?:{_MODES}\s+)?(?:based in|located in|in|near)\s+(.+)$"), r"\1"),
    (re.compile(r"^greater\s+(.+?)\s+area\b(.*)$"), r"\1\2"),
    (re.compile(r"^(.*?[^\s,])\s+(?:hq|headquarters|office|offices|campus)\b(.*)$"), r"\1\2"),
    (re.compile(r"^(.+?)\s+\d{4,6}(?:-\d{4})?$"), r"\1"),
    (re.compile(r"^(.+?)\s+\d{4,6}(\s*[,)(].*)$"), r"\1\2"),
]
PLACE = ["place_id", "place_name", "ascii_name", "alternates", "admin_code", "admin_name", "country_code", "country_name", "population"]


class Gazetteer:
    def __init__(self, rows: Iterable[tuple], regions: Iterable[str] = (), codes: Iterable[str] = ()):
        """rows: the columns of PLACE. regions, codes: those of the whole list, where rows are only a part of it."""
        self.places: dict[int, tuple[frozenset[str], int]] = {}
        self.exact: dict[str, set[int]] = {}
        self.regions: set[str] = set(regions)
        self.codes: set[str] = set(codes)
        self.root: dict = {}
        for place_id, name, ascii_name, alternates, admin_code, admin_name, country_code, country_name, population in rows:
            own = [fold(q) for q in (admin_code, admin_name, country_code, country_name) if q]
            self.places[place_id] = (frozenset(own), population or 0)
            self.regions.update(own)
            self.codes.update(fold(q) for q in (admin_code, country_code) if q)
            for spelling in {self.spelled_out(fold(s)) for s in [name, ascii_name, *(alternates or "").split(",")] if s and s.strip()}:
                self.exact.setdefault(spelling, set()).add(place_id)
        for spelling in self.exact:
            if not any(c.isdigit() for c in spelling):
                node = self.root
                for c in spelling:
                    node = node.setdefault(c, {})
                node[""] = spelling

    @staticmethod
    def spelled_out(name: str) -> str:
        words = name.split()
        if len(words) > 1:
            words[0] = SHORT_WORDS.get(words[0].rstrip("."), words[0])
        return " ".join(words)

    def within(self, name: str, most: int) -> list[tuple[int, str]]:
        """(edits, spelling) of all entries at most that far, by walking the trie with a row of distances.

        Cells further than ``most`` from the diagonal can't count, so a row has 2·most + 1 live cells.
        A branch ends when neither its row nor, for a swap still open, the row before can come within reach.
        """
        found: list[tuple[int, str]] = []
        n, far = len(name), most + 1
        first = [min(j, far) for j in range(n + 1)]
        stack = [(child, c, 1, first, first, "", 0) for c, child in self.root.items() if c]
        while stack:
            node, c, depth, before, older, last, least_before = stack.pop()
            row = [far] * (n + 1)
            if depth <= most:
                row[0] = depth
            least = row[0]
            low = depth - most if depth > most else 1
            for j in range(low, min(n, depth + most) + 1):
                y = name[j - 1]
                cost = before[j - 1]
                if c != y:
                    cost += 1
                    if before[j] < cost:
                        cost = before[j] + 1
                    if row[j - 1] < cost:
                        cost = row[j - 1] + 1
                    if y == last and j > 1 and older[j - 2] < cost and name[j - 2] == c:
                        cost = older[j - 2] + 1
                if cost < far:
                    row[j] = cost
                    if cost < least:
                        least = cost
            if row[n] <= most and "" in node:
                found.append((row[n], node[""]))
            if least <= most or least_before < most:
                depth += 1
                for d, child in node.items():
                    if d:
                        stack.append((child, d, depth, row, before, c, least))
        return found

    def beginning(self, stem: str) -> list[str]:
        node = self.root
        for c in stem:
            node = node.get(c)
            if node is None:
                return []
        found, stack = [], [node]
        while stack:
            node = stack.pop()
            for c, child in node.items():
                if c:
                    stack.append(child)
                else:
                    found.append(child)
        return found

    def parse(self, value: str) -> tuple[str, list[str]]:
        """The name and the qualifiers in a typed value, both folded."""
        text = fold(value).strip(" ,;|\"'")
        while True:
            less = text
            for pattern, kept in _WRAPS:
                less = pattern.sub(kept, less).strip(" ,;|")
            if less == text:
                break
            text = less
        if m := re.match(r"^(.+?)\s+[-–—]\s+(.+)$", text):
            left, right = m[1].strip(), m[2].strip()
            text = f"{right}, {left}" if left in self.regions else f"{left}, {right}" if right in self.regions else text
        parts = [p.strip(" .") if i else p.strip() for i, p in enumerate(re.split(r"\s*[,()]\s*", text))]
        parts = [p for p in parts if p]
        if not parts:
            return "", []
        name, rest = parts[0], parts[1:]
        words = name.split()
        if len(words) > 1 and words[-1] in self.codes and name not in self.exact:
            name, rest = " ".join(words[:-1]), [words[-1], *rest]
        return name, rest

    def fits(self, place_id: int, qualifiers: list[str]) -> bool:
        own = self.places[place_id][0]
        return all(q in own for q in qualifiers if q in self.regions)

    def best(self, spellings: Iterable[str], qualifiers: list[str]) -> int | None:
        ids = {i for s in spellings for i in self.exact[s] if self.fits(i, qualifiers)}
        return max(ids, key=lambda i: (self.places[i][1], -i), default=None)

    def find(self, value: str | None) -> int | None:
        if value is None:
            return None
        name, qualifiers = self.parse(value)
        if name in NOWHERE or not name:
            return -1
        full = self.spelled_out(name)
        if full in self.exact:
            found = self.best([full], qualifiers)
            return -1 if found is None else found
        if name in self.regions:
            return -1
        unknown = [q for q in qualifiers if q not in self.regions and q not in NOWHERE]
        most = next((d for n, d in REACH if len(full) >= n), 0)
        if most and not unknown and not any(c.isdigit() for c in full):
            near = self.within(full, most)
            for d in range(1, most + 1):
                found = self.best([s for e, s in near if e == d], qualifiers)
                if found is not None:
                    return found
        return -1 if unknown else self.cut_short(full, qualifiers)

    def cut_short(self, typed: str, qualifiers: list[str]) -> int:
        """The place whose name was cut off so, -1 if none or several fit."""
        stem, marked = typed.rstrip("."), typed.endswith(".")
        if len(stem) < STEM or not (marked or any(q in self.regions for q in qualifiers)):
            return -1
        grown = [s for s in self.beginning(stem) if s != stem and (marked or len(s) <= 2 * len(stem))]
        ids = {i for s in grown for i in self.exact[s] if self.fits(i, qualifiers)}
        if len(ids) == 1 or (ids and marked):
            return max(ids, key=lambda i: (self.places[i][1], -i))
        return -1


def reference_rows(places: DataFrame) -> DataFrame:
    return places.where("place_id IS NOT NULL").select(*PLACE).dropDuplicates(["place_id"])


_BUILT: dict[str, tuple[Gazetteer, dict[str, int]]] = {}
#: Values remembered per worker.
REMEMBERED = 200_000


def _finder(spark: SparkSession, rows: list[tuple]):
    """A vectorised function from typed values to place_ids."""
    shared = spark.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    @F.pandas_udf("bigint")
    def find(values: pd.Series) -> pd.Series:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = (Gazetteer(shared.value), {})
        gazetteer, known = _BUILT[name]
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            if v not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[v] = gazetteer.find(v)
            out.append(known[v])
        return pd.Series(out, dtype="Int64")

    return find


def map_places(values: DataFrame, value: str, places: DataFrame, out: str, most: int = MAX_REFERENCE) -> DataFrame:
    """values with the bigint column out: the place_id that the typed value means, -1 if none, null for null."""
    listed = reference_rows(places)
    rows = listed.limit(most + 1).collect()
    if len(rows) <= most:
        return values.withColumn(out, _finder(values.sparkSession, sorted(tuple(r) for r in rows))(F.col(f"`{value}`")))
    mapped = _by_join(values.select(F.col(f"`{value}`").alias("_v")).where("_v IS NOT NULL").distinct(), listed).withColumnRenamed("place_id", out)
    return values.join(mapped, values[value] == mapped["_v"], "left").drop("_v")


def _near_codes(name: str) -> list[str]:
    """What a name and an entry within reach, or of which it is the beginning, have in common."""
    most = next((d for n, d in REACH if len(name) >= n - 2), 0)
    found = {name}
    for _ in range(most):
        found |= {s[:i] + s[i + 1 :] for s in found for i in range(len(s))}
    return sorted(f"d:{s}" for s in found)


def _by_join(values: DataFrame, listed: DataFrame) -> DataFrame:
    """_v, place_id of distinct values, against a list of any length. Regions and countries are few beside places; they are broadcast."""
    named = listed.select(F.explode(F.array("admin_code", "country_code")).alias("q"), F.lit(True).alias("code")).unionByName(listed.select(F.explode(F.array("admin_name", "country_name")).alias("q"), F.lit(False).alias("code")))
    distinct = named.where("q IS NOT NULL").distinct().collect()
    regions, codes = {fold(r.q) for r in distinct}, {fold(r.q) for r in distinct if r.code}
    # a typed name longer than any entry and its edits is within reach of none
    longest = (listed.agg(F.max(F.greatest(*[F.length(c) for c in ("place_name", "ascii_name", "alternates")]))).first()[0] or 0) + len(max(SHORT_WORDS.values(), key=len)) + 2

    @F.pandas_udf("array<string>")
    def of_values(typed: pd.Series) -> pd.Series:
        reader = Gazetteer([], regions, codes)

        def keys(v: str) -> list[str]:
            name = reader.parse(v)[0]
            # also without the last word, which parse() takes for a code where the list has no such name
            names = {n for part in (name, name.rsplit(" ", 1)[0]) for n in (part, reader.spelled_out(part)) if len(n) <= longest}
            return sorted({k for n in names for k in _near_codes(n)} | {f"b:{n.rstrip('.')}" for n in names})

        return typed.map(keys)

    @F.pandas_udf("array<string>")
    def of_places(names: pd.Series) -> pd.Series:
        def keys(own: list[str]) -> list[str]:
            spelled = {Gazetteer.spelled_out(fold(n)) for n in own if n and n.strip()}
            return sorted({k for n in spelled for k in _near_codes(n)} | {f"b:{n[:i]}" for n in spelled for i in range(STEM, len(n))})

        return names.map(keys)

    @F.pandas_udf("bigint")
    def decide(typed: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([Gazetteer([tuple(c[k] for k in PLACE) for c in rows] if rows is not None else [], regions, codes).find(v) for v, rows in zip(typed, candidates)], dtype="Int64")

    spellings = F.concat(F.array("place_name", "ascii_name"), F.coalesce(F.split("alternates", ","), F.array()))
    entries = listed.select(F.struct(*PLACE).alias("p"), F.explode(of_places(spellings)).alias("key"))
    near = values.select("_v", F.explode(of_values("_v")).alias("key")).join(entries, "key").groupBy("_v").agg(F.collect_set("p").alias("found"))
    return values.join(near, "_v", "left").select("_v", decide("_v", "found").alias("place_id"))


def place_ids(value: Column, places: DataFrame) -> Column:
    """As map_places(), as a column; the list must be a reference table of MAX_REFERENCE rows at most."""
    rows = reference_rows(places).limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError("this list is too long for a column; use map_places")
    return _finder(places.sparkSession, sorted(tuple(r) for r in rows))(value)
