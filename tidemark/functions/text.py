"""Text normalisation, phrases, labels and stable hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that separates words.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def normalize(text: Column) -> Column:
    """Lower-cased words with one space between them; null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, NOT_WORD, " ")))


def plain_phrase(phrase: str) -> str:
    """normalize() of a literal, on the driver."""
    return "".join(c.lower() if c.isalnum() else " " for c in phrase).strip()


def contains_phrase(normalized: Column, phrase: str) -> Column:
    """Whether a phrase stands in normalised text as whole words; an empty phrase never does."""
    needle = " ".join(plain_phrase(phrase).split())
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(f" {needle} ") if needle else F.lit(False)


def first_phrase(normalized: Column, phrases: list[str]) -> Column:
    """The first phrase of the list, in list order, that the text contains; else null."""
    chain = F
    for p in phrases:
        chain = chain.when(contains_phrase(normalized, p), F.lit(p))
    return chain.otherwise(F.lit(None).cast("string")) if phrases else F.lit(None).cast("string")


def normalize_label(label: Column) -> Column:
    """Lower case, white space (also no-break) as single spaces, no trailing asterisks and colons."""
    return F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"(?U)\s+", " ")), r"[*: ]+$", ""))


# Phrases of employment kinds, the first in this order wins.
JOB_TYPES = [
    ("contract to hire", "contract_to_hire"), ("full time", "full_time"), ("fulltime", "full_time"), ("permanent", "full_time"), ("part time", "part_time"), ("parttime", "part_time"),
    ("internship", "internship"), ("intern", "internship"), ("co op", "internship"), ("apprenticeship", "apprenticeship"), ("apprentice", "apprenticeship"), ("per diem", "per_diem"),
    ("prn", "per_diem"), ("seasonal", "seasonal"), ("temporary", "temporary"), ("fixed term", "temporary"), ("contractor", "contract"), ("contract", "contract"), ("freelance", "freelance"),
]
# Spellings of work modes without spaces.
WORK_MODES = {"remote": "remote", "fullyremote": "remote", "hybrid": "hybrid", "onsite": "onsite", "inoffice": "onsite", "inperson": "onsite", "office": "onsite"}


def classify(normalized: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first rule whose phrase the normalised text contains."""
    chain = F
    for phrase, kind in rules:
        chain = chain.when(contains_phrase(normalized, phrase), F.lit(kind))
    return chain.otherwise(F.lit(None).cast("string"))


def job_type(text: Column) -> Column:
    return classify(normalize(text), JOB_TYPES)


def work_mode(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in WORK_MODES.items() for x in kv])
    return F.element_at(known, F.replace(normalize(text), F.lit(" "), F.lit("")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2))))


FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a_many(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of many byte strings at once, one column of bytes after the other."""
    state = np.full(len(texts), FNV_OFFSET, dtype=np.uint64)
    if not texts:
        return state
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    alive = len(texts)
    sorted_sizes = sizes[order]
    for k in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sorted_sizes, -k, side="left"))
        at = order[:alive]
        state[at] = (state[at] ^ flat[starts[at] + k].astype(np.uint64)) * FNV_PRIME
    return state


#: Shingles hashed at once.
CHUNK = 100_000


def _majorities(shingles: list[bytes], sizes: list[int]) -> np.ndarray:
    """One signed SimHash for each run of ``sizes`` shingles."""
    hashes = fnv1a_many(shingles)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = np.zeros(len(sizes), dtype=np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out |= (ones * 2 > np.array(sizes)).astype(np.uint64) << np.uint64(bit)
    return out.astype(np.int64)


def simhash_many(texts: list[list[str]]) -> list[int]:
    """64-bit SimHashes over shingles of three words, as signed integers; 0 for no words."""
    found: list[int] = [0] * len(texts)
    shingles: list[bytes] = []
    sizes: list[int] = []
    owners: list[int] = []
    for k, words in enumerate(texts):
        if words:
            own = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
            shingles += own
            sizes.append(len(own))
            owners.append(k)
        if sizes and (len(shingles) >= CHUNK or k == len(texts) - 1):
            for owner, value in zip(owners, _majorities(shingles, sizes).tolist()):
                found[owner] = value
            shingles, sizes, owners = [], [], []
    return found


def simhash_words(words: list[str]) -> int:
    return simhash_many([words])[0]


def fnv1a64(text: Column) -> Column:
    """Signed 64-bit FNV-1a of the UTF-8 bytes."""

    @F.pandas_udf("bigint")
    def hashed(s: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        filled = s.dropna()
        out[filled.index] = fnv1a_many([t.encode() for t in filled]).astype(np.int64)
        return out

    return hashed(text)


def simhash(normalized: Column) -> Column:
    """SimHash of normalised text, the whole text; null stays null."""

    @F.pandas_udf("bigint")
    def hashed(s: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        filled = s.dropna()
        out[filled.index] = simhash_many([t.split() for t in filled])
        return out

    return hashed(normalized)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
