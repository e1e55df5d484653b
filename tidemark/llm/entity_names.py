"""Variant spellings of organisation names → clusters.

A name is folded, stripped of legal forms and decorations, and read as a trade (with the nickname
table for abbreviations) and sorted name tokens. Names that read alike are one key. Keys of a trade
meet in blocks: the phonetic code of the sorted tokens, and the tokens with up to two letters left
out, which every two spellings within two edits have in common (long names: the pieces that two edits
must leave whole). A phonetic block holds only spellings
that differ in vowels and like sounds, a leave-out block only the spellings two letters away from it;
repeated rows don't enlarge either. Pairs in a block are compared by Jaro–Winkler and edit distance:
one or two slips of typing link. Letter pairs that well-attested names lack are further evidence of a
misspelling; with them, edits that are no slips link too. A spelling near several better attested ones follows the closest; all links between spellings
without such a one count. Cut-off names and names without trade components of the accepted links are the entities.

Defined results
  null, empty and white-space names, words that hide the employer  → no entity
  repeated rows                                                    → count once
  a name without trade that two organisations share                → an entity of its own spelling
  a misspelt or cut-off one that is as close to two organisations  → an entity of its own spelling
  a cut-off name that continues in two ways                        → an entity of its own spelling
  names in any script                                              → tokens of their letters; sounds are those of Latin letters
  very long names                                                  → read whole, blocked by pieces, compared like the others
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folding import fold
from tidemark.llm.components import connected_components
from tidemark.llm.strings import edits, jaro_winkler, slips, sound
from tidemark.session import cut

# Words that hide the employer, folded and without punctuation.
HIDING = frozenset(["confidential", "n a", "na", "none", "null", "stealth", "stealth startup", "stealth mode", "stealth company", "stealth mode startup", "undisclosed", "undisclosed employer", "undisclosed company", "unknown", "anonymous", "private", "private employer", "company confidential", "confidential company", "confidential employer", "hidden", "tbd", "various"])
# Legal forms at the end of a name.
LEGAL = frozenset(["inc", "incorporated", "llc", "ltd", "limited", "gmbh", "plc", "corp", "corporation", "co", "company", "sa", "ag", "bv", "sarl", "srl", "pty"])
# Words around a name that don't belong to it.
AROUND = frozenset(["the", "team", "careers", "jobs", "recruiting", "hiring", "hub", "hq", "emea", "apac", "holding"])
# Trades as sequences of words.
TRADES = [
    "aerospace", "analytics", "biosciences", "construction", "consulting partners", "dental", "energy", "engineering", "financial services", "foods",
    "freight lines", "health", "insurance", "international", "laboratories", "learning", "logistics", "manufacturing", "medical group", "networks",
    "robotics", "security", "software", "systems", "technologies", "university", "bank", "solutions", "media", "studios", "pharmaceuticals", "motors", "airlines", "capital", "ventures", "consulting", "partners", "services", "group",
]
# Nicknames of trade words that no rule of abbreviation gives.
NICKNAMES = {"sw": "software", "mg": "medical group", "fs": "financial services", "cp": "consulting partners", "fl": "freight lines", "labs": "laboratories", "bk": "bank", "u": "university", "uni": "university", "univ": "university", "int l": "international", "intl": "international", "tech": "technologies", "techs": "technologies", "bio": "biosciences", "bio sciences": "biosciences", "foodz": "foods", "robotix": "robotics", "energie": "energy", "analitics": "analytics", "mfg": "manufacturing", "mfrs": "manufacturing", "engrg": "engineering", "sys": "systems", "sec": "security", "ins": "insurance", "cons": "consulting", "ln": "lines", "grp": "group", "frt": "freight", "fin": "financial", "med": "medical", "svcs": "services", "ptnrs": "partners"}
# Nicknames of persons, each list led by the full name.
PERSONS = [
    ["alexander", "alex", "sasha"], ["andrew", "andy", "drew"], ["anthony", "tony"], ["benjamin", "ben", "benny"], ["catherine", "katherine", "kate", "katie", "cathy", "kathy"], ["charles", "charlie", "chuck"], ["christopher", "chris"],
    ["daniel", "dan", "danny"], ["david", "dave"], ["deborah", "debbie", "deb"], ["edward", "ed", "eddie", "ted"], ["elizabeth", "liz", "lizzie", "beth", "betty"], ["frederick", "fred", "freddy"], ["gregory", "greg"], ["james", "jim", "jimmy"],
    ["jennifer", "jen", "jenny"], ["john", "jack", "johnny"], ["joseph", "joe", "joey"], ["joshua", "josh"], ["kenneth", "ken", "kenny"], ["lawrence", "larry"], ["margaret", "maggie", "peggy", "meg"], ["matthew", "matt"], ["michael", "mike", "mick"],
    ["nicholas", "nick"], ["patricia", "pat", "patty"], ["peter", "pete"], ["rebecca", "becky"], ["richard", "dick", "rick", "rich"], ["robert", "bob", "bobby", "rob", "robbie"], ["ronald", "ron"], ["samuel", "sam", "sammy"], ["stephen", "steven", "steve"],
    ["susan", "sue", "susie"], ["theodore", "theo"], ["thomas", "tom", "tommy"], ["timothy", "tim"], ["victoria", "vicky"], ["william", "bill", "billy", "will", "willy"], ["zachary", "zach"],
]
_PERSON = {short: names[0] for names in PERSONS for short in names[1:]}
_TRADE_WORDS = sorted({w for t in TRADES for w in t.split()})


def _abbreviates(short: str, word: str) -> bool:
    """short is a beginning of word of three letters or more, or its letters in order from the same start to the same kind of end."""
    if len(short) < 3 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    letters = iter(word)
    vowels = sum(c in "aeiou" for c in short)
    return len(short) >= len(word) // 3 and vowels <= sum(c in "aeiou" for c in word) / 2 and all(c in letters for c in short) and (short[-1] == word[-1] or short[-1] == word[-2])


def _trade_word(token: str) -> str | None:
    """The trade word a token stands for: exactly, by nickname, abbreviation or one or two slips."""
    if token in _TRADE_WORDS:
        return token
    if token in NICKNAMES:
        return NICKNAMES[token]
    begun = [w for w in _TRADE_WORDS if len(token) >= 3 and w.startswith(token)]
    if len(begun) == 1:
        return begun[0]
    if len(token) >= 4:
        near = min((edits(token, w, 2), -jaro_winkler(token, w), w) for w in _TRADE_WORDS)
        if near[0] <= (2 if len(near[2]) >= 6 else 1 if len(near[2]) == 5 or token[0] == near[2][0] else 0):
            return near[2]
    short = [w for w in _TRADE_WORDS if _abbreviates(token, w)]
    return short[0] if len(short) == 1 else None


_CACHE: dict[str, str | None] = {}


def _trade_of(words: list[str]) -> str | None:
    """A trade that these one or two words spell."""
    joined = " ".join(words)
    if joined in _CACHE:
        return _CACHE[joined]
    if joined in TRADES:
        found = joined
    elif joined in NICKNAMES and NICKNAMES[joined] in TRADES:
        found = NICKNAMES[joined]
    else:
        parts = [_trade_word(w) for w in words]
        said = " ".join(p for p in parts if p) if all(parts) else None
        if len(words) == 2 and said not in TRADES:
            said = next((t for t in TRADES if " " in t and any(parts[i] == t.split()[i] and edits(words[1 - i], t.split()[1 - i], 2) <= 2 for i in (0, 1))), None)
        found = said if said in TRADES else None
    if len(_CACHE) < 1_000_000:
        _CACHE[joined] = found
    return found


def read_name(name: str | None) -> tuple[str | None, str | None, str | None]:
    """(trade, sorted name tokens, first name token); all None where the name names nobody."""
    if name is None or not name.strip():
        return None, None, None
    text = html.unescape(html.unescape(name))
    text = re.sub(r"\[[^\[\]]*\]|\([^()]*\)", " ", text)
    if not re.search(r"\s", text.strip()):
        text = re.sub(r"([a-zà-ÿ])(and|of)(?=[A-Z])", r"\1 \2 ", text)
        text = re.sub(r"([a-zà-ÿ])(?=[A-Z])", r"\1 ", text)
    text = fold(text)
    tokens = re.findall(r"[^\W_]+|[&+]", text)
    if " ".join(t for t in tokens if t not in "&+") in HIDING:
        return None, None, None
    tokens = ["&" if t in ("and", "+") else "of" if t == "fo" else t for t in tokens]
    while len(tokens) > 1 and (tokens[-1] in LEGAL or tokens[-1] in AROUND or tokens[-1] == "&" or (tokens[-1] == "a" and tokens[-2] == "s")):
        tokens = tokens[:-2] if tokens[-1] == "a" and tokens[-2] == "s" else tokens[:-1]
    while len(tokens) > 1 and tokens[0] in AROUND:
        tokens = tokens[1:]
    trade = None
    if len(tokens) > 2 and tokens[1] != "of" and len(tokens[1]) <= 3 and edits(tokens[1], "of", 1) <= 1 and _trade_of(tokens[:1]) in ("university", "bank"):
        tokens[1] = "of"
    if "of" in tokens[1:3] and (kind := _trade_of(tokens[: tokens.index("of")])) in ("university", "bank"):
        trade, tokens = kind, tokens[tokens.index("of") + 1 :]
    else:
        for k in (2, 1):
            if len(tokens) > k and (found := _trade_of(tokens[-k:])) and tokens[-k - 1] != "&":
                trade, tokens = found, tokens[:-k]
                break
            if len(tokens) > k and (found := _trade_of(tokens[:k])) and tokens[k] != "&":
                trade, tokens = found, tokens[k:]
                break
    words = [t for t in tokens if t not in ("&", "of")]
    if not words:
        return None, None, None
    # a nickname stands for a person where another name stands beside it
    if len(words) > 1:
        words = [_PERSON.get(w, w) for w in words]
    return trade or "", " ".join(sorted(words)), words[0]


READ = "struct<trade string, core string, lead string>"


def _read(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(n) for n in names], columns=["trade", "core", "lead"])


#: Cores with more letters are blocked by pieces of PIECE letters.
LONG, PIECE = 40, 12


def codes(core: str) -> list[str]:
    """The blocks of a core. Two cores within two edits have one in common, those of four letters within one."""
    found = ["s:" + " ".join(sound(t) for t in core.split())]
    # both kinds around LONG, where one of the two cores may be on either side
    if len(core) > LONG - 2:
        # two edits leave the first, the last or the middle piece whole, the middle one moved by a letter at most
        middle = [core[PIECE + k : 2 * PIECE + k] for k in (0, 1, 2)]
        found += [f"a:{core[:PIECE]}", f"z:{core[-PIECE:]}", *sorted({f"m:{m}" for m in middle})]
    if len(core) <= LONG + 2:
        one = {core[:i] + core[i + 1 :] for i in range(len(core))} if len(core) >= 4 else set()
        two = {s[:i] + s[i + 1 :] for s in one for i in range(len(s))} if len(core) >= 5 else set()
        found += sorted("d:" + s for s in one | two | {core})
    return found


def _blocks(cores: pd.Series) -> pd.Series:
    return cores.map(codes)


def _closeness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Edits between two spellings token by token (9 if they are too far apart), Jaro–Winkler, and whether every edit is a slip of typing."""

    def close(x: str, y: str) -> tuple[int, float, bool]:
        xs, ys = x.split(), y.split()
        far = [edits(s, t, 2) for s, t in zip(xs, ys)] if len(xs) == len(ys) else [9]
        if sum(far) > 2:
            return 9, 0.0, False
        # two edits in so many letters are alike by any measure; Jaro–Winkler takes quadratic time
        score = jaro_winkler(x, y) if len(x) <= LONG else 1 - sum(far) / len(x)
        return sum(far), score, sum(slips(s, t, 2) for s, t in zip(xs, ys)) == sum(far)

    return pd.DataFrame([close(x, y) for x, y in zip(a, b)], columns=["edits", "score", "slip"])


#: Jaro–Winkler from which two spellings in a block link: at one edit, at two slips, and at two edits of an odd spelling.
CLOSE, CLOSE_SLIPS, CLOSE_TWO = 0.8, 0.9, 0.75
#: Letters that a cut-off name must keep.
STEM = 4
#: A pair of letters is odd below this share of all pairs in well-attested names.
ODD = 0.001


def _stems(core: str) -> Column:
    """The beginnings of a core, of LONG letters at most; whether a longer name begins it is left to the comparison."""
    return F.expr(f"transform(sequence({STEM}, least(length({core}) - 1, {LONG})), i -> left({core}, i))")


def _odd_check(known: dict[str, int]):
    least = max(2.0, ODD * sum(known.values()))

    def odd(cores: pd.Series) -> pd.Series:
        return pd.Series([any(c[i : i + 2].isascii() and known.get(c[i : i + 2], 0) < least for i in range(len(c) - 1)) for c in cores], dtype=bool)

    return odd


def _accepted() -> Column:
    """Whether a pair with edits, score, slip and odd_a links."""
    one = (F.col("edits") == 1) & (F.col("score") >= CLOSE) & (F.col("slip") | F.col("odd_a"))
    two = (F.col("edits") == 2) & ((F.col("slip") & (F.col("score") >= CLOSE_SLIPS)) | (F.col("odd_a") & (F.col("score") >= CLOSE_TWO)))
    return one | two


def _join_bare(bare: DataFrame, alias: DataFrame, odd) -> DataFrame:
    """key, entity of names without trade (key, core, forms, component) that are spelt like no alias (component, core).

    Slips of each other are one name. It joins the organisation whose alias is the closest, if one
    alone is; failing that, the one name or organisation that it is a cut-off of and less attested than.
    """
    targets = cut(bare.select(F.col("key").alias("key_b"), F.col("core").alias("core_b"), F.col("forms").alias("forms_b"), F.lit(None).cast("string").alias("owner")).unionByName(
        alias.select(F.lit(None).cast("string").alias("key_b"), F.col("core").alias("core_b"), F.lit(None).cast("long").alias("forms_b"), F.col("component").alias("owner"))))
    blocks = F.pandas_udf(_blocks, "array<string>")
    a = bare.select(F.col("key").alias("key_a"), F.col("core").alias("core_a"), odd("core").alias("odd_a"), F.explode(blocks("core")).alias("block"))
    b = targets.select("core_b", F.explode(blocks("core_b")).alias("block")).distinct()
    pairs = a.join(b, "block").where("core_a <> core_b").drop("block").distinct()
    near = pairs.withColumn("c", F.pandas_udf(_closeness, "struct<edits int, score double, slip boolean>")("core_a", "core_b")).select("*", "c.*").where(_accepted())
    near = cut(near.join(targets, "core_b").select("key_a", "key_b", "owner", "edits"))
    groups = connected_components(bare.select(F.col("key").alias("node")), near.where("owner IS NULL").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).withColumnRenamed("component", "group")
    # the closest organisations of each group of spellings
    owners = near.where("owner IS NOT NULL").join(groups, F.col("key_a") == F.col("node")).groupBy("group", "edits").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("rivals"))
    owners = owners.groupBy("group").agg(F.min_by(F.struct("owner", "rivals"), "edits").alias("o")).select("group", F.when(F.col("o.rivals") == 1, F.col("o.owner")).otherwise(F.col("group")).alias("joined"))
    found = cut(groups.join(owners, "group", "left").select(F.col("node").alias("key"), "group", F.coalesce("joined", "group").alias("entity"), F.col("joined").isNotNull().alias("decided")))
    # cut-off names
    grown = targets.where(f"instr(core_b, ' ') = 0 AND length(core_b) > {STEM}").select("key_b", "core_b", "forms_b", "owner", F.explode(_stems("core_b")).alias("stem"))
    ends = bare.withColumn("stem", F.left("core", F.lit(LONG))).join(grown, "stem").where("startswith(core_b, core) AND core_b <> core AND (owner IS NOT NULL OR forms_b > forms)").join(found.select(F.col("key").alias("key_b"), F.col("entity").alias("other")), "key_b", "left")
    ends = ends.select("key", F.coalesce("owner", "other").alias("meant")).join(found.where("NOT decided"), "key").where("meant <> entity")
    ends = ends.groupBy("group").agg(F.min("meant").alias("meant"), F.count_distinct("meant").alias("n")).where("n = 1")
    return found.join(ends, "group", "left").select("key", F.coalesce("meant", "entity").alias("entity"))


def link_names(names: DataFrame, name: str) -> DataFrame:
    """name, entity: each distinct name that names somebody, and the id of its cluster."""
    distinct = names.select(F.col(f"`{name}`").cast("string").alias("name")).where("name IS NOT NULL").distinct()
    read = distinct.withColumn("r", F.pandas_udf(_read, READ)("name")).where("r.core IS NOT NULL").select("name", "r.*").withColumn("key", F.concat_ws("|", "trade", "core"))
    read = cut(read)
    keys = cut(read.groupBy("key", "trade", "core").agg(F.count("*").alias("forms"), F.min("lead").alias("lead")))
    # Latin letter pairs of well-attested names: at most 37 x 37 rows
    letters = keys.where("forms >= 3").select(F.explode(F.expr("transform(sequence(1, greatest(length(core) - 1, 1)), i -> substring(core, i, 2))")).alias("two"))
    known = {r.two: r["count"] for r in letters.where("two RLIKE '^[a-z0-9 ]{2}$'").groupBy("two").count().collect()}
    named = keys.where("trade <> ''").withColumn("odd", F.pandas_udf(_odd_check(known), "boolean")("core"))
    # slips: keys of one trade in a common block
    blocked = named.select("trade", "key", "core", "forms", "odd", F.explode(F.pandas_udf(_blocks, "array<string>")("core")).alias("block"))
    a, b = (blocked.select("trade", "block", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "core", "forms", "odd")]) for side in "ab")
    # leaving out up to two letters finds every pair two edits apart
    pairs = a.join(b, ["trade", "block"]).where("key_a <> key_b AND forms_a <= forms_b").drop("trade", "block").distinct()
    scored = pairs.withColumn("c", F.pandas_udf(_closeness, "struct<edits int, score double, slip boolean>")("core_a", "core_b")).select("*", "c.*")
    # an odd pair says nothing between names equally attested, unless both were seen in one form only
    scored = scored.withColumn("odd_a", F.expr("odd_a AND (forms_a < forms_b OR forms_b = 1)"))
    # cut-off names: the one key of the trade that begins like it
    single = named.where("instr(core, ' ') = 0")
    grown = single.where(f"length(core) > {STEM}").select("trade", F.col("key").alias("key_b"), F.col("core").alias("core_b"), F.col("forms").alias("forms_b"), F.explode(_stems("core")).alias("stem"))
    short = single.where(f"length(core) >= {STEM}").select("trade", F.col("key").alias("key_a"), F.col("forms").alias("forms_a"), F.explode(F.expr("array_distinct(array(core, regexp_replace(core, 'y$', '')))")).alias("begins")).withColumn("stem", F.left("begins", F.lit(LONG)))
    ends = short.join(grown, ["trade", "stem"]).where("startswith(core_b, begins) AND core_b <> begins AND forms_b >= forms_a AND key_a <> key_b")
    # a continuation is no slip, and beginnings of two names may look like slips of each other
    begun = ends.where("length(core_b) >= length(begins) + 2").select("key_a").distinct()
    longer = lambda x, y: f"(instr({x}, ' ') = 0 AND startswith({y}, {x}) AND length({y}) >= length({x}) + 2)"
    both = begun.withColumn("begun_a", F.lit(True)), begun.select(F.col("key_a").alias("key_b"), F.lit(True).alias("begun_b"))
    slipped = scored.where(_accepted()).where(f"NOT {longer('core_a', 'core_b')} AND NOT {longer('core_b', 'core_a')}")
    near = cut(slipped.join(both[0], "key_a", "left").join(both[1], "key_b", "left").where("begun_a IS NULL OR begun_b IS NULL").select("key_a", "key_b", "forms_a", "forms_b", "edits", "score"))
    closest = F.max_by("key_b", F.struct(-F.col("edits"), "forms_b", "score", "key_b"))
    # a key near several better attested names is a spelling of the closest one
    leaders = near.where("forms_a < forms_b").groupBy("key_a").agg(closest.alias("key_b"))
    # of keys equally attested, those that have such a name of their own follow it, the others link with all like them
    even = near.where("forms_a = forms_b")
    even = even.unionByName(even.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "forms_a", "forms_b", "edits", "score")).distinct()
    # continuations that are spellings of one name count as that one
    first = even.groupBy("key_a").agg(F.min("key_b").alias("even"))
    meant = leaders.join(first, "key_a", "full").select(F.col("key_a").alias("key_b"), F.coalesce("key_b", F.least("key_a", "even")).alias("meant"))
    ends = ends.join(meant, "key_b", "left").select("key_a", F.coalesce("meant", "key_b").alias("key_b"), "forms_b").groupBy("key_a", "key_b").agg(F.max("forms_b").alias("forms_b")).where("key_a <> key_b")
    best = ends.groupBy("key_a").agg(F.count_if(F.col("forms_b") > 1).alias("well"), F.count("*").alias("n"), F.max_by("key_b", F.struct("forms_b", "key_b")).alias("key_b"))
    cuts = best.where("well = 1 OR (well = 0 AND n = 1)").select("key_a", "key_b")
    led = cut(cuts.unionByName(leaders.join(cuts.select("key_a"), "key_a", "left_anti")))
    even = even.join(led.select("key_a"), "key_a", "left_anti").join(led.select(F.col("key_a").alias("key_b"), F.lit(True).alias("led")), "key_b", "left")
    follow = even.where("led").groupBy("key_a").agg(closest.alias("key_b"))
    links = led.unionByName(follow).unionByName(even.where("led IS NULL").select("key_a", "key_b"))
    entities = connected_components(keys.select(F.col("key").alias("node")), links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    grouped = keys.join(entities, keys.key == entities.node).select("key", "trade", "core", "lead", "forms", "component")
    # names without trade: the one entity whose leading name or whole name they are, or that they are a misspelling of
    full = grouped.where("trade <> ''")
    alias = full.select("component", F.explode(F.array_distinct(F.array("core", "lead"))).alias("core")).distinct()
    alias = cut(alias)
    owner = alias.groupBy("core").agg(F.min("component").alias("owner"), F.count("*").alias("rivals")).where("rivals = 1").select("core", "owner")
    bare = cut(grouped.where("trade = ''").join(alias.select("core").distinct().withColumn("spelt", F.lit(True)), "core", "left"))
    joined = bare.where("spelt").join(owner, "core", "left").select("key", F.coalesce("owner", "component").alias("entity"))
    others = bare.where("spelt IS NULL").select("key", "core", "forms", "component")
    if not others.isEmpty():
        joined = joined.unionByName(_join_bare(others, alias, F.pandas_udf(_odd_check(known), "boolean")))
    all_keys = full.select("key", F.col("component").alias("entity")).unionByName(joined)
    return read.select("name", "key").join(all_keys, "key").select("name", "entity")


#: Names of an entity that one task pairs with all others of it.
PAIRED = 1000


def entity_pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: every unordered pair within an entity, name_a first in byte order.

    The names of a large entity are spread over as many parts as it has PAIRED of them.
    """
    parts = linked.groupBy("entity").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    sized = linked.join(parts, "entity")
    a = sized.select("entity", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = sized.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("name_b"))
    return a.join(b, ["entity", "part"]).where(F.encode("name_a", "UTF-8") < F.encode("name_b", "UTF-8")).select("name_a", "name_b")
