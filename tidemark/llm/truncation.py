"""Texts cut off by field limits or in transfer.

Two kinds of evidence, both taken over all documents, the limits first:

Hidden limits. The length of every text is worked out again under alternative encodings
(characters, UTF-8 bytes, UTF-16 units, entity escaping, JSON escaping, CRLF line ends and their
combinations). Grouped by source and encoding, a field limit shows as a length at which several times
more different texts end than at the lengths around it, most of them without an end of their own. A
text at a limit that has no end of its own was cut by it.

Endings. What the limits leave open, such as cuts in transfer at any length, is judged by how it ends. A text that ends in a mark of truncation (ellipsis, "[truncated]", half an entity, tag or
escape, a broken character, a dangling hyphen) was cut. One that ends in terminal punctuation is
complete. Every other ending is held against all lines of the corpus: its last three words (two,
where three were never met) either also end lines without punctuation, like list items, headings and
sign-offs do, or are always followed by more words, like the middle of a sentence or a broken word.

Defined results
  null, empty and white-space texts             → not cut, they have no ending
  complete text exactly as long as a limit      → not cut
  text at a limit without terminal punctuation  → cut, as is one at a limit with white space behind it
  copies of a text                              → count once in the statistics of endings
  very long texts                               → read whole
  null source, null owner                       → a source of its own, no owner
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folding import fold
from tidemark.session import cut, salted_join

#: A word is common from this share of texts on, and in three texts at least.
COMMON_SHARE = 0.0005
#: A limit: so many times the mean number of texts at the lengths around, within so many, and this share of them without an end.
LIMIT_TIMES, LIMIT_AROUND, LIMIT_OPEN = 6, 20, 0.5
#: Share of a context's occurrences that must end a line for the context to be an ending.
ENDS_SHARE = 0.05
#: Contexts kept in a worker before it hands them on.
HELD = 400_000

_MARKS = re.compile(r"(?:(?:…|\.\.\.) ?\(?(?:read |see |show )?more\)?|(?:…|\.\.\.) ?continue(?:d| reading)|…|\.\.\.|\[(?:\.\.\.|…|truncated|more|cut|continued)\]|\((?:truncated|continued|more)\)|�|[^\W\d_]-|[,;&\\/(\[{<–—=]|&(?:#\w{0,7}|amp?|lt|gt|quot?|nbsp?|apos?)|<[^<>\n]{1,80}|\\u[0-9a-fA-F]{0,4})$", re.I)
_TERMINAL = re.compile(r"[.!?。！？]['\"”’»)\]*_]*$|[)\]\"”’»]$")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_BULLET = re.compile(r"^\s*(?:[-*•–·]|\d{1,2}[.)])\s+")
_PARTS = re.compile(r"[|•\t]| / ")
# Abbreviations whose stop ends no sentence.
SHORT = ["Ref", "No", "Nr", "St", "Mr", "Ms", "Dr", "vs", "e.g", "i.e"]
_SENTENCE = re.compile(r"(?<=[.!?])" + "".join(rf"(?<!\b{re.escape(a)}\.)" for a in SHORT) + r"\s+")


def _tokens(part: str, common: frozenset[str] | None) -> list[str]:
    found = ["#" if t[0].isdigit() else t for t in _TOKEN.findall(part.lower())]
    return found if common is None else [t if t == "#" or t in common else "<x>" for t in found]


def segments(text: str, common: frozenset[str]) -> Iterator[tuple[list[str], bool]]:
    """(words behind two start marks, whether terminal punctuation ends them) of every sentence, list item and line."""
    for line in text.split("\n"):
        start = "^-" if _BULLET.match(line) else "^"
        for part in _PARTS.split(_BULLET.sub("", line)):
            for sentence in _SENTENCE.split(part.strip()):
                if words := _tokens(sentence, common):
                    yield ["^^", start, *words], bool(_TERMINAL.search(sentence.rstrip()))
                start = "^"


def _h(words: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


def _is_signature(line: str, common: frozenset[str], owner: str) -> bool:
    """A line of capitalised words alone that holds a name, and whose last word is whole: it is known or stands in the owner's token."""
    words = [w for w in _TOKEN.findall(line) if w.lower() not in ("of", "and", "ref")]
    if not words or len(words) > 6 or _BULLET.match(line) or _PARTS.search(line) or not all(w[0].isupper() for w in words):
        return False
    named = [w.lower() not in common or len(w) > 3 and w.lower() in owner for w in words]
    last = words[-1].lower()
    return any(named) and (len(words) > 1 and last in common or len(last) > 3 and last in owner)


def ending(text: str | None, common: frozenset[str], owner: str | None = None) -> tuple[str, int | None, int | None, bool, bool]:
    """('none' | 'cut' | 'complete' | 'padded' | 'open', hashes of the last three and two words, whether no line can end so, whether the line is a plain one).

    padded: complete, with white space behind it. No line ends so: sentences stand before it in its line, or its last word is a rare one.
    """
    bare = text.rstrip() if text else ""
    if not bare:
        return "none", None, None, False, False
    if _MARKS.search(bare):
        return "cut", None, None, False, False
    if _TERMINAL.search(bare):
        return "complete" if bare == text else "padded", None, None, False, False
    line = bare.rsplit("\n", 1)[-1]
    if _is_signature(line, common, "".join(_TOKEN.findall(fold(owner))) if owner else ""):
        return "complete", None, None, False, False
    last = None
    for last in segments(line, common):
        pass
    if last is None:
        return "open", _h(("^^", "^", "")), _h(("^", "")), False, True
    words = last[0]
    return "open", _h(tuple(words[-3:])), _h(tuple(words[-2:])), len(_SENTENCE.split(line)) > 1 or words[-1] == "<x>", not _BULLET.match(line)


# The encodings of lengths(), in its order.
ENCODINGS = ["characters", "utf8", "utf16", "characters_crlf", "utf8_crlf", "entities", "entities_utf8", "entities_quotes", "entities_crlf", "json", "json_utf8", "json_ascii"]


def lengths(text: str) -> list[int]:
    """The text's length under each of ENCODINGS."""
    n = len(text)
    utf8 = n if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    astral = 0 if utf8 == n else len(text.encode("utf-16-le", "surrogatepass")) // 2 - n
    wide = 0 if utf8 == n else sum(c > "\x7f" for c in text)
    lines, amp, angle, quote = text.count("\n"), text.count("&"), text.count("<") + text.count(">"), text.count('"')
    escaped, json = amp * 4 + angle * 3, quote + text.count("\\") + lines + text.count("\t") + text.count("\r")
    return [n, utf8, n + astral, n + lines, utf8 + lines, n + escaped, utf8 + escaped, n + escaped + quote * 5, n + escaped + lines, n + json, utf8 + json, n + astral + (wide + astral) * 5 + json]


def hidden_limits(sized: DataFrame) -> DataFrame:
    """source, encoding, length of every field limit. sized: source, sizes as lengths() gives them, and if known copy (what equal texts share) and ends (whether a text has an end of its own).

    Relative to the lengths around, so that it holds for small and large sources alike; half a text is
    added to their mean, as an empty neighbourhood is no proof, so three texts are the fewest that show a limit.
    """
    once = sized.dropDuplicates(["source", "copy"]) if "copy" in sized.columns else sized
    by = once.select("source", F.col("ends") if "ends" in sized.columns else F.lit(False).alias("ends"), F.posexplode("sizes").alias("encoding", "length")).where("length > 0")
    counts = by.groupBy("source", "encoding", "length").agg(F.count("*").alias("texts"), F.count_if(~F.col("ends")).alias("open"))
    near = Window.partitionBy("source", "encoding").orderBy("length").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    around = counts.withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / (2 * LIMIT_AROUND))
    return around.where((F.col("texts") >= LIMIT_TIMES * (F.col("around") + 0.5)) & (F.col("open") >= LIMIT_OPEN * F.col("texts"))).select("source", "encoding", "length", "texts")


def common_words(texts: DataFrame, text: str) -> frozenset[str]:
    """The words of at least COMMON_SHARE of the texts, all of them: no more than a text has words over that share, however many texts there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        n = 0
        for batch in batches:
            for t in batch.iloc[:, 0]:
                seen.update(set(_tokens(t, None)))
                n += 1
            if len(seen) > HELD:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": ["", *seen], "n": [n, *seen.values()]})

    totals = cut(texts.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    docs = (totals.where("word = ''").first() or {"n": 0})["n"]
    rows = totals.where((F.col("word") != "") & (F.col("n") >= max(3, COMMON_SHARE * docs))).select("word").collect()
    return frozenset(r.word for r in rows)


def _contexts(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        held: dict[tuple[str, ...], list[int]] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(_h(c), *v) for c, v in held.items()], columns=["h", "bare", "stopped", "more"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.iloc[:, 0]:
                rows = list(segments(t, common))
                for at, (words, stopped) in enumerate(rows):
                    last = len(words) - 1
                    for i in range(2, len(words)):
                        # how the text itself ends is counted apart, once for all copies
                        kind = 2 if i < last else 1 if stopped else 0
                        if i == last and kind == 0 and at == len(rows) - 1:
                            continue
                        for c in (tuple(words[i - 2 : i + 1]), tuple(words[i - 1 : i + 1])):
                            held.setdefault(c, [0, 0, 0])[kind] += 1
            if len(held) > HELD:
                yield hand_on()
        yield hand_on()

    return count


def cut_texts(texts: DataFrame, doc_id: str, text: str, source: str, owner: str | None = None) -> DataFrame:
    """doc_id, source, reason ('mark', 'limit', 'ending') of every text that was cut before its end.

    owner: a column whose value holds the words of the name that signs the text, such as a board's token.
    """
    signed = F.col(f"`{owner}`").cast("string") if owner else F.lit(None).cast("string")
    texts = texts.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"), signed.alias("owner")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = texts.sparkSession.sparkContext.broadcast(common_words(texts, "text"))

    @F.pandas_udf("struct<status string, h3 long, h2 long, prose boolean, plain boolean, sizes array<int>>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, owners in batches:
            yield pd.DataFrame([(*ending(t, shared.value, o), lengths(t)) for t, o in zip(bodies, owners)], columns=["status", "h3", "h2", "prose", "plain", "sizes"]).astype({"h3": "Int64", "h2": "Int64"})

    every = cut(texts.select("doc_id", "source", read("text", "owner").alias("e"), F.md5("text").alias("copy")).select("doc_id", "source", "e.*", "copy"))
    ends = every.where("status IN ('open', 'cut', 'padded')")
    counts = texts.select("text").mapInPandas(_contexts(shared), "h long, bare long, stopped long, more long").groupBy("h").agg(F.sum("bare").alias("bare"), F.sum("stopped").alias("stopped"), F.sum("more").alias("more"))
    # open endings by context, copies once
    finals = ends.where("status = 'open'").select(F.explode(F.array("h3", "h2")).alias("h"), "copy").distinct().groupBy("h").agg(F.count("*").alias("final"))
    known = cut(finals.join(counts, "h", "left").na.fill(0))
    by = lambda k: known.select(F.col("h").alias(f"h{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("final", "bare", "stopped", "more")])
    judged = salted_join(salted_join(ends, by(3), ["h3"], F.col("doc_id")), by(2), ["h2"], F.col("doc_id"))

    def is_ending(k: int) -> Column:
        final, bare, stopped, more = (F.col(f"{c}{k}") for c in ("final", "bare", "stopped", "more"))
        heading = F.col("plain") & (bare >= 30) & (final < 0.01 * bare)
        lists = (bare >= 2) & (bare >= ENDS_SHARE * (bare + stopped + more))
        signs = (final >= 3) & (final >= 0.5 * (final + stopped + more))
        return (lists | signs) & ~heading

    unseen = F.col("bare3") + F.col("stopped3") + F.col("more3") == 0
    complete = ~F.col("prose") & (is_ending(3) | (unseen & (F.col("final3") < 3) & is_ending(2)))
    limits = hidden_limits(every.where("status <> 'none'").withColumn("ends", F.col("status") == "complete"))
    at = ends.select("doc_id", "source", F.posexplode("sizes").alias("encoding", "length"))
    limited = at.join(limits.withColumnRenamed("source", "s"), F.expr("source <=> s") & (at.encoding == limits.encoding) & (at.length == limits.length), "left_semi").select("doc_id").distinct().withColumn("limited", F.lit(True))
    judged = judged.join(limited, "doc_id", "left")
    reason = F.when(F.col("limited"), "limit").when(F.col("status") == "cut", "mark").when((F.col("status") == "open") & ~complete, "ending")
    return judged.select("doc_id", "source", reason.alias("reason")).where("reason IS NOT NULL")


def truncation_by_source(texts: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """source, texts, cut_texts, by_limit, by_mark, by_ending, share: how often each source truncates."""
    totals = texts.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("texts"))
    kinds = [F.count_if(F.col("reason") == k).alias(f"by_{k}") for k in ("limit", "mark", "ending")]
    cuts = found.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("cut_texts"), *kinds)
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("cut_texts", "by_limit", "by_mark", "by_ending")]
    return totals.join(cuts, F.expr("source <=> s"), "left").select("source", "texts", *none).withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 6))
