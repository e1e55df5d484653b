import random

import pytest

from tidemark.llm.truncation import common_words, cut_texts, ending, hidden_limits, lengths, truncation_by_source

WHO, DO, WHAT = ["The night desk", "A calm hire", "Each shift lead", "The field crew", "Our trio"], ["keeps", "checks", "turns", "moves", "counts", "sorts"], ["old records", "new ledgers", "spare lenses", "heavy pallets", "small meters", "wet samples"]


def sentence(r):
    return f"{r.choice(WHO)} {r.choice(DO)} {r.choice(WHAT)} with {r.choice(WHAT)} near the {r.choice(['river', 'harbour', 'depot', 'museum'])}."


def body(r):
    text = " ".join(sentence(r) for _ in range(r.randint(2, 12)))
    if r.random() < 0.4:
        text += "\nRequirements\n" + "\n".join(f"- {r.choice(DO)} {r.choice(WHAT)}" for _ in range(3))
    return text + r.choice(["", "", "\nStart date: flexible", f"\nReq {r.randint(10000, 99999)}"])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    rows, cut = [], set()
    for k in range(1500):
        text, source = body(r), r.choice(["a", "b"])
        if k % 3 == 0:
            source, text = "limited", text[:200]
            if len(text) == 200 and not text.endswith("."):
                cut.add(k)
        elif k % 25 == 1:
            at = r.randint(20, len(text) - 30)
            while text[at - 1] in ". \n" or text[at] in ".\n" or "\n" in text[at - 25 : at]:
                at -= 1
            text = text[:at] + r.choice(["", "", "…", " [truncated]", "�"])
            cut.add(k)
        rows.append((k, text, source, "token", 1))
    return rows, cut


def test_planted_cuts(spark, corpus):
    rows, cut = corpus
    docs = spark.createDataFrame([*rows, (9001, None, "a", None, 1), (9002, "", "a", None, 1), (9003, " \n", None, None, 1), (None, "x", "a", None, 1), (9004, "Done.", None, None, 1)], "doc_id bigint, text string, source string, reason string, h3 int")
    found = cut_texts(docs, "doc_id", "text", "source", "reason")
    got = {r.doc_id: r.reason for r in found.collect()}
    assert len(got) == found.count()
    assert len(cut - got.keys()) <= 0.06 * len(cut)
    assert len(got.keys() - cut) <= 0.06 * len(cut)
    assert {9001, 9002, 9003, 9004, None}.isdisjoint(got)
    assert "limit" in got.values()
    shares = {r.source: r.share for r in truncation_by_source(docs, found, "source").collect()}
    assert shares["limited"] > 0.5 > shares["a"] and shares[None] == 0


def test_limits(spark):
    rows = [("s", lengths("x" * n)) for n in range(1, 400)] + [("s", lengths("é" * 100 + "x" * (55 - k % 3) + "\n" * (k % 3))) for k in range(40)]
    found = {(r.encoding, r.length) for r in hidden_limits(spark.createDataFrame(rows, "source string, sizes array<int>").selectExpr("source", "sizes")).collect()}
    assert (1, 255) in found


def test_small_sources_show_limits_and_copies_do_not(spark):
    sized = lambda rows: spark.createDataFrame([(source, copy, ends, lengths("x" * n)) for source, copy, ends, n in rows], "source string, copy string, ends boolean, sizes array<int>")
    limits = lambda rows: {(r.source, r.length) for r in hidden_limits(sized(rows)).collect() if r.encoding == 0}
    others = [("s", f"o{n}", True, n) for n in range(10, 400, 7)]
    assert limits([*others, *[("s", f"c{k}", False, 255) for k in range(4)]]) == {("s", 255)}
    # one text four times, four complete texts of one length, and the same number over any size of source
    assert limits([*others, *[("s", "c", False, 255) for _ in range(4)]]) == set()
    assert limits([*others, *[("s", f"c{k}", True, 255) for k in range(4)]]) == set()
    assert limits([(None, f"c{k}", False, 80) for k in range(3)]) == {(None, 80)}
    assert limits([]) == set()


def test_lengths():
    assert lengths('a<b>&"\n') == [7, 7, 7, 8, 8, 7 + 4 + 6, 7 + 4 + 6, 7 + 4 + 6 + 5, 7 + 4 + 6 + 1, 9, 9, 9]
    assert lengths("é😀") == [2, 6, 3, 2, 6, 2, 6, 2, 2, 2, 6, 18]
    assert lengths("") == [0] * 12


@pytest.mark.parametrize(("text", "status"), [("Done.", "complete"), ("Is it?", "complete"), ("Thanks :)", "complete"), ("He said “no.”", "complete"), ("a…", "cut"), ("a [...]", "cut"), ("a ...read more", "cut"), ("go to the sto�", "cut"), ("candid-", "cut"), ("Tom &am", "cut"), ("x <a href=", "cut"), ("one, two,", "cut"), ("the end", "open"), ("R&D", "open"), ("", "none"), (None, "none"), ("\n ", "none")])
def test_endings(text, status):
    assert ending(text, frozenset(["the", "end"]))[0] == status


def test_signatures():
    common = frozenset(["engineering", "ref", "the", "hires"])
    assert ending("Text.\nRef. Kitrenepa Engineering", common)[0] == "complete"
    assert ending("Text.\nKitrenepa Engin", common)[0] == "open"
    assert ending("Text.\nUniversity of Ludribefo", common, "ludribefo-university")[0] == "complete"
    assert ending("Kitrenepa hires Engineering", common)[0] == "open"


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert cut_texts(docs, "doc_id", "text", "source").count() == 0
    long = spark.createDataFrame([(1, "A word and more. " * 20_000 + "cut in the mid", "s"), (1, "A word and more. " * 20_000 + "cut in the mid", "s"), (2, "A word and more.", "s")], docs.schema)
    assert {r.doc_id for r in cut_texts(long, "doc_id", "text", "source").collect()} == {1}


def test_every_common_word_counts(spark):
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(5))
    texts = [(" ".join(word(k) for k in range(at, at + 1000)),) for at in range(0, 101_000, 1000)]
    assert len(common_words(spark.createDataFrame(texts * 3, "text string"), "text")) == 101_000
