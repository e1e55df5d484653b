import random

from pyspark.sql import functions as F

from tidemark.llm.leakage import LeakFinder, cleaned, facts_of, leaks, test_items, without_leaks

test_items.__test__ = False
SHARED = "Answer using only the information given."


def passage(r, who):
    return f"{SHARED} An applicant tells {who}zed that the ballast form was signed on {r.randint(1, 28)} April, though the {who}fot clerk recorded day {r.randint(30, 99)}. The {who}dab office of {who}gof lists a braille editor position whose contract runs for {r.randint(30, 99)} weeks with a review in week 4. Who bears the cost?"


R = random.Random(1)
ITEMS = [(k, passage(R, w)) for k, w in enumerate(["ka", "le", "mi", "no", "pu", "ra"], 1)]
FILL = "Our pricing engine handles about nineteen thousand pallets a day and the night desk keeps records. " * 4


def found(text):
    return LeakFinder(ITEMS).find(text)


def test_whole_part_and_reworked():
    words = ITEMS[2][1].split()
    assert found(FILL + ITEMS[2][1] + FILL) == [3]
    assert found(FILL + " ".join(words[8:34]).upper() + FILL) == [3]
    assert found(FILL + ITEMS[0][1].replace("applicant", "aplicant").replace("was", "had been").replace("lists", "shows") + FILL + ITEMS[4][1]) == [1, 5]
    assert found(ITEMS[1][1].replace(" ", "\n ").replace(".", " . ")) == [2]


def test_shared_wording_and_other_facts_are_none():
    assert found(SHARED + FILL) == []
    assert found(passage(random.Random(9), "zo")) == []
    assert found(FILL + " ".join(ITEMS[2][1].split()[8:16]) + FILL) == []
    assert found("") == [] and found(None) == []


def test_same_items_short_items_and_long_texts():
    finder = LeakFinder([(1, "quick brown fox jumps"), (2, "Quick brown, fox jumps!"), (3, "ok"), (4, ""), (5, None), (None, "x")])
    assert finder.find("see the quick brown fox jumps") == [1, 2]
    assert finder.find("that is ok") == [3]
    assert LeakFinder(ITEMS).find("word " * 200_000 + ITEMS[5][1]) == [6]
    assert LeakFinder([]).find("a b c d") == []


def test_tables(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1], 9, "x"), (1, ITEMS[0][1], 9, "x"), (2, FILL, 9, "x"), (3, None, 9, "x"), (4, "", 9, "x")], "id bigint, text string, item_id int, doc_id string")
    items = test_items(spark.createDataFrame([*ITEMS, (None, "x"), (9, None)], "i bigint, t string"), "i", "t")
    out = leaks(docs, "id", "text", items)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 1)]
    # beyond the broadcast the same by a join
    assert sorted(map(tuple, leaks(docs, "id", "text", items, most=0).collect())) == [(1, 1), (1, 1)]
    left = {r.doc_id: r.text for r in cleaned(docs.withColumn("text", F.concat(F.lit("Before it. "), "text", F.lit(" And after."))), "id", "text", items).collect()}
    assert left[1].startswith("Before it. ") and left[1].endswith(" And after.") and "braille" not in left[1] and left[2] == f"Before it. {FILL} And after." and left[3] is None
    assert sorted(r.id for r in without_leaks(docs, "id", out).collect()) == [2, 3, 4]
    assert leaks(docs.limit(0), "id", "text", items).count() == 0
    assert leaks(docs, "id", "text", items.limit(0)).count() == 0


def test_items_that_share_passages():
    a, b = ITEMS[0][1].removeprefix(SHARED), ITEMS[3][1].removeprefix(SHARED)
    # an item within another one, and one whose halves stand in two others
    inner = " ".join(ITEMS[2][1].split()[7:40])
    assert LeakFinder([*ITEMS, (50, inner)]).find(FILL + inner + FILL) == [3, 50]
    halves = " ".join(a.split()[:24] + b.split()[24:])
    assert 60 in LeakFinder([*ITEMS, (60, halves)]).find(FILL + halves + FILL)
    # thousands of items of one pattern lose nothing
    many = [(k, passage(random.Random(k), f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}")) for k in range(1000, 2000)]
    finder = LeakFinder(many)
    for k, text in many[::300]:
        assert k in finder.find(FILL + text + FILL)


def test_figures_and_names_are_facts():
    text = "Ask Rudo on 5 May. Then he left, “Olga” said: Go to 2b!"
    assert [w for w, f in zip(text.replace(".", "").replace(",", "").replace("“", "").replace("”", "").replace(":", "").replace("!", "").split(), facts_of(text)) if f] == ["Rudo", "5", "May", "Olga", "2b"]
    assert facts_of("") == []


def test_a_misspelt_name_is_still_the_name():
    words = ITEMS[3][1].split()
    part = " ".join(words[6:32]).replace("nozed", "nozzed")
    assert found(FILL + part + FILL) == [4]


def test_many_hits_take_linear_time():
    assert found(" ".join(ITEMS[1][1].split()[18:30]) * 1) == []
    assert found((" ".join(ITEMS[1][1].split()[18:26]) + " and so on, ") * 20_000) == []


def test_against_every_window():
    """The tiles find what an alignment with the whole text finds."""
    finder = LeakFinder(ITEMS)
    r = random.Random(5)
    for _ in range(60):
        k, start, size = r.randrange(len(ITEMS)), r.randrange(30), r.randrange(10, 50)
        text = " ".join((FILL * 2).split()[: r.randrange(1, 130)] + ITEMS[k][1].split()[start : start + size] + FILL.split()[: r.randrange(60)])
        words = text.lower().replace(".", "").replace("?", "").split()
        want = sorted(i for item, (i,) in zip(finder.items, finder.ids) if item.stretch(words))
        assert finder.find(text) == want
