import pytest

from tidemark.llm.components import connected_components
from tidemark.llm.entity_names import entity_pairs, link_names, read_name
from tidemark.llm.strings import edits, jaro_winkler


def reading(name):
    return read_name(name)[:2]


@pytest.mark.parametrize("name", ["Todadra & Rasepelo Health", "RASEPELO AND TODADRA HEALTH", "Rasepelo.and.Todadra.Health", "RasepeloandTodadraHealth", "Health: Rasepelo + Todadra", "The Rasepelo & Todadra Hlth &amp; Co.", "Rasepelo & Todadra Health, Inc. [HQ]", "Team Rasépelo & Todadra Health (hiring)"])
def test_one_reading_of_a_pair(name):
    assert reading(name) == ("health", "rasepelo todadra")


@pytest.mark.parametrize(("name", "want"), [
    ("University of Ludribefo", ("university", "ludribefo")), ("Ludribefo Univ", ("university", "ludribefo")), ("U. of Ludribefo", ("university", "ludribefo")), ("The Tidekuzi Bank", ("bank", "tidekuzi")), ("Bk of Tidekuzi", ("bank", "tidekuzi")),
    ("Nobopade FS", ("financial services", "nobopade")), ("Analytics - Paruchesa", ("analytics", "paruchesa")), ("Paruchesa Anlytcs", ("analytics", "paruchesa")), ("Chodrotripa Constuction", ("construction", "chodrotripa")), ("Godupecha", ("", "godupecha")),
    ("Confidential", (None, None)), ("N/A", (None, None)), ("stealth", (None, None)), ("", (None, None)), ("  ", (None, None)), (None, (None, None)),
])
def test_readings(name, want):
    assert reading(name) == want


def test_distances():
    assert [edits("abc", "acb", 2), edits("abc", "abc", 2), edits("abc", "xyz", 2), edits("", "ab", 2)] == [1, 0, 3, 2]
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("", "a") == 0


def names(spark, rows):
    return spark.createDataFrame([(n, "x", 1) for n in rows], "name string, entity string, key int")


ACME = ["Vemabiro Robotics", "VEMABIRO ROBOTICS", "Vemabiro Robotics GmbH", "Robotics, Vemabiro", "Vemabiro Robotics [Group]", "Vemabrio Robotics", "Vemab. Robotics", "Vemabiro"]


def test_variants_link_and_trades_stay_apart(spark):
    others = ["Vusulafa Manufacturing", "Vusulafa Construction", "Vusulafa Construction Ltd.", "Vusulafa", "Confidential", "", None, " "]
    linked = {r.name: r.entity for r in link_names(names(spark, [*ACME, *ACME, *others]), "name").collect()}
    assert {linked[n] for n in ACME} == {linked[ACME[0]]}
    assert len({linked[n] for n in others[:2]} | {linked["Vusulafa"], linked[ACME[0]]}) == 4
    assert linked["Vusulafa Construction"] == linked["Vusulafa Construction Ltd."]
    assert not {"Confidential", "", None, " "} & linked.keys()


def test_pairs_are_in_byte_order_and_once(spark):
    pairs = [tuple(r) for r in entity_pairs(link_names(names(spark, ["Ábo Health", "Abo Health", "Abo Health ", "abo health"]), "name")).collect()]
    assert len(pairs) == len(set(pairs)) == 6
    assert all(a.encode() < b.encode() for a, b in pairs)


def clusters(spark, rows):
    by = {}
    for r in link_names(names(spark, rows), "name").collect():
        by.setdefault(r.entity, set()).add(r.name)
    return sorted(by.values(), key=min)


def dressed(name, n=3):
    return [name, f"{name} Ltd.", f"{name} GmbH", f"{name} Inc.", f"{name} LLC", f"{name} Corp"][:n]


def test_two_slips_of_ordinary_letters_link(spark):
    # the common letter pairs of the misspelt name are those of well-attested ones
    plenty = [n for w in ("Dramurado", "Mudraruda", "Raduramudo") for n in dressed(f"{w} Foods", 6)]
    true = dressed("Dradramudra Laboratories")
    got = clusters(spark, [*plenty, *true, "Draramura Laboratories", *dressed("Chekotite Laboratories"), *dressed("Chenorite Laboratories")])
    assert {*true, "Draramura Laboratories"} in got
    # two other letters are no slips
    assert {*dressed("Chekotite Laboratories")} in got and {*dressed("Chenorite Laboratories")} in got


def test_more_forms_of_a_misspelling_remove_no_link(spark):
    true = dressed("Trifuzpo Analytics", 6)
    assert clusters(spark, [*true, *dressed("Trifupzo Analytics", 5)]) == [{*true, *dressed("Trifupzo Analytics", 5)}]
    assert clusters(spark, [*true, *dressed("Trifuz Analytics", 5)]) == [{*true, *dressed("Trifuz Analytics", 5)}]


def test_every_accepted_link_counts(spark):
    # two misspellings one edit from each other, both two edits from the name
    true = dressed("Vemabiro Foods")
    assert clusters(spark, [*true, "Vemabrrio Foods", "Vemabrrrio Foods"]) == [{*true, "Vemabrrio Foods", "Vemabrrrio Foods"}]
    # a chain of spellings seen once each
    assert clusters(spark, ["Kodupevha Foods", "Kodupeha Foods", "Kdupeha Foods", "Kdpeha Foods"]) == [{"Kodupevha Foods", "Kodupeha Foods", "Kdupeha Foods", "Kdpeha Foods"}]
    # between two well-attested names the closest counts, and the two stay apart
    one, two = dressed("Rasupelo Foods"), dressed("Rasutelo Foods")
    ordinary = [*dressed("Rasupelo Health"), *dressed("Rasutelo Health")]
    got = clusters(spark, [*one, *two, *ordinary, "Rasupeloo Foods", "Rasuteloo Foods"])
    assert {*one, "Rasupeloo Foods"} in got and {*two, "Rasuteloo Foods"} in got


def test_the_beginning_of_another_name_keeps_its_misspellings(spark):
    short, long = dressed("Vemabiro Foods", 2), dressed("Vemabirotudo Foods", 2)
    got = clusters(spark, [*short, "Vemabrio Foods", *long])
    assert any({*short, "Vemabrio Foods"} <= c for c in got)


def test_names_without_trade_are_compared(spark):
    got = clusters(spark, ["Godupecha", "Godupecha Ltd.", "Godupehca", "Godupech", "Acme Shipping", "Acme Shiping", *dressed("Vemabiro Foods"), "Vemabrio", "Vemab", *dressed("Tudokeza Foods"), *dressed("Tudokeza Health"), "Tudokzea"])
    assert {"Godupecha", "Godupecha Ltd.", "Godupehca", "Godupech"} in got
    assert {"Acme Shipping", "Acme Shiping"} in got
    assert {*dressed("Vemabiro Foods"), "Vemabrio", "Vemab"} in got
    # as close to two organisations, which stay apart
    assert {"Tudokzea"} in got and {*dressed("Tudokeza Foods")} in got and {*dressed("Tudokeza Health")} in got


def test_empty_and_long(spark):
    assert link_names(names(spark, []), "name").count() == 0
    assert link_names(names(spark, ["x" * 50_000 + " Health", "x" * 50_000 + " Health Inc", "a"]), "name").select("entity").distinct().count() == 2


def test_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "node string")
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("g", "f"), ("g", "g"), (None, "h"), ("a", "b")], "a string, b string")
    assert {r.node: r.component for r in connected_components(nodes, links).collect()} == {**dict.fromkeys("abcde", "a"), **dict.fromkeys("fg", "f"), "h": "h"}
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(200)]
    got = connected_components(spark.createDataFrame([(f"n{i:04d}",) for i in range(201)], "node string"), spark.createDataFrame(chain, "a string, b string"))
    assert {r.component for r in got.collect()} == {"n0000"}
    assert connected_components(nodes.limit(0), links.limit(0)).count() == 0


def test_trades_of_no_list_and_nicknames_of_persons(spark):
    got = clusters(spark, ["Zanzibar Bakery", "Zanzibar Bakry", "Kowalski Plumbing", "Kowalsky Plumbing", "Robert Miller Dental", "Bob Miller Dental", "Miller, Bobby Dental", "Bob Dental", "Rob Foods"])
    assert got == sorted([{"Zanzibar Bakery", "Zanzibar Bakry"}, {"Kowalski Plumbing", "Kowalsky Plumbing"}, {"Robert Miller Dental", "Bob Miller Dental", "Miller, Bobby Dental"}, {"Bob Dental"}, {"Rob Foods"}], key=min)


def test_names_in_other_scripts(spark):
    rows = ["東京電力 Inc", "東京電力", "Газпром Inc", "Газпром", "三菱 Health", "東京 Health", "Сбербанк Health", "Себрбанк Health"]
    got = clusters(spark, rows)
    assert got == sorted([{"東京電力 Inc", "東京電力"}, {"Газпром Inc", "Газпром"}, {"三菱 Health"}, {"東京 Health"}, {"Сбербанк Health", "Себрбанк Health"}], key=min)


def test_long_names_are_blocked_by_pieces(spark):
    long = "Vemabirotudokezagodupechadramurado Rasepelokodupehachekotitechenorite"
    assert len(long) > 60
    for wrong in (long.replace("mura", "mrua"), long.replace("Vem", "Vm").replace("rite", "riite"), long.replace("dokeza", "dkeza").replace("kodu", "koodu")):
        assert clusters(spark, [*dressed(f"{long} Foods"), f"{wrong} Foods"]) == [{*dressed(f"{long} Foods"), f"{wrong} Foods"}]


def test_blocks_miss_no_pair_within_two_edits():
    """Against an exact comparison of all pairs."""
    import random

    from tidemark.llm.entity_names import codes

    r = random.Random(3)
    letters = "aeioubdgkmprtvz"
    cores = []
    for size in [5, 6, 8, 9, 12, 20, 39, 40, 41, 42, 60, 90] * 12:
        core = "".join(r.choice(letters) for _ in range(size))
        cores.append(core)
        for _ in range(2):
            k = r.randrange(len(core) - 1)
            core = r.choice([core[:k] + core[k + 1 :], core[:k] + r.choice(letters) + core[k:], core[:k] + core[k + 1] + core[k] + core[k + 2 :], core[:k] + r.choice(letters) + core[k + 1 :]])
            cores.append(core)
    blocks = [set(codes(c)) for c in cores]
    near = [(a, b) for a in range(len(cores)) for b in range(a) if abs(a - b) < 3 and edits(cores[a], cores[b], 2) <= 2 and min(len(cores[a]), len(cores[b])) >= 5]
    missed = [(cores[a], cores[b]) for a, b in near if not blocks[a] & blocks[b]]
    assert len(near) > 250 and missed == []


def test_banded_distances():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def full(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    @settings(max_examples=300, deadline=None)
    @given(st.text("ab", max_size=8), st.text("ab", max_size=8), st.integers(0, 3))
    def same(a, b, most):
        assert edits(a, b, most) == min(full(a, b), most + 1)

    same()
    assert edits("x" * 50_000 + "ab", "x" * 50_000 + "ba", 2) == 1


def test_large_entities_are_paired_in_parts(spark):
    linked = spark.range(2500).selectExpr("concat('n', lpad(id, 5, '0')) AS name", "'e' AS entity")
    assert entity_pairs(linked).count() == 2500 * 2499 // 2 == entity_pairs(linked).distinct().count()
