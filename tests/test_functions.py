import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, text, urls
from tidemark.functions.html import link_targets, visible_text
from tidemark.operators import evidence, places


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(("value", "want"), [("Sr. Software Engineer (Backend)", "sr software engineer backend"), ("  ÉCOLE—n°5 ", "école n 5"), ("", ""), ("...", ""), (None, None)])
def test_normalize(spark, value, want):
    assert one(spark, text.normalize, value) == want


def test_phrases(spark):
    df = spark.createDataFrame([("full time intern",), ("fulltimer",), (None,)], "v string")
    assert [r.o for r in df.select(text.contains_phrase(F.col("v"), "Full-Time").alias("o")).collect()] == [True, False, None]
    assert [r.o for r in df.select(text.contains_phrase(F.col("v"), " - ").alias("o")).collect()] == [False] * 3
    assert [r.o for r in df.select(text.first_phrase(F.col("v"), ["intern", "full time"]).alias("o")).collect()] == ["intern", None, None]
    assert [r.o for r in df.select(text.job_type(F.col("v")).alias("o")).collect()] == ["full_time", None, None]
    assert [one(spark, text.work_mode, v) for v in ("On-Site", "fully remote", "moon", None)] == ["onsite", "remote", None, None]
    assert one(spark, text.normalize_label, "  Cover  Letter *: ") == "cover letter"


def test_hashes(spark):
    assert one(spark, text.fnv1a64, "") == 0xCBF29CE484222325 - 2**64
    assert one(spark, text.fnv1a64, "a") == 0xAF63DC4C8601EC8C - 2**64
    assert one(spark, text.fnv1a64, "foobar") == 0x85944171F73967E8 - 2**64
    assert one(spark, text.fnv1a64, None) is None

    def slow(data):
        h = 0xCBF29CE484222325
        for b in data.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    samples = ["", "a", "zoë", "x" * 1000, "ab"]
    assert [int(h) for h in text.fnv1a_many([s.encode() for s in samples])] == [slow(s) for s in samples]
    words = ("we build calm tools for night shift nurses and ferry operators near the river " * 4).split()
    near = text.simhash_words(words) ^ text.simhash_words([*words, "req", "77"])
    assert bin(near & (2**64 - 1)).count("1") < 16 and text.simhash_words([]) == 0 and one(spark, text.simhash, None) is None
    many = [words, [], ["a"], words[:7], [*words, "z"]]
    assert text.simhash_many(many) == [text.simhash_words(w) for w in many]
    assert text.simhash_words(["two", "words"]) == int(text.fnv1a_many([b"two words"])[0].astype("int64"))


def test_distance(spark):
    km = spark.range(1).select(text.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.lit(40.7128), F.lit(-74.006)).alias("o")).first().o
    assert km == pytest.approx(4129, abs=10)


@pytest.mark.parametrize(("url", "want"), [
    ("https://Boards.Greenhouse.io/Acme/jobs/123?gh_src=x", ("posting", "greenhouse", "acme", "123", None)), ("https://boards.greenhouse.io/embed/job_app?for=acme&token=5", ("posting", "greenhouse", "acme", "5", None)), ("https://boards.greenhouse.io/embed/job_board?for=acme", ("board", "greenhouse", "acme", None, None)),
    ("https://jobs.lever.co/Acme/1B2C3D4E-0000-1111-2222-333344445555", ("posting", "lever", "Acme", "1b2c3d4e-0000-1111-2222-333344445555", None)), ("https://jobs.eu.lever.co/Acme/", ("board", "lever_eu", "Acme", None, None)), ("https://jobs.ashbyhq.com/Acme%20Inc", ("board", "ashby", "acme inc", None, None)),
    ("https://careers.acme.example/x?gh_jid=77", ("embed", None, None, "77", "careers.acme.example")), ("http://Acme.example?utm_source=a&b=1&ref=x#top", ("external", None, None, None, "http://acme.example/?b=1")), ("https://jobs.lever.co/acme/not-a-uuid", ("external", "lever", None, None, "https://jobs.lever.co/acme/not-a-uuid")),
])
def test_resolve(spark, url, want):
    got = one(spark, urls.resolve, url)
    assert (got.kind, got.board_token, got.job_id, got.url) == (want[0], *want[2:])
    assert want[0] == "external" or got.ats == want[1]


@pytest.mark.parametrize("url", ["ftp://a.example/x", "not a url", "", None, "mailto:a@b.example"])
def test_no_web_address(spark, url):
    assert one(spark, urls.resolve, url) is None and one(spark, urls.clean_url, url) is None


def test_names(spark):
    assert one(spark, names.name_words, "The Pinecrest Robotics, Inc.") == ["pinecrest", "robotics"]
    assert one(spark, names.name_words, "Inc") == ["inc"] and one(spark, names.name_words, None) is None
    assert one(spark, names.slug_variants, "Pinecrest Robotics, Inc.") == ["pinecrestrobotics", "pinecrest-robotics"]
    assert one(spark, names.slug_variants, "Zoë AG") == [] and one(spark, names.slug_variants, "Solo") == ["solo"]
    assert [one(spark, names.host_company, h) for h in ("careers.northwind.example", "jobs.example", "", None)] == ["northwind", None, None, None]


def test_html():
    assert visible_text("<p>One <b>two</b></p><ul><li>a<li>b</ul><script>no</script>&amp; z") == "One two\na\nb\n& z"
    assert visible_text("<table><tr><td>a</td><td>b</td></tr></table><nav>c</nav><hr>d") == "ab\ncd"
    assert visible_text("") == "" and visible_text("<p>" * 20_000 + "x") == "x"
    assert link_targets('<a href="https:&#x2F;&#x2F;a.example">x</a><a>y</a><a href="b">') == ["https://a.example", "b"]


def test_years(spark):
    assert evidence.min_years("We need 5+ years of experience. Ideally 2 years of experience with X.")[:2] == (5, False)
    assert evidence.min_years("At least 18 years of age; our 30 years of experience; 50 years of combined experience") == (None, None, None)
    assert evidence.min_years("3-5 yrs experience\n2 years experience") == (2, False, "2 years experience")
    assert evidence.min_years("") == (None, None, None) and one(spark, evidence.required_years, None).years is None
    assert len(evidence.min_years("x" * 500 + " 4 years of experience")[2]) == 240


@pytest.mark.parametrize(("clause", "want"), [
    ("3 plus years' experience", [3]), ("10 to 12+ years of experience", [10]), ("2–4 yrs experience", [2]), ("With over 20 years of experience", []), ("Candidates with 3+ years of relevant experience", [3]), ("we bring more than 20 years of experience", []),
    ("18 years old with experience", []), ("300 years of experience", []), ("5 years " + "of " + "x" * 59 + " experience", [5]), ("5 years " + "of " + "x" * 70 + " experience", []), ("2 years of Go and 4 years of SQL experience", [2, 4]), ("+ years experience", []), ("years", []),
])
def test_years_of_one_clause(clause, want):
    assert list(evidence.stated_years(clause)) == want


def test_words_around():
    assert evidence.words_around("One. a b c d e f g h $5 - $6 i j k; l", 21, 28) == ("c d e f g h", "i j k")
    assert evidence.words_around("", 0, 0) == ("", "")


@pytest.mark.parametrize(("value", "want"), [
    ("Remote - US", [(["remote"], False, ["US"])]), ("Hybrid - Berlin; London (On-site)", [(["hybrid"], False, ["Berlin"]), (["onsite"], False, ["London"])]), ("Anywhere", [([], True, [])]), ("Remote in USA or based in Paris office", [(["remote"], False, ["USA"]), ([], False, ["Paris"])]),
    ("Seattle, WA / TBD", [([], False, ["Seattle", "WA"]), ([], False, [])]), ("Remoteville", [([], False, ["Remoteville"])]), ("", []), (None, None),
])
def test_locations(value, want):
    got = places.parse_locations(value)
    assert (None if got is None else [tuple(e[1:]) for e in got]) == want
