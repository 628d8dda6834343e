import itertools

import pytest
from pyspark.sql import functions as F

from harvestry.functions.matching import Matcher, PageType, resolve_page_type

BOOK = "https://library.kelp.example/shelves/north/7f3?view=full"
ONE_URL = Matcher("ExactUrl", BOOK)
SHELF = Matcher("ExactHostPathTemplate", "/shelves/{wing}/{book}", "library.kelp.example", (("view", "full"),))
UNDER, ANY = Matcher("PathPrefix", "/shelves/north"), Matcher("PathGlob", "/shelves/*/*")


def resolve(spark, url, types):
    return spark.range(1).select(resolve_page_type(F.lit(url), types).alias("r")).first()["r"]


def matches(spark, matcher, url):
    return spark.range(1).select(matcher.matches(F.lit(url)).alias("m")).first()["m"]


def test_kinds_of_rules_are_ordered():
    ranks = [m.specificity for m in (ONE_URL, SHELF, UNDER, ANY)]
    assert ranks[0] > ranks[1] > max(ranks[2:]) and [r[0] for r in ranks] == [4, 3, 2, 2]
    # among equals, more text that is not a placeholder is more specific
    assert Matcher("PathPrefix", "/shelves/north/rare").specificity > UNDER.specificity > Matcher("PathPrefix", "/s").specificity
    assert Matcher("ExactHostPathTemplate", "/m/{catalogue}", "k").specificity > Matcher("ExactHostPathTemplate", "/m/{c}", "k").specificity


def test_the_narrowest_rule_decides_however_types_are_listed(spark):
    types = [PageType(f"t{i}", name, 0, (rule,)) for i, (name, rule) in enumerate([("one page", ONE_URL), ("a shelf", SHELF), ("a wing", UNDER), ("anything", Matcher("PathGlob", "/*"))])]
    for left in range(4):
        for order in itertools.islice(itertools.permutations(types[left:]), 0, None, 5):
            assert resolve(spark, BOOK, list(order))["name"] == types[left].name


def test_a_higher_priority_beats_a_narrower_rule(spark):
    wide = PageType("w", "wide", 3, (Matcher("Regex", "^https://library"),))
    assert resolve(spark, BOOK, [PageType("n", "narrow", 2, (ONE_URL, SHELF)), wide])["name"] == "wide"
    assert resolve(spark, BOOK, [PageType("n", "narrow", 3, (ONE_URL,)), wide])["name"] == "narrow"


def test_equal_claims_are_ambiguous_and_listed_by_name(spark):
    r = resolve(spark, BOOK, [PageType("z", "maps", 4, (UNDER,)), PageType("q", "atlases", 4, (UNDER,)), PageType("a", "low", 3, (ONE_URL,))])
    assert r["decision"] == "Ambiguous" and r["name"] is None
    assert {c["name"] for c in r["candidates"]} >= {"maps", "atlases"} and [c["name"] for c in r["candidates"]][:2] == ["atlases", "maps"]


def test_two_spellings_of_a_template_are_one_claim(spark):
    r = resolve(spark, BOOK, [PageType("s", "shelf", 0, tuple(Matcher("ExactHostPathTemplate", f"/shelves/{{w}}/{{{x}}}", "library.kelp.example") for x in ("bb", "aa")))])
    assert r["decision"] == "Matched" and [p.rsplit("/", 1)[1] for p in r["candidates"][0]["patterns"]] == ["{aa}", "{bb}"]


@pytest.mark.parametrize("types", [[], [PageType("e", "empty")], [PageType("u", "wing", 9, (UNDER,))]])
def test_a_page_without_a_rule_is_unmatched(spark, types):
    for url in ("https://library.kelp.example/opening-hours", "https://library.kelp.example/", None):
        assert resolve(spark, url, types)["decision"] == "Unmatched"


@pytest.mark.parametrize(
    ("matcher", "url", "expected"),
    [
        (UNDER, "http://any.example/shelves/northern", True), (UNDER, "http://any.example/Shelves/north", False), (UNDER, "http://any.example/a/shelves/north", False),
        (ANY, "http://k.example/shelves/a/b/c", True), (ANY, "http://k.example/shelves/a", False), (Matcher("PathGlob", "/who?"), "http://k.example/whom", False), (Matcher("PathGlob", "/*.txt"), "http://k.example/x/y.txt", True),
        (Matcher("ExactHostPathTemplate", "/r//{n}/", "K.example"), "http://k.EXAMPLE/r/12", True), (Matcher("ExactHostPathTemplate", "/r/{n}", "k.example"), "http://k.example/r/1/2", False),
        (Matcher("ExactHostPathTemplate", "/r", "k.example", (("tone", "low"),)), "http://k.example/r?tone=high&tone=low&x=1", True), (Matcher("ExactHostPathTemplate", "/r", "k.example", (("tone", "low"),)), "http://k.example/r?tone=high", False),
        (Matcher("ExactUrl", "HTTP://K.example:80"), "http://k.example/", True), (ONE_URL, BOOK + "#page-2", False), (ONE_URL, BOOK.replace("full", "brief"), False),
        (Matcher("Regex", r"[0-9a-f]{3}\?view"), BOOK, True), (Matcher("Regex", r"^/shelves"), BOOK, False),
    ],
)
def test_rules(spark, matcher, url, expected):
    assert matches(spark, matcher, url) is expected


@pytest.mark.parametrize("args", [("Regex", "(unclosed"), ("Regex", "(?<=x)y"), ("PathGlob", ""), ("Wildcard", "/x"), ("ExactUrl", "/only/a/path"), ("ExactHostPathTemplate", "/no-host")])
def test_rules_that_cannot_be_are_refused(args):
    with pytest.raises(ValueError):
        Matcher(*args)


def test_rules_are_stored_as_rows():
    for rule in (ONE_URL, SHELF, UNDER, ANY, Matcher("Regex", "x")):
        assert Matcher.from_row(rule.to_row()) == rule
    with pytest.raises(ValueError):
        Matcher.from_row({"kind": "Regex", "pattern": "(unclosed"})
