import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harvestry.functions import checks, html, ids, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://Ex.com:443/a/../b/./c/?b=2&utm_x=1&a=1#top", "https://ex.com/b/c?a=1&b=2"), ("http://x.org", "http://x.org/"), ("http://x.org:8080/?q", "http://x.org:8080/?q"), ("http://x/?a=2&a=1", "http://x/?a=1&a=2"),
        ("http://x/p/?ref=1&fbclid=2&GCLID=3", "http://x/p?ref=1"), ("bad", None), ("ftp://x/", None), (None, None), ("http://u:p@x/a", "http://x/a"),
    ],
)
def test_canonical(spark, url, canonical):
    got = one(spark, urls.canonical(F.lit(url)))
    assert got == canonical
    if got:
        assert one(spark, urls.canonical(F.lit(got))) == got


@pytest.mark.parametrize(
    ("href", "resolved"),
    [("/x", "https://h.test/x"), ("y", "https://h.test/a/y"), ("../y", "https://h.test/y"), ("?q=1", "https://h.test/a/b?q=1"), ("#f", "https://h.test/a/b?z=1#f"), ("//o.test/p", "https://o.test/p"), ("http://o/p", "http://o/p"), ("", "https://h.test/a/b?z=1")],
)
def test_resolve(spark, href, resolved):
    assert one(spark, urls.resolve(F.lit(href), F.lit("https://h.test/a/b?z=1"))) == resolved


def test_names(spark):
    name = lambda t, o, u: one(spark, urls.source_name(F.lit(t), F.lit(o), F.lit(u)))
    assert [name(" T ", "o", "http://h/"), name(" ", " O", "http://h/"), name(None, None, "http://h/a/b/"), name(None, "", "http://h"), name(None, None, None)] == ["T", "O", "h/a/b", "h", "Untitled Source"]
    assert one(spark, urls.dataset_name(F.lit(" a "), F.lit(" "))) == "a"


def test_scope(spark):
    inside = lambda h, *a: one(spark, urls.in_scope(F.lit(h), *a))
    assert inside("a.test", "seed_domains", ("a.test",)) and not inside("x.a.test", "seed_domains", ("a.test",)) and inside("x.a.test", "registrable", ("a.test",)) and not inside("ba.test", "registrable", ("a.test",))
    assert not inside("x.a.test", "allow_block", (), ("a.test",)) and inside("b.test", "allow_block", (), ("a.test",))


@pytest.mark.parametrize(("name", "safe"), [("a b.html", "a_b.html"), ("", None), (".", None), ("..", None), ("a/b", None), ("con.txt", None), ("COM7", None), ("comx", "comx"), ("é", "_")])
def test_file_names(spark, name, safe):
    assert one(spark, checks.file_name(F.lit(name))) == safe


@pytest.mark.parametrize(("path", "safe"), [("a/./b", "a/b"), ("../a", None), ("/a", None), ("a/..", None), ("a", "a")])
def test_paths(spark, path, safe):
    assert one(spark, checks.relative_path(F.lit(path))) == safe


def test_predicates(spark):
    assert [one(spark, checks.is_blank(F.lit(x))) for x in (None, "", "  \n", "x")] == [True, True, True, False]
    assert [one(spark, checks.is_env_name(F.lit(x))) for x in ("A_1", "_X", "1A", "a", "A\n", "")] == [True, True, False, False, False, False]
    assert [one(spark, checks.is_sha256(F.lit(x))) for x in ("a" * 64, "A" * 64, "a" * 63, "g" * 64, "a" * 64 + "\n")] == [True, True, False, False, False]
    assert [one(spark, checks.setting_is_consistent(F.lit(s), F.lit(v))) for s, v in (("CUSTOM", "1"), ("CUSTOM", None), ("INHERIT", None), ("INHERIT", "1"), (None, None))] == [True, False, True, False, False]


def test_typed_values(spark):
    assert [str(one(spark, checks.number(F.lit(x)))) for x in ("1,234.5", " 7 ", "$5", "x", None)] == ["1234.500000000", "7.000000000", "None", "None", "None"]
    assert str(one(spark, checks.number(F.lit("1.234,5"), ",", "."))) == "1234.500000000"
    assert [one(spark, checks.boolean(F.lit(x))) for x in ("Yes", "0", "maybe", None)] == [True, False, None, None]
    assert one(spark, checks.key((F.lit(" A "), ("trim", "lower")), (F.lit("x"), ()))) == "a\x1fx" and one(spark, checks.key((F.lit(" "), ("trim",)))) is None


def test_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": 0, "y": "é"}], "c": null}}', "no", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(checks.canonical_json("t").alias("c"), checks.json_holds_secret("t").alias("s")).collect()
    assert [r["c"] for r in rows] == ['{"a":{"c":null,"d":[1,{"y":"é","z":0}]},"b":1}', None, None] and [r["s"] for r in rows] == [False, None, None]


def test_selectors():
    page = html.parse("<div id=a class='x y'><p>one<p>two <b>bold</b><ul><li>1<li>2</ul></div><a href='/z' data-k>z</a>")
    texts = lambda s: [n.text() for n in html.select(page, s)]
    assert texts("#a > p") == ["one", "two bold"] and texts("div.y li") == ["1", "2"] and texts("li:nth-child(2)") == ["2"] and texts("a[data-k]") == ["z"] and texts("[href=/z], b") == ["bold", "z"] and texts("p > li") == []
    assert html.value(html.select(page, "a")[0], "url:href", "http://h/q/") == "http://h/z" and html.value(None, "presence") == "false"


def test_sanitized():
    safe = html.sanitized("<p onclick=x>a<script>b</script><a href='JavaScript:1'>c</a><form>d</form><meta http-equiv=refresh>")
    assert safe == "<p>a<a>c</a></p>"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp=\"' \n&;#x!-", max_size=80))
def test_any_text_is_a_page(text):
    root = html.parse(text)
    assert isinstance(root.text(), str) and html.fingerprint(text) == html.fingerprint(text) and isinstance(html.sanitized(text), str)


def test_selector_ranks():
    assert [html.selector_rank(s) for s in ("#a", ".b", "[data-x]", "div > p", "li:nth-child(2)")] == [1, 2, 3, 4, 5]


def test_deep_and_wide_pages_are_read():
    import time

    from harvestry.functions import html

    deep = "<div>" * 6000 + "x" + "</div>" * 6000
    assert html.sanitized(deep) == deep and len(list(html.parse(deep).elements())) == 6000
    assert len(html.fingerprint("<div>" * 2000)) == 2000 and html.repeated(deep) == 1
    before = time.time()
    wide = html.parse("<ul>" + "<li>a" * 40_000 + "</ul>")
    assert [n.place for n in html.select(wide, "li:nth-child(40000)")] == [40_000] and time.time() - before < 10


def test_no_url_that_runs_is_kept():
    from harvestry.functions import html

    for bad in ("java&#9;script:x()", " JavaScript:x()", "java\nscript:x()", "&#1;javascript:x()", "vbscript:x", "data:text/html,x", "blob:x", "java​script:x"):
        assert "href" not in html.sanitized(f'<a href="{bad}">t</a>'), bad
    for good in ("https://a.example/b:c", "/a?b=c:d", "mailto:x@a.example", "#f", "tel:1", "a/b"):
        assert f'href="{good}"' in html.sanitized(f'<a href="{good}">t</a>'), good
    assert html.sanitized('<p onclick="x()" title="a: b" style="x">t</p>') == '<p title="a: b">t</p>'


def test_ids_have_the_nearest_millisecond(spark):
    times = {0: 0, 499: 0, 500: 1, 1499: 1, 1705740730367920: 1705740730368, 1705740730367499: 1705740730367}
    d = spark.createDataFrame([(us,) for us in times], "us long").select("us", ids.uuid7(F.timestamp_micros("us"), F.col("us")).alias("id"))
    got = {r["us"]: r["id"] for r in d.collect()}
    assert {us: int(i[:8] + i[9:13], 16) for us, i in got.items()} == times
    assert all(r["ok"] for r in d.select(ids.is_uuid7(F.col("id")).alias("ok")).collect())
    old = spark.sql("select timestamp_micros(-500) as a, timestamp_micros(-1499) as b, timestamp_micros(-499) as c").select(*[ids.uuid7(F.col(c), F.lit(1)) for c in "abc"]).first()
    assert [i[:13] for i in old] == ["ffffffff-ffff", "ffffffff-ffff", "00000000-0000"]


@pytest.mark.parametrize("text", ["<h1>a&amp;&amp;&</h1>", "<h1>a&am</h1>", "<p>&quot;x&quot; &eacute; &#233; &#xe9 &nosuch; & &copy</p>", "<p>a &lt;b&gt; c</p>", "a&amp", "<title>&quot;t&</title>", "<p>1\n&amp;\r\n2</p>"])
def test_previews_keep_text_as_it_is_written(text):
    assert html.sanitized(text) == text


@pytest.mark.parametrize(
    ("text", "safe"),
    [
        ("a < b > c <3 &lt;i&gt;<", "a &lt; b &gt; c &lt;3 &lt;i&gt;&lt;"), ("<p>x<a href", "<p>x&lt;a href</p>"),
        ("&l<script>1</script>t;b", "&amp;lt;b"), ("&#6<!-- -->0;script", "0;script"), ("&lt<!--", "&lt;&lt;!--"), ("a &amp;<style>p</style>lt;", "a &amp;lt;"), ("&<embed>&<embed>amp;", "&amp;&amp;amp;"),
        ('<a title="&quot;&lt;" href="java&#115;cript:1">&quot;</a>', '<a title="&quot;&lt;">&quot;</a>'),
    ],
)
def test_texts_of_previews_begin_no_tag_and_become_no_reference(text, safe):
    assert html.sanitized(text) == safe


@given(st.lists(st.sampled_from(["<p>", "</p>", "<script>", "</script>", "<!--", "-->", "&", "&amp;", "&#60;", "&lt", ";", "<", ">", "a", "<i>", "<input>", " x="]), max_size=14).map("".join))
def test_previews_show_the_same_text_and_no_script(text):
    got = html.sanitized(text)
    assert not any(x.tag in html.UNSAFE for x in html.parse(got).elements()) and html.sanitized(got) == got
    root = html.parse(text)
    for node in [root, *root.elements()]:
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in html.UNSAFE]
    assert html.parse(got).text() == root.text()
