"""Literal cases of the text, path and page functions."""

import time

import pytest
from pyspark.sql import functions as F

from folioscope.functions import html, paths, rules, text
from folioscope.operators import pages as P


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


C = F.col("v")


def test_wikilinks_take_alias_or_target(spark):
    got = one(spark, text.wikilinks(C), v="a [[x]] [[y|why]] [[z")
    assert [(r.target, r.display) for r in got] == [("x", "x"), ("y", "why")]


def test_headings_use_line_feeds_only(spark):
    got = one(spark, text.headings(C), v="# One Two\n\r## not\n### Ünï (x)-y_z ")
    assert [(r.level, r.text, r.anchor) for r in got] == [
        (1, "One Two", "one-two"),
        (3, "Ünï (x)-y_z", "ünï-x-y_z"),
    ]


@pytest.mark.parametrize(
    ("value", "words"), [("", 0), ("  a  b\tc\n", 3), ("a b", 2), ("a\x1cb　c", 3)]
)
def test_words_split_like_unicode_whitespace(spark, value, words):
    assert one(spark, text.word_count(C), v=value) == words


@pytest.mark.parametrize(("value", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, value, lines):
    assert one(spark, text.line_count(C), v=value) == lines


def test_titles(spark):
    assert one(spark, text.first_title(C), v="x\n# Main Title \n# Other") == "Main Title"
    assert one(spark, text.first_title(C), v="## Only second") is None


def test_snippet(spark):
    assert one(spark, text.snippet(C), v="x" * 201) == "x" * 200 + "..."
    assert one(spark, text.snippet(F.lit(None).cast("string")), v="") == ""


@pytest.mark.parametrize(("value", "name"), [("user_guide", "User Guide"), ("api2b_x", "Api2B X"), ("ABC", "Abc")])
def test_display_name(spark, value, name):
    assert one(spark, text.display_name(C), v=value) == name


def test_frontmatter_and_heading_rules_disagree(spark):
    note = "---\ntitle: x\n---\n\n# Head\n"
    assert not one(spark, text.opens_with_heading(C), v=note)
    assert one(spark, text.opens_with_heading(text.without_frontmatter(C)), v=note)


@pytest.mark.parametrize(
    ("path", "suffix", "stem", "parent"),
    [
        ("a/b.md", ".md", "b", "a"),
        ("b", "", "b", ""),
        ("x/.hidden", "", ".hidden", "x"),
        ("a.tar.gz", ".gz", "a.tar", ""),
        ("d/doc_5.md#top", ".md#top", "doc_5", "d"),
    ],
)
def test_path_parts(spark, path, suffix, stem, parent):
    assert one(spark, F.struct(paths.suffix(C), paths.stem(C), paths.parent(C)), v=path) == (suffix, stem, parent)


@pytest.mark.parametrize(
    ("path", "clean"),
    [("a/b", "a/b"), ("./a//b/", "a/b"), ("a/../b.md", "b.md"), ("../x", None), ("/abs", None), ("a/b/../../c", "c"), ("..a/b", "..a/b")],
)
def test_normalise(spark, path, clean):
    assert one(spark, paths.normalise(C), v=path) == clean


@pytest.mark.parametrize(
    ("path", "module", "package"),
    [("a/b/c.py", "a.b.c", "a.b"), ("a/b/__init__.py", "a.b", "a.b"), ("__init__.py", "proj", ""), ("m.py", "m", "")],
)
def test_module_names(spark, path, module, package):
    got = one(spark, F.struct(paths.module_name(C, "proj"), paths.package_path(C)), v=path)
    assert got == (module, package)


@pytest.mark.parametrize(
    ("path", "patterns", "dialect", "hit"),
    [
        ("src/a/b.py", ["*.py"], "glob", True),
        ("tests/unit/t.py", ["tests/"], "glob", True),
        ("mytests/t.py", ["tests/"], "glob", False),
        ("a/__pycache__/x.py", ["*__pycache__"], "glob", True),
        ("a/b.py", ["b.py"], "glob", True),
        ("a/x1.py", ["a/x[!2].py"], "glob", True),
        ("a/b/c.py", ["b/*.py"], "path", True),
        ("a/b/c.py", ["a/*.py"], "path", False),
        ("a/b/c.py", ["/b/"], "substring", True),
    ],
)
def test_exclusion_dialects(spark, path, patterns, dialect, hit):
    assert one(spark, paths.excluded(C, patterns, dialect), v=path) is hit


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ('a<b>:"c"/d\\e|f?g*.txt', "a_b___c__d_e_f_g_.txt"),
        (" .name. ", "name"),
        ("...", "unnamed_file"),
        ("x" * 300 + ".md", "x" * 247 + ".md"),
        ("y" * 300, "y" * 250),
    ],
)
def test_sanitised_names(spark, raw, clean):
    assert one(spark, paths.sanitise_filename(C), v=raw) == clean


@pytest.mark.parametrize(("name", "constant"), [("MAX_SIZE", True), ("Max", False), ("__", False), ("A1", True)])
def test_constants(spark, name, constant):
    assert one(spark, paths.is_constant(C), v=name) is constant


@pytest.mark.parametrize(
    ("link", "rewritten"),
    [
        ("[text](module.html)", "[[module|text]]"),
        ("[api module](api/module.html)", "[[api/module]]"),
        ("[x](https://e.org/a.html)", "[x](https://e.org/a.html)"),
        ("[m](mod.html#pkg.Class.some-thing)", "[[mod#some thing|m]]"),
        ("[module.html](module.html)", "[[module]]"),
        ("[s](#my-sec)", "[[#my sec|s]]"),
        ("a [b](c.html) d [e](http://f) [g](h)!", "a [[c|b]] d [e](http://f) [[h|g]]!"),
        ("no link", "no link"),
    ],
)
def test_link_rewriting(spark, link, rewritten):
    assert one(spark, html.wikilinked(C), v=link) == rewritten


@pytest.mark.parametrize(("path", "tags"), [("a.html", ["code"]), ("api/_x/core/a.html", ["code", "code/api", "code/core"])])
def test_tags(spark, path, tags):
    assert one(spark, P.tags(C), v=path) == tags


@pytest.mark.parametrize(
    ("path", "skipped"), [("genindex.html", True), ("a/_static/x.html", True), ("research.html", True), ("api/mod.html", False)]
)
def test_skipped_pages(spark, path, skipped):
    assert one(spark, html.is_skipped(C), v=path) is skipped


def test_unescape(spark):
    df = spark.createDataFrame([("a &amp;lt; &lt;b&gt; &#233; &#x1F600; &copy;",)], "v string")
    assert html.unescaped(df, "v").first().v == "a &lt; <b> é 😀 ©"


PAGE = """<html><head><title>t</title></head><body><header>top</header>
<div class="wrap"><div role="main" class="body"><h1>Title<a class="headerlink" href="#t">¶</a></h1>
<p>Some <b>bold</b> and <em>soft</em>
text, <a href="other.html#pkg.Cls">see</a>.</p>
<div class="search box"><div>inner</div> gone</div>
<div class="highlight-python"><pre><code class="language-python">def f(x):
    return x &lt; 1
</code></pre></div>
<ul><li>one</li><li>two</li></ul></div><div class="sphinxsidebar">side</div></div><!-- <p>no</p> -->
<script>var a = "</p>";</script></body></html>"""


def test_page_conversion(spark):
    pages = spark.createDataFrame([("d/a.html", PAGE)], "rel_path string, html string").withColumn(
        "mtime", F.timestamp_millis(F.lit(1_700_000_000_500))
    )
    note = P.convert(pages).first()
    assert note.path == "d/a.md" and note.title == "Title" and note.tags == ["code", "code/d"]
    assert note.body == (
        "# Title\n\nSome **bold** and *soft* text, [[other#Cls|see]].\n\n"
        "```python\ndef f(x):\n    return x < 1\n\n```\n- one\n- two"
    )
    assert note.content.startswith(
        "---\ntitle: Title\ntags: [code, code/d]\nsource: a.html\ncreated: 1700000000.5\ntype: documentation\n---\n\n# Title"
    )


@pytest.mark.parametrize(("value", "shown"), [(12.25, "12.2"), (66.666, "66.7"), (1234.5, "1234.5"), (0.0, "0.0")])
def test_fixed_rounds_ties_to_even(spark, value, shown):
    assert one(spark, rules.fixed(C), v=value) == shown


def test_note_header_and_backup_name(spark):
    head = P.note_header(C, F.array(F.lit("a"), F.lit("b")), F.lit("2024-01-01T00:00:00"), F.lit("m.py"))
    assert one(spark, head, v="My Note") == (
        "---\ncreated: '2024-01-01T00:00:00'\nsource: m.py\ntags:\n- a\n- b\ntitle: My Note\n---\n"
    )
    at = F.lit("2024-03-05 06:07:08").cast("timestamp")
    assert one(spark, paths.backup_name(C, at), v="n.md") == "n.md.backup.20240305_060708"


@pytest.mark.parametrize(
    ("written", "read"),
    [
        ("a &amp;lt; b", "a &lt; b"),
        ("&eacute;&euro;&rarr;&nbsp;|", "é€→\u00a0|"),
        ("&#65;&#x41;&#00000065;&#X000041;", "AAAA"),
        ("&#9999999;&#xFFFFFF;&#xD800;&#0;&#99999999999999;&#xfffffffffff;", "\ufffd" * 6),
        ("&#x1F642;&#128578;", "\U0001f642" * 2),
        ("&nosuch; & &; &#; &#x;", "&nosuch; & &; &#; &#x;"),
    ],
)
def test_character_references(spark, written, read):
    df = spark.createDataFrame([(written,)], "v string")
    assert html.unescaped(df, "v").first()[0] == read


@pytest.mark.parametrize(
    ("value", "written"),
    [
        ("My Note", "My Note"), ("it's: here", "'it''s: here'"), ("a # b", "'a # b'"), ("a#b", "a#b"), ("- x", "'- x'"),
        ("-x", "-x"), ("true", "'true'"), ("12", "'12'"), ("1.5e3", "'1.5e3'"), ("2024-01-02", "'2024-01-02'"), ("", "''"),
        ("[x]", "'[x]'"), ("tail:", "'tail:'"), ("a:b", "a:b"), (" pad", "' pad'"), ('two\nlines "q" \\', '"two\\nlines \\"q\\" \\\\"'),
        (None, "null"), ("@x", "'@x'"), ("No", "'No'"), ("Note 12", "Note 12"),
    ],
)
def test_yaml_scalars(spark, value, written):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(P.yaml_scalar(C)).first()[0] == written


# Pages and the markdown they stand for, both written by hand.
PAGES_BY_HAND = {
    "nested and numbered lists": (
        "<p>Intro</p><ol><li>one<li>two<ul><li>deep<ul><li>deeper</li></ul></li><li>deep 2</li></ul></li></ol>"
        "<p>After</p><ol start=9><li>nine</li><li>ten<ol><li>x</li></ol></li></ol>",
        "Intro\n\n1. one\n2. two\n   - deep\n     - deeper\n   - deep 2\n\nAfter\n\n9. nine\n10. ten\n    1. x",
    ),
    "paragraphs in a list": (
        "<ul><li><p>a</p><p>b</p></li><li></li><li>c</ul>d",
        "- a\n\n  b\n-\n- c\n\nd",
    ),
    "table with open cells": (
        "t<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1<td><p>x</p><p>y</p><tr><td>2<td>3</table>end",
        "t\n\n| A | B |\n| --- | --- |\n| 1 |  x  y  |\n| 2 | 3 |\n\nend",
    ),
    "images": (
        "<img src=a.png> <img src='b.png' alt='B b'/> <img alt=c src=\"c.png\"><img alt=none>",
        "![](a.png) ![B b](b.png) ![c](c.png)",
    ),
    "links": (
        "<a href=x.html>X</a> <a href='y.html'>Y</a> <a title=\"a>b\" href=\"z.html\"> <b>Z</b> </a> "
        "<a href=http://q>http://q</a> <a>no</a> <a href=e.html></a>.<a href=open.html>open",
        "[X](x.html) [Y](y.html) [**Z**](z.html) <http://q> no .open",
    ),
    "classes on any element": (
        "<main class=search>gone</main><dl><dt>k<dd class='headerlink'>gone</dd><dd>v</dd></dl><code class=headerlink>gone</code>"
        "<span class='x sphinxsidebar y'>a<span>b</span>c</span><p class=\"reference external\">gone<p>kept</p>"
        "<img class=download src=a.png><pre class=search>gone</pre>",
        "k\n\nv\n\nkept",
    ),
    "dropped elements end with what holds them": ("<div><nav><ul><li>gone</div>kept<footer>gone", "kept"),
    "code": (
        "<pre class=z><code class=\"language-python\">def f():\n    <b>return</b> 1 &lt; 2\n</code></pre>"
        "<pre>raw  text\n  x</pre>say <code>x_y</code>",
        # The rules that tidy a note take blank lines after a fence and before a dash.
        "```python\ndef f():\n    return 1 < 2\n\n```\n```\nraw  text\n  x\n```\nsay `x_y`",
    ),
    "quotes": (
        "<blockquote><p>a</p><p>b</p><blockquote>c</blockquote></blockquote><p>d</p>",
        "> a\n\n> b\n\n> > c\n\nd",
    ),
    "marks": (
        "<b> bold </b> <i>it<b>bi</b></i> <b>open <em>e</em></i> </b></b><b>never<h2> Head <a class=headerlink href=#h>¶</a></h2>"
        "x<br>y<hr>z<h3>open",
        "**bold** *it**bi*** **open *e***never\n\n## Head\n\nx  \ny\n---\n\nz\n\nopen",
    ),
    "no tags": ("1 < 2 <3 <!-- c --><script>x</script>&lt;p&gt; \ue003", "1 < 2 <3 <p>"),
}


def markdown_of(spark, pages):
    df = html.to_markdown(spark.createDataFrame(list(enumerate(pages)), "k int, v string"), "v")
    return [r.v for r in df.withColumn("v", html.tidied(C)).orderBy("k").collect()]


def test_pages_by_hand(spark):
    bodies = [f"<html><head><title>t</title></head><body>{page}</body></html>" for page, _ in PAGES_BY_HAND.values()]
    got = dict(zip(PAGES_BY_HAND, markdown_of(spark, bodies), strict=True))
    assert got == {name: want for name, (_, want) in PAGES_BY_HAND.items()}


def test_what_part_of_a_page_counts(spark):
    main = "<body>a<div role='main'><h1>M</h1><div>in</div></div><div role=main>second</div>b</body>"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert markdown_of(spark, [main, "<title>t</title>text", "", "<body>body<div>x</div></body>after", deep]) == ["# M\n\nin", "ttext", "", "body\nx", "x"]


def seconds_for(spark, page, steps):
    df = steps(spark.createDataFrame([(page,)], "v string"))
    start = time.perf_counter()
    df.selectExpr("length(v)").collect()
    return time.perf_counter() - start


@pytest.mark.parametrize(
    ("unit", "steps"),
    [
        ("<p>text <b>x</b> &amp; <a href=a.html>l</a></p><ul><li>a<li>b</ul>", lambda df: html.to_markdown(df, "v")),
        ("&eacute; &#65; &amp; ", lambda df: html.unescaped(df, "v")),
        ("text [label](page.html#a.b) ", lambda df: df.withColumn("v", html.wikilinked(C))),
    ],
)
def test_time_doubles_with_the_page(spark, unit, steps):
    page = unit * 10_000
    seconds_for(spark, page, steps)
    once = min(seconds_for(spark, page, steps) for _ in range(2))
    assert min(seconds_for(spark, page * 2, steps) for _ in range(2)) < 2.5 * once + 0.3
    assert once < 10


def test_filename_of_long_runs_takes_linear_time(spark):
    started = time.monotonic()
    assert one(spark, paths.sanitise_filename(C), v=" a" + " ." * 200_000 + "b.x ") == "a" + (" ." * 124)[:-1] + ".x"
    assert time.monotonic() - started < 10
