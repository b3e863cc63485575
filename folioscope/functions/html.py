"""HTML pages to markdown text with native expressions.

A page is cut into tags and texts once; one pass over them with a stack of the open elements makes
the markdown. Both are linear in the length of the page.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import MARKDOWN_LINK, matches, strip

# Parts of page paths that mark generated pages, element classes to drop,
# language names accepted as a class of a code block, schemes of links that leave the corpus.
SKIPPED_PAGES = ["genindex.html", "search.html", "modindex.html", "_sources", "_static", ".doctree"]
DROPPED_ELEMENTS = ["nav", "header", "footer"]
DROPPED_CLASSES = [
    "headerlink",
    "viewcode-link",
    "reference external",
    "sphinxsidebar",
    "relations",
    "download",
    "modindex-jumpbox",
    "genindex-jumpbox",
    "search",
]
CODE_LANGUAGES = ["python", "py", "javascript", "js", "bash", "shell"]
EXTERNAL_SCHEMES = ["http://", "https://", "mailto:", "ftp://"]

# Elements without content, headings, those that stand on a line of their own, and those that the
# stack keeps while they are open.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
LINE_ELEMENTS = ["div", "article", "section", "main", "aside", "form", "dl", "dt", "dd", "figure"]
CONTAINERS = [*LINE_ELEMENTS, "body", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre"]

# Elements below this depth count as beside each other, as in browsers.
DEEPEST = 512
# Tokens of a block, and blocks of a larger one.
BLOCK = 64
# The name of the stack's first element: what part of the page counts.
MAIN_SCOPE, BODY_SCOPE = "#main", "#body"

# Character references by name, as HTML defines them, those that end in a semicolon.
ENTITIES = {f"&{name}": chars for name, chars in html5.items() if name.endswith(";")}
NAME_MAPS = 512

# Private-use stand-ins: line breaks, characters that later steps must not see, and the begin and
# end of what is marked. Pages lose theirs before they are converted.
_BREAK, _LINE, _BLANK, _ITEM, _START, _TRIM, _END, _QUOTE = (chr(0xE000 + i) for i in range(8))
_LINK, _LABEL, _LINK_END, _HEAD_END = (chr(0xE010 + i) for i in range(4))
_LEVELS = "".join(chr(0xE021 + i) for i in range(6))
_INLINE = [
    (["b", "strong"], "\ue030", "\ue031"),
    (["i", "em"], "\ue032", "\ue033"),
    (["code"], "\ue034", "\ue035"),
]
_SIGNS = dict(zip("\ue030\ue031\ue032\ue033\ue034\ue035", ["**", "**", "*", "*", "`", "`"], strict=True))
_STAND_INS = "[\ue000-\ue03f]"

# A tag, whose quoted attributes may hold any character; one whose quotes do not pair; a text.
_TOKEN = (
    r"</?[a-zA-Z][^'\">]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^'\">]*+){0,200}+>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>|[^<]++|<"
)


def is_skipped(path: Column) -> Column:
    hit = F.lit(False)
    for part in SKIPPED_PAGES:
        hit = hit | path.contains(part)
    return hit


def without_raw_text(html: Column) -> Column:
    """Drop comments, scripts and styles, whichever starts first."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", ""
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as that needs.

    A column that an expression inside a lambda refers to may be put in its place by the optimizer,
    and is then computed for each element; a lambda's own variable is not. The result is copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in double quotes, single quotes or none; empty if it is missing."""
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def tokens(html: Column) -> Column:
    """array<struct>: the page's tags and the texts between them, in order.

    ``tag`` is the name in lower case, empty for text. A quoted attribute may hold any character.
    """

    def parsed(token: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, r"\A</?([a-zA-Z!?][a-zA-Z0-9:\-]*)", 1))

        def known(tag: Column) -> Column:
            opens = (tag != "") & ~token.startswith("</")
            classes = F.when(opens, _attribute(token, "class")).otherwise("")
            language = F.coalesce(
                F.nullif(F.regexp_extract(classes, r"(?:\A|\s)language-([\w+#.\-]+)", 1), F.lit("")),
                F.regexp_extract(classes, rf"(?:\A|\s)({'|'.join(CODE_LANGUAGES)})(?:\s|\z)", 1),
            )
            image = F.concat(
                F.lit("!["), _attribute(token, "alt"), F.lit("]("), _attribute(token, "src"), F.lit(")")
            )
            return F.struct(
                tag.alias("tag"),
                ((tag != "") & ~opens).alias("closing"),
                F.when(tag == "", token).otherwise("").alias("text"),
                F.coalesce(
                    opens & (tag.isin(DROPPED_ELEMENTS) | classes.rlike("|".join(DROPPED_CLASSES))), F.lit(False)
                ).alias("drop"),
                (opens & (tag == "div") & F.lower(_attribute(token, "role")).startswith("main")).alias("main"),
                F.when(opens & (tag == "a"), _attribute(token, "href"))
                .when(opens & (tag == "img") & (_attribute(token, "src") != ""), image)
                .when(opens & (tag == "ol"), _attribute(token, "start"))
                .when(opens & tag.isin("code", "pre"), language)
                .otherwise("")
                .alias("value"),
            )

        return let(tag, known)

    return F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), parsed)


def _element(name, drop, live, pre, flat, pad, count, first, close) -> Column:
    """What the stack knows of an open element.

    Whether it is dropped, in the main content, preformatted, or a cell that takes no line breaks;
    the blanks that its lines begin with; its items, rows or cells so far; whether it is a table's
    first row; and the text that ends it.
    """
    fields = {"name": name, "drop": drop, "live": live, "pre": pre, "flat": flat, "pad": pad, "count": count, "first": first, "close": close}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _changed(element: Column, **new: Column) -> Column:
    return _element(*(new.get(f, element[f]) for f in ("name", "drop", "live", "pre", "flat", "pad", "count", "first", "close")))


def _kept(stack: Column, t: Column) -> Column:
    """How many elements stay open: a closing tag ends its element and those inside it, and some
    opening tags end the element before them."""
    n = F.size(stack)
    top = F.element_at(stack, -1)["name"]
    above = F.coalesce(F.get(stack, n - 2)["name"], F.lit(""))
    from_end = F.array_position(F.reverse(F.transform(stack, lambda e: e["name"])), t["tag"])
    ended = F.when((from_end > 0) & (from_end < n), n - from_end.cast("int")).otherwise(n)
    tag, cell = t["tag"], top.isin("td", "th")
    implied = (
        F.when((tag == "tr") & cell & (above == "tr"), n - 2)
        .when((tag == "tr") & (cell | (top == "tr")), n - 1)
        .when(tag.isin("td", "th") & cell, n - 1)
        .when(tag.isin("dt", "dd") & top.isin("dt", "dd"), n - 1)
        .when(tag.isin("li", "p") & (top == tag), n - 1)
        .otherwise(n)
    )
    return F.when(t["closing"], ended).otherwise(implied)


def _marker(parent: Column) -> Column:
    number = F.concat((parent["count"] + 1).cast("string"), F.lit(". "))
    return F.when(parent["name"] == "ol", number).otherwise("- ")


def _blanks(n: Column) -> Column:
    return F.repeat(F.lit(_BLANK), n)


def _opened(parent: Column, t: Column, live: Column) -> Column:
    """The element that an opening tag puts on the stack."""
    tag, pad = t["tag"], parent["pad"]
    breaks = F.when(parent["flat"], " ").otherwise(F.concat(F.lit("\n\n"), pad))
    line = F.when(parent["flat"], " ").otherwise(F.concat(F.lit("\n"), pad))
    first = (tag == "tr") & (parent["name"] == "table") & (parent["count"] == 0)
    start = F.when(tag == "ol", F.coalesce(t["value"].try_cast("int"), F.lit(1)) - 1).otherwise(0)
    close = (
        F.when(tag == "pre", F.concat(F.lit(f"{_LINE}```"), breaks))
        .when(parent["pre"], "")
        .when(tag == "li", _END)
        .when(tag.isin("td", "th"), " | ")
        .when(tag == "tr", F.when(first, F.concat(F.lit("\n"), pad, F.lit("|"))).otherwise(""))
        .when(tag.isin("ul", "ol"), F.when(parent["name"] == "li", "").otherwise(breaks))
        .when(tag.isin("table", "blockquote"), breaks)
        .when(tag.isin(LINE_ELEMENTS), line)
        .otherwise("")
    )
    inner = (
        F.when(tag == "li", F.concat(pad, _blanks(F.length(_marker(parent)))))
        .when(tag == "blockquote", F.concat(pad, F.lit(_QUOTE + _BLANK)))
        .otherwise(pad)
    )
    return _element(
        tag,
        parent["drop"] | t["drop"],
        live,
        parent["pre"] | (tag == "pre"),
        (parent["flat"] | tag.isin("td", "th")) & (tag != "pre"),
        inner,
        start.cast("int"),
        first,
        close,
    )


def _said(parent: Column, t: Column) -> Column:
    """The text that an opening tag, or a closing one that is not on the stack, stands for."""
    tag, closing, pad = t["tag"], t["closing"], parent["pad"]
    breaks = F.when(parent["flat"], " ").otherwise(F.concat(F.lit("\n\n"), pad))
    line = F.when(parent["flat"], " ").otherwise(F.concat(F.lit("\n"), pad))
    level = F.translate(F.substring(tag, 2, 1), "123456", _LEVELS)
    heading = tag.isin(HEADINGS)
    opening = (
        F.when(tag == "p", breaks)
        .when(tag == "br", F.when(parent["flat"], " ").otherwise(F.concat(F.lit(_BREAK), pad)))
        .when(heading, F.concat(breaks, level))
        .when(tag == "li", F.concat(F.lit(_ITEM), pad, _marker(parent), F.lit(_TRIM)))
        .when(tag == "a", F.when(t["value"] != "", F.concat(F.lit(_LINK), t["value"], F.lit(_LABEL))).otherwise(""))
        .when(tag == "img", t["value"])
        .when(tag == "hr", F.concat(breaks, F.lit("---"), breaks))
        .when(tag == "tr", F.concat(line, F.lit("| "), F.lit(_TRIM)))
        .when(tag == "pre", F.concat(breaks, F.lit("```"), t["value"], F.lit(_LINE)))
        .when(tag == "blockquote", F.concat(F.lit(_END), breaks, F.lit(_QUOTE + _BLANK + _TRIM)))
        .when(tag.isin("ul", "ol"), F.when(parent["name"] == "li", "").otherwise(F.concat(breaks, F.lit(_START))))
        .when(tag == "table", breaks)
        .when(tag.isin(LINE_ELEMENTS), line)
    )
    ending = F.when(tag == "p", breaks).when(heading, F.concat(F.lit(_HEAD_END), breaks)).when(tag == "a", _LINK_END)
    for names, begin, end in _INLINE:
        opening = opening.when(tag.isin(names), begin)
        ending = ending.when(tag.isin(names), end)
    marked = F.when(closing, ending.otherwise("")).otherwise(opening.otherwise(""))
    return F.when(parent["pre"], F.when((tag == "br") & ~closing, _LINE).otherwise("")).otherwise(marked)


def _moved(stack: Column, entered: Column, piece: Column) -> Column:
    """The stack after some tokens, whether the main content has begun, and their text."""
    return F.struct(stack.alias("stack"), entered.alias("entered"), piece.alias("piece"))


def _step(s: Column, t: Column) -> Column:
    """What a token does to the stack, and its text."""
    scope = F.get(s["stack"], F.lit(0))["name"]

    def seen(element: Column) -> Column:
        return element["live"] & ~element["drop"]

    def text(top: Column) -> Column:
        plain = F.regexp_replace(t["text"], r"[ \t\r\n]+", " ")
        shown = F.when(top["pre"], F.translate(t["text"], "\n \r", _LINE + _BLANK)).otherwise(plain)
        return F.when(seen(top), shown).otherwise("")

    def tagged(k: Column) -> Column:
        gone = F.slice(s["stack"], k + 1, F.size(s["stack"]) - k)
        ends = F.array_join(F.reverse(F.transform(gone, lambda e: F.when(seen(e), e["close"]).otherwise(""))), "")
        return let(F.element_at(s["stack"], k), lambda parent: within(k, parent, ends))

    def within(k: Column, parent: Column, ends: Column) -> Column:
        tag, base = t["tag"], F.slice(s["stack"], 1, k)
        pushed = (
            ~t["closing"] & ~tag.isin(VOID_ELEMENTS) & ~tag.rlike("^[!?]") & (k < DEEPEST)
            & (tag.isin(CONTAINERS) | t["drop"] | parent["drop"])
        )
        counts = tag.isin("li", "td", "th") | ((tag == "tr") & (parent["name"] == "table"))
        close = F.when(tag.isin("td", "th") & parent["first"], F.concat(parent["close"], F.lit(" --- |"))).otherwise(parent["close"])
        counted = F.concat(F.slice(s["stack"], 1, k - 1), F.array(_changed(parent, count=parent["count"] + 1, close=close)))
        enters = t["main"] & (scope == MAIN_SCOPE) & ~s["entered"]
        live = parent["live"] | enters | ((scope == BODY_SCOPE) & (tag == "body"))
        stack = F.when(
            pushed, F.concat(F.when(counts, counted).otherwise(base), F.array(_opened(parent, t, live)))
        ).otherwise(base)
        # An element that was on the stack has its own text to end it.
        ended = t["closing"] & (k < F.size(s["stack"]))
        said = F.when(seen(parent) & ~t["drop"] & ~ended, _said(parent, t)).otherwise("")
        return _moved(stack, s["entered"] | enters, F.concat(ends, said))

    return F.when(t["tag"] == "", _moved(s["stack"], s["entered"], let(F.element_at(s["stack"], -1), text))).otherwise(
        let(_kept(s["stack"], t), tagged)
    )


def _folded(items: Column, s: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` over all items from the state ``s``, their texts joined."""
    start = F.struct(s["stack"].alias("stack"), s["entered"].alias("entered"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, moved: Column) -> Column:
        return F.struct(
            moved["stack"].alias("stack"), moved["entered"].alias("entered"),
            F.concat(state["out"], F.array(moved["piece"])).alias("out"),
        )

    return F.aggregate(
        items,
        start,
        lambda state, item: F.aggregate(F.array(step(state, item)), state, add),
        lambda state: _moved(state["stack"], state["entered"], F.array_join(state["out"], "")),
    )


def _blocks(items: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.size(items) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, size))


def _converted(page: Column) -> Column:
    """Markdown, with stand-ins, of a page's tokens.

    One pass with a stack. Only the first ``div`` with ``role="main"`` counts, else the body, else
    the whole page. A fold copies its state at every step, so the text goes on in blocks of blocks:
    each fold holds the texts of its own block only.
    """

    def whole(found: Column) -> Column:
        scope = F.when(F.exists(found, lambda t: t["main"]), MAIN_SCOPE).when(
            F.exists(found, lambda t: (t["tag"] == "body") & ~t["closing"]), BODY_SCOPE
        ).otherwise("")
        no, none, nothing = F.lit(False), F.lit(0), F.lit("")
        root = _element(scope, no, scope == "", no, no, nothing, none, no, nothing)

        def block(s: Column, b: Column) -> Column:
            return _folded(b, s, _step)

        def blocks(s: Column, b: Column) -> Column:
            return _folded(_blocks(b, BLOCK), s, block)

        def rest(s: Column) -> Column:
            ends = F.transform(s["stack"], lambda e: F.when(e["live"] & ~e["drop"], e["close"]).otherwise(""))
            return F.concat(s["piece"], F.array_join(F.reverse(ends), ""))

        return let(_folded(_blocks(found, BLOCK * BLOCK), _moved(F.array(root), no, nothing), blocks), rest)

    return let(tokens(_with_languages(page)), whole)


def _with_languages(page: Column) -> Column:
    """Give a preformatted element the class of the code element that it begins with."""
    return F.regexp_replace(page, r"(?i)<pre\b[^>]*>\s*<code\b([^>]*)>", "<pre$1>")


_REFERENCE = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"


def _numbered(reference: Column) -> Column:
    """The character of a decimal or hexadecimal reference.

    What is no character (0, surrogates, beyond the last code point) is the replacement
    character, so that no page can fail a job.
    """
    hexadecimal = reference.rlike("^&#[xX]")
    digits = F.regexp_extract(reference, r"^&#[xX]?0*([0-9a-fA-F]*);", 1)
    short = F.length(digits).between(1, F.when(hexadecimal, 6).otherwise(7))
    point = F.when(short, F.conv(digits, 16, 10).cast("bigint")).otherwise(0)
    point = F.when(hexadecimal, point).when(short, F.try_to_number(digits, F.lit("9999999")).cast("bigint")).otherwise(0)
    real = (point > 0) & (point < 0xD800) | (point > 0xDFFF) & (point <= 0x10FFFF)
    safe = F.when(real, point).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def unescaped(df: DataFrame, column: str) -> DataFrame:
    """Character references to characters, each once; names that HTML does not know stay."""
    text = F.col(column)
    # A literal map is searched from its start, so the names are dealt to many small ones.
    dealt: list[dict[str, str]] = [{} for _ in range(NAME_MAPS)]
    for name, chars in ENTITIES.items():
        dealt[zlib.crc32(name.encode()) % NAME_MAPS][name] = chars
    names = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,string>>")

    def char(reference: Column) -> Column:
        own = F.get(names, (F.crc32(reference.cast("binary")) % NAME_MAPS).cast("int"))
        return F.when(reference.startswith("&#"), _numbered(reference)).otherwise(
            F.coalesce(F.try_element_at(own, reference), reference)
        )

    found = F.transform(matches(text, _REFERENCE), char)
    return df.withColumn(column, F.when(text.contains("&"), _woven(F.split(text, _REFERENCE, -1), found)).otherwise(text))


def _woven(between: Column, found: Column) -> Column:
    """The parts of a text between matches with what takes their places."""
    return F.array_join(F.zip_with(between, found, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")


def to_markdown(df: DataFrame, column: str) -> DataFrame:
    """Convert pages to markdown. Unpaired inline marks are dropped.

    Navigation, link marks, side bars and search boxes go, whatever element carries their class;
    so do comments, scripts and styles.
    """
    page = F.regexp_replace(without_raw_text(F.col(column)), _STAND_INS, "")
    df = df.withColumn(column, _converted(page))
    gap, ends = f"[ \\t\n{_BLANK}]*", rf"[^{_LINK}{_LABEL}{_LINK_END}]"
    steps = [
        *((f"{a}{gap}([^{a}{z}]+?){gap}{z}", f"{_SIGNS[a]}$1{_SIGNS[z]}") for _, a, z in _INLINE),
        ("[\ue030-\ue035]", ""),
        (f"{_LINK}({ends}*+){_LABEL}{gap}\\1{gap}{_LINK_END}", "<$1>"),
        (f"{_LINK}({ends}*+){_LABEL}{gap}({ends}+?){gap}{_LINK_END}", "[$2]($1)"),
        (f"{_LINK}{ends}*+{_LABEL}|{_LINK_END}", ""),
        (f"([{_LEVELS}]){gap}([^{_LEVELS}{_HEAD_END}]+?){gap}{_HEAD_END}", f"{_START}$1$2"),
        (f"(?<!{_START})[{_LEVELS}]|{_HEAD_END}", ""),
        (f"{_TRIM}[ \\t\n{_BLANK}{_QUOTE}]*", ""),
        (f"[ \\t\n{_BLANK}{_END}]*{_ITEM}", "\n"),
        (f"[{_START}{_END}]", ""),
        (f"[ \\t{_BLANK}{_QUOTE}]*\n[ \\t]*", "\n"),
        (f"((?:\n|{_BREAK})[{_BLANK}{_QUOTE}]*)[ \\t]+", "$1"),
    ]
    out = F.col(column)
    for pattern, into in steps:
        out = F.regexp_replace(out, pattern, into)
    for level, sign in enumerate(_LEVELS, 1):
        out = F.replace(out, F.lit(sign), F.lit("#" * level + " "))
    out = F.replace(out, F.lit(_BREAK), F.lit("  \n"))
    df = unescaped(df.withColumn(column, out), column)
    return df.withColumn(column, F.translate(F.col(column), _LINE + _BLANK + _QUOTE, "\n >"))


def prettified_anchor(anchor: Column) -> Column:
    """Last dotted part with dashes as blanks."""
    return F.replace(F.element_at(F.split(anchor, r"\."), -1), F.lit("-"), F.lit(" "))


def clean_url(url: Column) -> Column:
    """Link target without anchor and ``.html``."""
    return F.regexp_replace(F.substring_index(url, "#", 1), r"\.html\z", "")


def is_external(url: Column) -> Column:
    hit = F.lit(False)
    for scheme in EXTERNAL_SCHEMES:
        hit = hit | url.startswith(scheme)
    return hit


def wikilink_for(link: Column) -> Column:
    """One markdown link to a wikilink; external links stay as they are.

    Page keys and note keys differ only in their suffix, so the cleaned target is the note key
    whether or not the page is part of the corpus.
    """
    label = F.regexp_extract(link, MARKDOWN_LINK, 1)
    url = F.regexp_extract(link, MARKDOWN_LINK, 2)
    target = clean_url(url)
    anchor = prettified_anchor(F.regexp_extract(url, r"(?s)\A[^#]*#(.*)\z", 1))
    goal = F.when(anchor != "", F.concat(target, F.lit("#"), anchor)).otherwise(target)
    plain = (F.lower(label) == F.lower(F.replace(target, F.lit("/"), F.lit(" ")))) | (label == url)
    wiki = F.concat(
        F.lit("[["), goal, F.when(plain, F.lit("")).otherwise(F.concat(F.lit("|"), label)), F.lit("]]")
    )
    return F.when(is_external(url), link).otherwise(wiki)


def wikilinked(markdown: Column) -> Column:
    """Rewrite every markdown link of a text."""
    return _woven(F.split(markdown, MARKDOWN_LINK, -1), F.transform(matches(markdown, MARKDOWN_LINK), wikilink_for))


def tidied(markdown: Column) -> Column:
    """Blank-line, fence and list spacing; superfluous escapes; outer whitespace."""
    text = F.regexp_replace(markdown, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?U)```(\w+)?\n\n+", "```$1\n")
    text = F.regexp_replace(text, r"(?U)\n+(\s*[-*+])", "\n$1")
    text = F.replace(text, F.lit("\\_"), F.lit("_"))
    text = F.replace(text, F.lit("\\*"), F.lit("*"))
    return strip(text)
