"""Structure of single documents."""

import itertools
import random
import re
import xml.etree.ElementTree as ET

import pytest

from quire.operators import links, machine, notes, records, scripts, sections, tables
from quire.options import ConvertOptions, OptionError, check, encoding, find_name, from_arguments, last_preset, layered, option_file, presets, toml_value

PLAIN = ConvertOptions(extract=True, make_links=False)


def body(text, **options):
    return machine.to_html(text, ConvertOptions(**{"extract": True, "make_links": False} | options))["body"].strip("\n")


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("One line.\n", "<p>One line.</p>"),
        ("a & b < c > d\n", "<p>a &amp; b &lt; c &gt; d</p>"),
        ("Title\n=====\n\nText of it.\n", '<h1><a name="section_1">Title</a></h1>\n\n<p>Text of it.</p>'),
        ("- one\n- two\n\nafter\n", "<ul>\n  <li>one\n  </li><li>two\n</li></ul>\n<p>after</p>"),
        ("1. one\n2. two\n", "<ol>\n  <li>one\n  </li><li>two\n</li></ol>"),
        ("3. three\n4. four\n", '<ol start="3">\n  <li>three\n  </li><li>four\n</li></ol>'),
        ("Short line\nthen one more that is quite a bit longer than the first.\n", "<p>Short line<br>\nthen one more that is quite a bit longer than the first.</p>"),
        ("A WHOLE LINE OF CAPITALS\n", "<p><strong>A WHOLE LINE OF CAPITALS</strong>\n</p>"),
        ("----------\n", "<hr>"),
        ("a #bold# and *italic* and _under_ word\n", "<p>a <strong>bold</strong> and <em>italic</em> and <u>under</u> word</p>"),
        ("café “quoted” …\n", '<p>caf&eacute; "quoted" ...</p>'),
        ("A line that is long enough and has a word that is hyphen-\nated at the end of a line that is long.\n", "<p>A line that is long enough and has a word that is hyphenated \nat the end of a line that is long.</p>"),
    ],
)
def test_blocks(text, html):
    got = body(text)
    squeezed = lambda s: re.sub(r"\s+", " ", s)
    assert squeezed(got) == squeezed(html)


def test_preformatted_and_quotes():
    assert body("     a   column     here\n     b   column     there\n\nprose\n").startswith("<pre>")
    mail = body("From: me\nTo: you\n\n> quoted line\n> more\nanswer\n", mailmode=True)
    assert "class='mail_header'" in mail and "class='quote_mail'" in mail
    marked = body("<PRE>\nkept   as it is\n</PRE>\n", use_preformat_marker=True)
    assert marked.startswith("<pre class='quote_explicit'>")


def test_tables():
    framed = "+----+------+\n| id | name |\n+----+------+\n| 1  | one  |\n| 0  |      |\n+----+------+\n"
    assert tables.is_border(framed.splitlines(keepends=True))
    assert "<th>id</th><th>name</th>" in body(framed, make_tables=True) and "<td>&nbsp;</td><td>&nbsp;</td>" in body(framed, make_tables=True)
    result = " id | name \n----+------\n 1  | one\n(1 rows)\n"
    assert tables.is_pgsql(result.splitlines(keepends=True)) and "<tbody>" in body(result, make_tables=True)
    assert tables.is_delim(["|a|b|\n", "|c|d|\n"]) and not tables.is_delim(["|a|b|\n", "|c|d|e|\n"])
    aligned = ["name     12\n", "longer    3\n", "x       123\n"]
    assert tables.columns(aligned) == [(0, 6), (8, 12)] or len(tables.columns(aligned)) == 2
    assert 'class="align-right"' in body("".join(aligned), make_tables=True)


def test_headings_levels_and_anchors():
    text = "A\n=\n\nB\n-\n\nC\n=\n\nD\n-\n"
    names = re.findall('name="([^"]*)"', body(text))
    assert names == ["section_1", "section_1_1", "section_2", "section_2_1"]
    custom = body("1. Intro\n\ntext\n", custom_heading_regexp=(r"^\d+\. \w+",), explicit_headings=True)
    assert custom.startswith("<h1>")
    assert body("Low\n-\n", use_mosaic_header=True).startswith("<h4>")


PROSE = ["", "\n\n\n", "one", "CAPS LINE\ntext\n", "- a\n  - b\n- c\n", "x\n=\n", "\x00 odd\rbytes\n", "\ttab\ttab\n", "#" * 50, "* " * 40, "a" * 5000, "漢字とかな\n\n한글 text\n", "1) a\n2) b\n   continued\n\nterm:\n  meaning\n"]


@pytest.mark.parametrize("text", PROSE)
def test_words_stay_and_runs_agree(text):
    one, two = machine.to_html(text, PLAIN), machine.to_html(text, PLAIN)
    assert one == two
    shown = re.sub("<[^>]*>", " ", one["body"])
    for word in re.findall(r"[A-Za-z]{3,}", text):
        assert word[:200] in shown


@pytest.mark.parametrize("text", [t for t in PROSE if "\x00" not in t])
def test_xhtml_is_xml(text):
    got = machine.to_html(text, ConvertOptions(xhtml=True, html5=False, make_links=False))
    html = got["start"] + got["body"] + got["tail"]
    if html:
        ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", re.sub(r"&(?!amp;|lt;|gt;|#)\w+;", "x", html)))


def test_split_agrees_with_its_definition():
    for n in range(1, 6):
        for chars in itertools.product("a \n", repeat=n):
            text = "".join(chars)
            want, now = [], ""
            for line in re.findall(r"[^\n]*\n|[^\n]+", text):
                if line == "\n":
                    if now:
                        want.append(now + line)
                    now = ""
                else:
                    now += line
            assert machine.records(text) == want + ([now] if now else []), repr(text)


def test_links():
    rules, wrong = links.load_rules(['"my site" -> http://example.org/\n/foo(\\d+)/ -h-> <B>$1</B>\n"once" -o-> http://o/\n/(/ -> http://x/\n"js" -> javascript:x\n'])
    assert len(wrong) == 2 and len(rules) > 40
    done = lambda t: links.apply_rules(t, rules, set(), set())
    assert done("see my site now") == 'see <a href="http://example.org/">my site</a> now'
    assert done(" foo12 ") == " <b>12</b> "
    assert done("once once").count("<a") == 1
    assert done("write to a.b@example.org now") == 'write to <a href="mailto:a.b@example.org">a.b@example.org</a> now'
    assert done("go http://x.org/y?z=1 on").count("<a ") == 1
    assert links.scrub('x <a href=" java\tscript:y">word</a> <a href="/ok">k</a>') == ('x word <a href="/ok">k</a>', ["javascript"])
    assert links.with_rel('<a href="http://x/">a</a><a href="/y">b</a>') == '<a rel="nofollow noreferrer" href="http://x/">a</a><a href="/y">b</a>'
    assert links.scheme("docs/readme:2") is None and links.scheme("\x01 HTTP:x") == "http"


def test_prefilter_never_loses_a_link():
    rng = random.Random(4)
    rules, _ = links.load_rules()
    parts = ["http://a.bc/d", "ftp.x.yz/q", "www.a.b.cd", "a@b.cd", "10.20.30.40", "10.20.30.40 80", "RFC 12", "rfc3", "news:a.b", " alt.x.y", "telnet a.b.cd 23", "plain", " ", "&lt;URL:x&gt;"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(5))
        for r in rules:
            if r.literals and not any(x in text.lower() for x in r.literals):
                assert r.regex.search(text) is None, (r.pattern, text)


def test_sections_notes_and_pages():
    html = "<p>before</p>\n<h2>One</h2>\n<p>x</p>\n<h3>Sub <i>it</i></h3>\n<h2>Two</h2>\n"
    assert sections.number(html).count("<h3>1.1 Sub") == 1
    toc, out = sections.sectionize(html, True)
    assert out.count("<article") == 3 and '<a href="#chunk-2">Sub it</a>' in toc
    made = sections.paged("S", html, "T", "doc", with_toc=True)
    assert [n for n, _ in made] == ["doc-chunk-01.html", "doc-chunk-02.html"] and "before" in made[0][1] and 'rel="prev"' in made[1][1]
    text = "<p>a{{quire:cite:x}} b{{quire:cite:y}} c{{quire:cite:x}}</p>\n<p>\n{{quire:def:cite:x}}\nX note\n{{/quire:def:cite:x}}\n</p>\n{{quire:def:cite:y}}\nY\n{{/quire:def:cite:y}}\n"
    out, found, wrong = notes.collect(text)
    assert not wrong and [n["number"] for n in found["cite"]] == [1, 2] and "X note" not in out and out.count('id="note-ref-x"') == 1
    assert '<li class="note" id="note-x">' in notes.render("cite", found["cite"])
    assert notes.collect("{{quire:cite:z}}")[2] == ["reference to z has no definition"]


def test_scripts():
    assert scripts.wrap("<b>漢字かな</b> and 中文, Ελλάδα!", "en") == '<b><span lang="ja">漢字かな</span></b> and <span lang="zh">中文</span>, <span lang="el">Ελλάδα</span>!'
    assert scripts.wrap("中文", "zh-Hans") == "中文"


def test_chunks():
    text = "One sentence here. Another, with a comma and more words " * 30
    parts = records.split_chars(text, 100)
    assert all(len(p) <= 100 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    assert records.split_point("a" * 300, 100) == 100
    assert records.expand_tabs("é\tx", 4) == "é  x"


def test_options():
    assert find_name("noextract") == ("extract", True) and find_name("ct")[0] == "caps_tag" and find_name("unhyph")[0] == "unhyphenation"
    with pytest.raises(OptionError):
        find_name("pre")
    o = from_arguments(["--no-html5", "--table_type", "ALIGN=1", "--heading", "^x", "a.txt", "--tw=4"])
    assert (o.html5, o.lower_case_tags, o.table_type.align, o.table_type.delim, o.custom_heading_regexp, o.infile, o.tab_width) == (False, False, True, False, ("^x",), ("a.txt",), 4)
    for bad in ({"tab_width": 0}, {"chunk_chars": 5}, {"stream": True, "toc": True}, {"lang": "e n"}, {"var": ("x",)}, {"custom_heading_regexp": ("(",)}, {"document_template": "a", "body_template": "b"}):
        with pytest.raises(OptionError):
            check(ConvertOptions(**bad))
    assert encoding("ISO_8859-1") == "latin-1"
    assert option_file("extract # note\n--title 'a b'\n") == ["--extract", "--title", "a b"]
    assert last_preset(["--preset", "a", "--preset=b"]) == "b"
    own = presets('[mail]\nname = "Mail"\noptions = { mailmode = true, s = 30 }\n')["mail"]["options"]
    o = layered(["title from-file"], own, ["--title", "argument"])
    assert (o.mailmode, o.short_line_length, o.title) == (True, 30, "argument")
    assert toml_value('["a", "b"]') == ["a", "b"]
    with pytest.raises(OptionError):
        toml_value("1.5")
