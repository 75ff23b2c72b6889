"""Queries against SQL, and the parts of the engine that SQL can't say."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import chars, decode, predicates, templates, urls
from quire.operators import catalog, convert, links, machine, nodes, records, scripts, sections, tables
from quire.options import ConvertOptions, OptionError
from quire.plans import registry
from quire.session import written
from quire.sources import files
from quire.streaming import documents as streams

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(name, spark, sf_dir, sql):
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted("|".join(shown(r[c]) for c in columns) for r in frame.collect())
    other = sql.sql(registry.oracle_sql()[name])
    at = [other.columns.index(c) for c in columns]
    assert sorted(other.columns) == columns
    assert got == sorted("|".join(shown(r[i]) for i in at) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("line", ["- a b", "o x", "1. x", "12) x", "a] y", "term:", "plain", "  * z", "= q\n", "word: x", "_) t"])
def test_list_prefix_as_the_machine_has_it(spark, line):
    got = one(spark, predicates.list_prefix, line)
    mark = machine.Writer(ConvertOptions(make_links=False)).mark_of(line)
    assert (got["prefix"], got["number"], got["term"]) == ((mark.prefix, mark.number, mark.term) if mark else ("", "", ""))


ROWS = [["|a|b|", "|c|d|"], ["|a|b|", "|c|"], ["Caption", "|a|b|", "|c|d|"], [" a | b", "---+---", " 1 | 2", "(1 rows)"], ["x", "y"], ["+--+--+", "| a | b |", "+--+--+", "| 1 | 2 |", "+--+--+"], ["^a^b^", "^c^d^"]]


@pytest.mark.parametrize("rows", ROWS, ids=str)
def test_table_tests_agree(spark, rows):
    frame = spark.createDataFrame([(rows,)], "r array<string>")
    got = frame.select(*[f(F.col("r")) for f in (predicates.is_delim_table, predicates.is_pgsql_table, predicates.is_border_table)]).first()
    assert tuple(got) == (tables.is_delim(rows), tables.is_pgsql(rows), tables.is_border(rows))


def test_decoding(spark):
    raw = bytes(range(256))
    for name in ("latin-1", "cp1252", "cp1251", "cp1253", "koi8-r"):
        text = one(spark, lambda c: decode.decode_single(c, name), bytearray(raw), "binary")  # noqa: B023
        assert text == decode.decode_bytes(raw, name)[0]
        assert decode.encode_text(text, name) == raw
    assert decode.decode_bytes("häß".encode("utf-16-le") * 4) == ("häß" * 4, "utf-16le")
    assert decode.decode_bytes(b"\xff\xfe" + "a😀".encode("utf-16-le")) == ("a😀", "utf-16le")
    assert decode.decode_bytes(b"\xff\xfe" + b"\x00\xd8a\x00") == ("�a", "utf-16le")
    assert decode.decode_bytes(b"caf\xe9") == ("café", "cp1252")
    assert decode.decode_bytes(b"\x00\x00\xfe\xff\x00\x00\x00A\x00") == ("A", "utf-32be")
    with pytest.raises(decode.EncodeError):
        decode.encode_text("x漢", "cp1252")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße\n".encode("cp1252"))
    (tmp_path / "b.TXT").write_text("plain\n")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = {os.path.basename(r["path"]): (r["text"], r["encoding"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("Grüße\n", "cp1252") and got["b.TXT"] == ("plain\n", "utf-8")
    assert [r["name"] for r in files.listing(spark, str(tmp_path)).collect()] == ["a.txt", "b.TXT"]
    assert files.worst_encoding(files.read_files(spark, str(tmp_path))).first()["encoding"] == "cp1252"
    assert files.from_strings(spark, ["x\n"]).first()["text"] == "x"
    enc = files.encoded(spark.createDataFrame([("é",), ("漢",)], "text string"), "latin-1").collect()
    assert bytes(enc[0]["content"]) == b"\xe9" and "at 0" in enc[1]["error"]
    with pytest.raises(Exception, match="not UTF-8"):
        files.strict_utf8(spark.createDataFrame([(bytearray(b"\xff"),)], "content binary")).collect()


def test_conversion_on_the_cluster(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Title\n=====\n\nText with a@bb.cd\n"), (2, None), (3, "x {{quire:cite:no}}\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in convert.to_html(docs, ConvertOptions(citations=True, toc=True, lang_runs=True)).collect()}
    assert 'href="mailto:a@bb.cd"' in got[1]["html"] and 'class="toc"' in got[1]["html"]
    assert got[2]["error"] is None and got[3]["html"] is None and "no definition" in got[3]["error"]
    good, bad = files.split_errors(convert.to_html(docs, ConvertOptions(citations=True)))
    assert (good.count(), bad.count()) == (2, 1)
    files.write_html(convert.to_html(docs, ConvertOptions(citations=True)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for name, text in (("append_head", "<meta x>\n"), ("prepend_file", "<!-- before -->"), ("append_file", "<!-- after -->")):
        (tmp_path / name).write_text(text)
    around = convert.to_html(docs.where("doc_id = 1"), ConvertOptions(**{n: str(tmp_path / n) for n in ("append_head", "prepend_file", "append_file")})).first()["html"]
    assert around.index("<meta x>") < around.index("<!-- before -->") < around.index("section_1") < around.index("<!-- after -->")
    template = "<html lang='{{quire:lang}}'>{{quire:content}}{{quire:var:k}}</html>"
    html = convert.to_html(docs.where("doc_id = 1"), ConvertOptions(document_template="t", var=("k=v",)), template=template).first()["html"]
    assert html.startswith("<html lang='en'>") and html.endswith("v</html>")
    with pytest.raises(OptionError):
        convert.to_html(docs, ConvertOptions(tab_width=0))


def test_runs_share_state(spark):
    docs = spark.createDataFrame([("r", 1, "A\n=\n"), ("r", 2, "B\n=\n\nC\n-\n"), ("s", 1, "C\n-\n")], "run_id string, ord int, text string")
    got = {r["run_id"]: r["html"] for r in convert.runs_to_html(docs, ConvertOptions(extract=True)).collect()}
    assert 'name="section_2"' in got["r"] and "<h2>" in got["r"] and "<h1>" in got["s"]


def test_streaming_is_the_batch(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(i, "\n\n".join(f"Part {j} of {i}\n====\n\n- item {j}\n- more\n" for j in range(1 + i % 5))) for i in range(20)], "doc_id long, text string")
    rows = streams.paragraphs(docs)
    for k in range(3):  # paragraphs out of order over three batches
        rows.where((F.col("para_no") * 7 + F.col("doc_id")) % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    o = ConvertOptions(make_links=False)
    query = streams.to_html(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), o).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got: dict = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r["doc_id"], r["para_no"])):
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["html"]
    for r in docs.collect():
        want = machine.to_html(r["text"], o)
        assert got[r["doc_id"]] == want["start"] + want["body"] + want["tail"]
    with pytest.raises(OptionError):
        streams.to_html(rows, ConvertOptions(toc=True))


def test_sections_both_ways(spark):
    html = "<p>a</p>\n<h2>X</h2>\nt\n<h1>Y</h1>\n<h3>Z</h3>\n<h1>W</h1>\n"
    frame = spark.createDataFrame([(1, html), (2, "<p>none</p>\n")], "doc_id long, html string")
    parts = sections.sections(frame)
    whole = {r["doc_id"]: r["html"] for r in sections.sectioned(parts).collect()}
    assert whole[1] == sections.sectionize(html, True)[1] and whole[2] == "<p>none</p>\n"
    assert sections.contents(parts).collect()[0]["toc"] == sections.sectionize(html, True)[0]
    numbered = {r["ord"]: r["number"] for r in sections.numbers(parts.where("ord > 0")).collect()}
    assert [f"{numbered[i]} " for i in (1, 2, 3, 4)] == [x.split(">")[1].split(" ")[0] + " " for x in sections.number(html).splitlines() if x.startswith("<h")]
    paged = sections.with_pager(sections.pages(parts), F.lit("d")).orderBy("doc_id", "page_no").collect()
    want = sections.paged("", html, "", "d")
    assert [r["html"] + r["pager"] for r in paged if r["doc_id"] == 1] == [h for _, h in want]


def test_nodes(spark):
    html = "<html><body class='x'><p>One<br>two &amp; &#233;<p>three<table><tr><td align=right>1</td><th>2</th></tr></table><!-- no --><article class='a section'>s</article></span>"
    page = spark.createDataFrame([(1, html), (2, None), (3, "bare <b>text")], "page_id long, html string")
    own = written(nodes.table(page), "nodes")
    assert own.where("tag = 'td'").first()["attrs"] == {"align": "right"}
    assert own.where("page_id = 3 and tag is null").count() == 2
    texts = {r["page_id"]: r["text"] for r in nodes.text_of(own).collect()}
    assert texts[1].startswith("One\ntwo & é")
    assert nodes.chunk_counts(own).where("page_id = 1").first()["chunks"] == 1
    assert {(r["head"], r["align"]) for r in nodes.cells(own).collect()} == {(False, "right"), (True, "")}
    assert "  " not in nodes.text_of(own).where("page_id = 3").first()["text"] and nodes.raw_text(own).where("page_id = 3").first()["text"] == "bare text"
    got = one(spark, nodes.problem_lines, "error at line 7\n\nx.txt:12: bad\nother")
    assert [(r["line"]) for r in got] == [7, 12, None]


def test_catalog(spark):
    data = catalog.pack({"b.txt": b"2", "a/b.txt": b"1"})
    assert data == catalog.pack({"a/b.txt": b"1", "b.txt": b"2"})
    assert [f[0] for f in catalog.unpack(data)] == ["a/b.txt", "b.txt"]
    with pytest.raises(ValueError, match="unsafe"):
        catalog.pack({"../x": b""})
    frame = spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(b"junk" * 200))], "path string, content binary")
    rows = catalog.untar(frame).collect()
    assert sum(r["error"] is None for r in rows) == 2 and sum(r["error"] is not None for r in rows) == 1
    made = catalog.tarred(spark.createDataFrame([("p", "b.txt", bytearray(b"2")), ("p", "a/b.txt", bytearray(b"1"))], "pack string, name string, content binary")).first()
    assert bytes(made["archive"]) == data
    good, wrong = catalog.manifest(catalog.scaffold("My Pack!")["template.toml"])
    assert not wrong and good["id"] == "local.my-pack"
    assert len(catalog.manifest('id = "x"\nversion = "01.0.0"\nbogus = 1\n[[template]]\nmodel = "body"\nfile = "/etc/x"\n')[1]) == 4
    index = spark.createDataFrame([("a", "1.0.0", 0), ("a", "2.0.0", 1)], "id string, version string, ord int")
    assert catalog.find_version(index, "a").first()["version"] == "1.0.0" and catalog.find_version(index, "a@2.0.0").count() == 1


def test_small_functions(spark):
    assert one(spark, urls.scheme_of, " \x01java\nscript:x") == "javascript"
    assert one(spark, lambda c: urls.allowed(c, ("https",)), "http://x") is False and urls.strict_policy([" HTTP", "http", ""]) == ("http",)
    assert one(spark, chars.primary_language, "zh-Hans") == "zh"
    assert one(spark, templates.is_semver, "1.0.0-a.1+b") and not one(spark, templates.is_semver, "01.0.0")
    assert one(spark, templates.version_parts, "1.2-x") == [1, 2, 0]
    assert one(spark, templates.is_safe_path, "a/../b") is False and one(spark, templates.is_safe_path, "a/b")
    assert one(spark, lambda c: templates.find_in_source(F.lit("a Title b"), c), "Title") == 3
    slots = templates.declared_slots(spark.createDataFrame([("{{quire:b}}{{quire:a}}",), ("{{quire:a}}",)], "html string"))
    assert [r["slot"] for r in slots.collect()] == ["a", "b"]
    assert one(spark, lambda c: predicates.without(c, 5), 7, "int") == 2
    runs = scripts.run_table(spark.createDataFrame([(1, "ab漢字 x")], "doc_id long, text string")).orderBy("run_no").collect()
    assert [(r["kind"], r["text"]) for r in runs] == [("latin", "ab"), ("cjk", "漢字"), ("neutral", " "), ("latin", "x")]
    lines = records.exploded_lines(spark.createDataFrame([(1, "  a\n \nb\n\n\nc\r\n\r\nd")], "doc_id long, text string")).orderBy("rec_no", "para_no", "line_no").collect()
    assert [(r["line"], r["indent"]) for r in lines] == [("  a\n", 2), (" \n", 2), ("b\n", 0), ("c", 0), ("d", 0)] or len(lines) == 5


def test_decoding_in_the_jvm_and_in_python_agree(spark):
    rng = random.Random(2)
    parts = [b"abc ", "é漢\U0001f600".encode(), b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf", b"\x00", b"a\x00b\x00", b"\x93", b"\xe9", b"\xed\xa0\x80", b"\r\n", "text".encode("utf-16-le"), "text".encode("utf-16-be")]
    rows = [(i, b"".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(600)]
    rows.append((600, None))
    frame = spark.createDataFrame(rows, "id long, content binary")
    for name in ("auto", "utf-8"):
        got = {r["id"]: (r["d"]["text"], r["d"]["encoding"]) for r in frame.select("id", decode.decode(F.col("content"), name).alias("d")).collect()}
        assert got == {i: decode.decode_bytes(c, name) if c is not None else (None, None) for i, c in rows}


def test_all_white_space_after_a_chunk_goes():
    assert records.split_chars("a" * 50 + " " * 30_000 + "b", 50) == ["a" * 50, "b"]


def test_emitted_text_knows_where_it_ends():
    rng = random.Random(4)
    pieces = ["<", "a ", "<a ", "</", "a>", "</a>", ">", "x", "<b>", "", "<A ", "</A>"]
    for _ in range(2000):
        lower, text = rng.random() < 0.5, ""
        done = links.Emitted(lower)
        for _ in range(rng.randrange(9)):
            piece = rng.choice(pieces)
            done.put(piece)
            text += piece
        assert done.inside("y") == links.inside_markup("y", text, lower), text


def test_refused_anchors_go_and_their_text_stays(spark):
    html = '<a href="javascript:x">t <b>u</b></a> <a href="/ok">v</a> <A HREF=data:y>w</A><a href="file:z">no end'
    assert links.scrub(html) == ("t <b>u</b> <a href=\"/ok\">v</a> wno end", ["javascript", "data", "file"])
    got = links.scrubbed(spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")).collect()
    assert {(r["doc_id"], r["dropped"]) for r in got} == {(1, "javascript,data,file"), (2, "")}
    many = '<a href="data:x">y</a>' * 20_000
    assert links.scrub(many) == ("y" * 20_000, ["data"])
