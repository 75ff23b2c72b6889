"""Templates, presets, packs and the command line."""

import io
import sys

import pytest

from quire import cli, library
from quire.operators import catalog, convert
from quire.options import ConvertOptions, OptionError
from quire.sources import files, packs
from quire.streaming import documents as streams


def test_library(spark):
    assert library.templates(spark).count() == 6 and library.presets(spark).count() == 9
    assert library.preset("mail").mailmode and library.preset("private").no_referrer
    with pytest.raises(OptionError):
        library.preset("nothing")
    with pytest.raises(OptionError):
        library.template("nothing")
    o = ConvertOptions(toc=True, custom_heading_regexp=("^x",), tab_width=4)
    assert library.from_json(library.to_json(o)) == o
    assert library.describe(ConvertOptions()) == "defaults" and "tab width: 4" in library.describe(o)


def test_packs(spark, tmp_path):
    files = {k: v.encode() for k, v in catalog.scaffold("One").items()}
    target = packs.install(files, str(tmp_path / "a"))
    packs.install({**files, "template.toml": files["template.toml"].replace(b"0.1.0", b"0.2.0")}, str(tmp_path / "b"))
    rows = packs.discover(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert {(r["version"], r["wins"]) for r in rows} == {("0.1.0", True), ("0.2.0", False)}
    with pytest.raises(ValueError, match="content slot"):
        packs.install({**files, "one.html": b"x"}, str(tmp_path / "c"))
    data = catalog.pack(packs.folder_files(target))
    with pytest.raises(ValueError, match="catalog names"):
        packs.install_archive(data, str(tmp_path / "c"), "0" * 64)
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "catalog.toml").write_text('[[pack]]\nid = "local.one"\nversion = "0.1.0"\narchive = "one.tar"\ntags = ["t"]\n[[pack]]\nid = "x"\narchive = "../x"\n')
    found, wrong = packs.catalogs(spark, [str(tmp_path / "cat"), str(tmp_path / "none")])
    assert found.count() == 1 and len(wrong) == 2
    packs.remove(str(tmp_path / "a"), "local.one")
    assert packs.folder_files(str(tmp_path / "a")) == {}


def test_command_line(tmp_path, capsys, monkeypatch):
    (tmp_path / "in.txt").write_text("Title\n=====\n\ntext\n\nNext\n====\n\nmore\n")
    out = str(tmp_path / "out.html")
    assert cli.main(["--toc", "--outfile", out, "--report", str(tmp_path / "in.txt")]) == 0
    assert 'href="#chunk-2"' in open(out).read() and "headings" in capsys.readouterr().err
    assert cli.main(["--chunk", "--outfile", out, str(tmp_path / "in.txt")]) == 0
    assert (tmp_path / "out-chunk-02.html").exists()
    assert cli.main(["--template_library", "article", "--title", "T", str(tmp_path / "in.txt")]) == 0
    assert "<main>" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"from stdin\n")))
    assert cli.main(["--extract", "--preset", "mail"]) == 0 and "from stdin" in capsys.readouterr().out
    assert cli.main(["--extract", "--instring", "given"]) == 0 and "<p>given" in capsys.readouterr().out
    assert cli.main(["--outfile", str(tmp_path / "in.txt"), str(tmp_path / "in.txt")]) == 2
    assert cli.main([str(tmp_path / "missing.txt")]) == 1
    assert cli.main(["--bogus"]) == 2 and cli.main(["--help"]) == 0
    pack = str(tmp_path / "mine")
    assert cli.main(["templates", "new", pack]) == 0 and cli.main(["templates", "validate", pack]) == 0
    root = f"--template_dir={tmp_path / 'root'}"
    assert cli.main(["templates", "install", pack, root]) == 0
    assert cli.main(["templates", "pack", pack, str(tmp_path / "mine.tar")]) == 0 and cli.main(["templates", "unpack", str(tmp_path / "mine.tar"), str(tmp_path / "again")]) == 0
    capsys.readouterr()
    assert cli.main(["templates", "list", root]) == 0 and "local.mine" in capsys.readouterr().out
    for verb in (["inspect", "local.mine"], ["inspect", "book"], ["sources"], ["update"], ["search", "x"], ["verify"], ["remove", "local.mine"]):
        assert cli.main(["templates", *verb, root]) == 0
    assert cli.main(["templates", "odd"]) == 2


def _sealed(head):
    head = bytearray(head)
    head[148:156] = b" " * 8
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def test_archives_are_read_strictly(spark):
    files_ = {"a.html": b"x" * 700, "d/b.txt": b""}
    good = catalog.pack(files_)
    assert [(n, c) for n, _, _, c in catalog.unpack(good)] == sorted(files_.items())
    head, rest = good[:512], good[512:]
    bad = {
        "empty": b"", "blocks": good[:-1], "breaks off": good[:512], "end mark": good[:1536], "follows": good + b"\0" * 511 + b"x", "ustar": _sealed(head[:257] + b"ustar  \0" + head[265:]) + rest,
        "checksum": head[:100] + b"0000640" + head[107:] + rest, "octal": _sealed(head[:124] + b"00000000009\0" + head[136:]) + rest, "link": _sealed(head[:156] + b"2" + head[157:]) + rest,
        "neither": _sealed(head[:156] + b"3" + head[157:]) + rest, "run": _sealed(head[:100] + b"0000755\0" + head[108:]) + rest, "data": _sealed(head[:156] + b"5" + head[157:]) + rest,
        "twice": good[:1536] + good, "unsafe": _sealed(b"../x\0\0" + head[6:]) + rest, "UTF-8": _sealed(b"\xff" + head[1:]) + rest,
    }
    for word, data in bad.items():
        with pytest.raises(ValueError, match=word):
            catalog.unpack(data)
    with pytest.raises(ValueError, match="large"):
        catalog.unpack(good, 100)
    rows = catalog.untar(spark.createDataFrame([("g", good), ("b", bad["checksum"]), ("n", None)], "path string, content binary")).collect()
    assert sorted((r["path"], r["name"] or "", r["error"] is None) for r in rows) == [("b", "", False), ("g", "a.html", True), ("g", "d/b.txt", True), ("n", "", False)]


def test_template_entries_are_checked():
    ok = {"name": "x", "model": "body", "file": "x.html", "slots": ["title"], "var": [{"name": "a"}]}
    assert catalog.template_problems(ok) == []
    for change, word in (({"model": "page"}, "neither"), ({"file": "../x"}, "leaves"), ({"preview": "/x"}, "preview"), ({"slots": ["odd"]}, "unknown slot"), ({"var": [{"name": "a"}, {"name": "a"}]}, "twice"), ({"var": [{}]}, "without")):
        assert word in " ".join(catalog.template_problems(ok | change))
    assert "no model" in catalog.template_problems({"file": "x"})


def test_entries_are_found_across_catalogs(spark):
    index = spark.createDataFrame([(0, 0, "one", "p", "1.0", "a"), (0, 1, "one", "p", "2.0", "b"), (1, 0, "two", "p", "3.0", "c"), (1, 1, "two", "q", "1.0", "d")], "catalog_no int, ord int, catalog string, id string, version string, archive string")
    asks = spark.createDataFrame([("p",), ("p@3.0",), ("p@9",), ("q",), ("z",)], "ask string")
    got = {r["ask"]: (r["archive"], r["versions"]) for r in catalog.find_across(index, asks).collect()}
    assert got == {"p": ("a", None), "p@3.0": ("c", None), "p@9": (None, ["1.0", "2.0", "3.0"]), "q": ("d", None), "z": (None, [])}


def test_html_files(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("source")
    with pytest.raises(OSError, match="converted"):
        files.save_html("x", str(tmp_path / "." / "in.txt"), str(source))
    (tmp_path / "link").symlink_to(source)
    with pytest.raises(OSError, match="converted"):
        files.save_html("x", str(tmp_path / "link"), str(source))
    files.save_html("<p>é\r\n", str(tmp_path / "out.html"), str(source))
    assert (tmp_path / "out.html").read_bytes() == "<p>é\r\n".encode() and source.read_text() == "source"
    pages = spark.createDataFrame([("a/one.html", "<p>1"), ("two.html", "é"), ("../x", "no"), ("in.txt", "no"), ("null.html", None)], "name string, html string").repartition(3)
    got = {r["name"]: (r["bytes"], r["error"] is None) for r in files.write_files(pages, str(tmp_path), sources=(str(source),)).collect()}
    assert got == {"a/one.html": (4, True), "two.html": (2, True), "../x": (None, False), "in.txt": (None, False), "null.html": (0, True)}
    assert (tmp_path / "a" / "one.html").read_text() == "<p>1" and source.read_text() == "source" and not list(tmp_path.glob(".*"))
    rows = [(r["name"], r["is_dir"]) for r in files.listing(spark, str(tmp_path), (".html",)).collect()]
    assert rows == [("a", True), ("null.html", False), ("out.html", False), ("two.html", False)]


def test_bursts_of_requests_are_one_conversion(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00.000", "a"), (1, "2024-01-01 00:00:00.200", "b"), (1, "2024-01-01 00:00:01.000", "c"), (2, "2024-01-01 00:00:00.100", "d"), (9, "2024-01-01 00:10:00", "late")]
    own = spark.createDataFrame(rows, "doc_id long, at string, text string").selectExpr("doc_id", "to_timestamp(at) AS at", "text")
    want = [(1, 1, "c"), (1, 2, "b"), (2, 1, "d")]
    shown = lambda frame: sorted((r["doc_id"], r["requests"], r["text"]) for r in frame.collect() if r["doc_id"] < 9)
    assert shown(streams.debounced(own)) == want
    own.write.parquet(str(tmp_path / "in"))
    stream = streams.debounced(spark.readStream.schema(own.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == want


def test_recent_and_previous(spark):
    jobs = spark.createDataFrame([(k % 3, k, f"h{k}") for k in range(9)], "doc int, gen int, html string")
    assert [(r["doc"], r["last"]) for r in convert.recent(jobs, "doc", "gen", 2).collect()] == [(2, 8), (1, 7)]
    assert {(r["gen"], r["before_html"]) for r in convert.with_previous(jobs, "doc", "gen", "html").collect()} == {(k, f"h{k - 3}" if k > 2 else None) for k in range(9)}
