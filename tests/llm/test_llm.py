"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm import op1_html, op2_suffix, op3_pii, op4_langid, op5_packing, op6_jpeg, op7_jaccard, op8_toxicity, op9_quality, op10_mixing, queries
from quire.llm.common import map_rows
from quire.session import BATCH_CONF, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_rows():
    base = words_of(80, 1)
    long = words_of(30_000, 2, 3000)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace("w1", "v1", 1), "en", "b", 1),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, "   \n\t ", "en", "b", 6),
        (7, long, "de", "a", 1),
        (7, long, "de", "a", 1),
        (None, "naïve café \U0001f600 3.4 @ + . a@b", None, None, None),
        (9, "1234567890 !!! ###", "en", "c", 3),
        (10, "ab" * 400, "fr", "c", 800),
        (11, "a", "fr", "c", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    # clashing names: operators must not take these for their own columns
    frame = spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"size": F.lit("s"), "score": F.lit("x"), "node": F.lit(1), "at": F.lit(2), "uid": F.lit(None).cast("string")})
    return written(frame, "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


DOCUMENT_QUERIES = [op2_suffix, op3_pii, op4_langid, op5_packing, op6_jpeg, op7_jaccard, op9_quality, op10_mixing]


@pytest.mark.parametrize("module", DOCUMENT_QUERIES, ids=lambda m: m.__name__.split(".")[-1])
def test_odd_and_empty_tables(module, odd, empty):
    got = module.query(odd).toPandas()
    per = Counter(got["doc_id"].fillna(-1).astype(int))
    if module is not op5_packing:
        assert per == Counter(-1 if r[0] is None else r[0] for r in odd_rows())
    else:
        assert set(per) == {-1 if r[0] is None else r[0] for r in odd_rows()}
    assert module.query(empty).count() == 0


def test_toxicity_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    assert op8_toxicity.query(odd, labels).count() == len(odd_rows())
    assert op8_toxicity.query(empty, labels.limit(0)).count() == 0


# 1 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Home<li>About</ul></nav><div class="ad">Buy {i}</div><div id="main-col">
<article class="post"><header class="entry-header"><h1>Title &amp; {i}</h1></header><p>First <b>bold</b>
 and&nbsp;<i>more</i> {i}.<p>Second &eacute;&#233;<br>line {i}</p><ul><li>one {i}<li>two</ul><div class="share-buttons">Share</div><p>Always here.</p>
<aside>Aside</aside><form><input><label>Mail</label></form></article><section id="comments"><p>Nice {i}!</p></section></div>
<div class="sidebar"><p>Side</p></div><footer>&copy; x {i}</footer></body></html>"""


def test_html(spark):
    pages = [(i, f"https://h.example.org/p{i}", PAGE.format(i=i)) for i in range(6)] + [(90, None, None), (91, "x", ""), (92, "http://solo.example/", "<body><p>Only <p>this &lt;b&gt;</body>"), (92, "http://solo.example/", "plain < text")]
    got = {(r["page_id"], r["text"]) for r in op1_html.query(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {(i, f"Title & {i}\n\nFirst bold and more {i}.\n\nSecond éé line {i}\n\none {i}\n\ntwo\n\nAlways here.") for i in range(6)}
    assert want | {(90, ""), (91, ""), (92, "Only\n\nthis <b>"), (92, "plain < text")} == got


def test_html_slot_without_an_article_element(spark):
    page = "<html><body><div class='top'>Menu a b c</div><div class='wrap'><div class='text'><p>{0}</p><p>{1}</p></div></div><div class='foot'>fixed words</div></body></html>"
    pages = [(i, f"http://a.example/{i}", page.format(words_of(30, i), words_of(40, i + 100))) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in op1_html.query(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{words_of(30, i)}\n\n{words_of(40, i + 100)}" for i in range(8)}


def test_html_hosts_of_mixed_layouts(spark):
    one = "<body><nav>n</nav><article><p>{0}</p></article><p>note outside</p></body>"
    two = "<body><div class='menu'>m</div><div class='t'><p>{0}</p></div></body>"
    pages = [(i, f"http://m.example/{i}", (one if i % 2 else two).format(words_of(20, i))) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in op1_html.query(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: words_of(20, i) for i in range(10)}


def html_rows(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame = frame.withColumns({"host": F.lit("own"), "token": F.lit(1), "slots": F.lit("s"), "text": F.lit("t"), "rows": F.lit(2)})
    return sorted(((r["page_id"], r["text"]) for r in op1_html.query(frame).collect()), key=repr)


BOXED = "<html><body><div class='top'>Menu a b c</div><div class='wrap'><div class='text'><p>{0}</p><p>{1}</p></div></div><div class='foot'>fixed words</div></body></html>"


def test_html_long_blocks_that_differ_at_the_end_stay(spark):
    same = words_of(120, 5)
    pages = [(i, f"http://l.example/{i}", BOXED.format(f"{same} end{i}", "the same notice")) for i in range(6)]
    assert html_rows(spark, pages) == [(i, f"{same} end{i}") for i in range(6)]


def test_html_repeated_empty_and_null_pages_do_not_hide_the_template(spark):
    pages = [(i, f"http://r.example/{i}", BOXED.format(words_of(30, i), "the same notice")) for i in range(8)]
    pages += [pages[3], pages[3], (20, "http://r.example/20", None), (21, "http://r.example/21", ""), (22, "http://r.example/22", " \n")]
    want = [(i, words_of(30, i)) for i in (0, 1, 2, 3, 3, 3, 4, 5, 6, 7)] + [(20, ""), (21, ""), (22, "")]
    assert html_rows(spark, pages) == sorted(want, key=repr)


def test_html_layouts_without_article_elements(spark):
    one = "<body><div class='bar'>m1 m2</div><div class='story'><p>{0}</p><p>note a</p></div><div class='end'>x y</div></body>"
    two = "<body><div class='list'>l1 l2</div><div class='entry'><p>{0}</p><p>note b</p></div><div class='low'>z</div></body>"
    pages = [(i, f"http://two.example/{i}", (one if i % 5 < 3 else two).format(words_of(25, i))) for i in range(20)]
    assert html_rows(spark, pages) == sorted(((i, words_of(25, i)) for i in range(20)), key=repr)


def test_html_pages_that_are_all_the_same_keep_their_text(spark):
    pages = [(i, f"http://same.example/{i}", BOXED.format(words_of(30, 1), words_of(30, 2))) for i in range(7)]
    assert html_rows(spark, pages) == [(i, f"{words_of(30, 1)}\n\n{words_of(30, 2)}") for i in range(7)]


def test_html_empty_table_and_very_long_page(spark):
    assert html_rows(spark, []) == []
    blocks = [words_of(30, i) for i in range(3000)]
    page = "<body><nav>n</nav><article>" + "".join(f"<p>{b}" for b in blocks) + "</article></body>"
    assert html_rows(spark, [(1, "http://long.example/", page)]) == [(1, "\n\n".join(blocks))]


def brute_template(pages):
    """Vectors as tuples over all pages, in plain Python: the texts that every page of a host has once at one path."""
    seen = [Counter((path, text) for path, text in op1_html.events(p) if text is not None) for p in pages]
    return {key for key in set().union(*seen) if all(s[key] == 1 for s in seen)}


def test_html_fixed_texts_against_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for i in range(9):
        inner = [f"<p>{words_of(8, 100 * i + k)}</p>" for k in range(rng.randrange(2, 5))] + ["<p>always</p>"] + (["<p>now and then</p>"] if i % 2 else []) + ["<p>twice</p>"] * 2
        rng.shuffle(inner)
        pages.append(f"<body><div class='t'>{''.join(inner)}</div></body>")
    fixed = brute_template(pages)
    want = [(i, "\n\n".join(text for path, text in op1_html.events(p) if text is not None and (path, text) not in fixed)) for i, p in enumerate(pages)]
    assert {t for _, t in fixed} == {"always"}
    assert html_rows(spark, [(i, "http://b.example/", p) for i, p in enumerate(pages)]) == want


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_suffix(rows):
    seen, out = {}, []
    for order, (doc, text) in enumerate(sorted(rows)):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen[s] = (order, p)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op2_suffix, "SLICE", 1500)
    rng = random.Random(5)
    passages = [words_of(40, s) for s in range(6)]
    rows = []
    for i in range(60):
        parts = [words_of(rng.randrange(1, 60), 1000 + i)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(60)
            parts += [p[a : a + rng.randrange(90, 160)], words_of(rng.randrange(8), rng.random())]
        rows.append((i, "".join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1][:150] + "é" + rows[3][1][151:]), (62, "ab" * 300), (63, "z" * 3000), (64, "z" * 99), (65, "xz" + "ab" * 120), (66, "x" * 100 + "y" * 7 + "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in op2_suffix.query(docs).collect())
    assert got == brute_suffix(rows)


def test_suffix_ids_that_are_no_numbers(spark):
    text = words_of(60, 9)
    rows = [("b", "x " + text), ("a", text + " y"), (None, text), ("c", "short")]
    got = {r["doc_id"]: r["n_removed"] for r in op2_suffix.query(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {None: 0, "a": len(text), "b": len(text), "c": 0}


def test_suffix_cells_cover_every_window_once():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 4000, dtype=np.uint8)
    ahead = rng.integers(0, 51, 40)
    more = np.array([rng.integers(0, a + 1) for a in ahead])
    base = np.arange(40) * 90
    for wide in op2_suffix.CELLS:
        rank, rest, uid, at, shape = op2_suffix.cells(data, np.arange(40), base, base, ahead << 8 | more, wide)
        seen = Counter((u, p) for u, a, s in zip(uid.tolist(), at.tolist(), shape.tolist()) for p in range(a, a + (s & 255) + 1))
        assert seen == Counter((u, p) for u in range(40) for p in range(base[u], base[u] + more[u] + 1))
        assert ((shape & 255) < wide).all() and (at + (shape >> 8) == base[uid] + ahead[uid]).all()


# 3 ---------------------------------------------------------------------------------------------------------------

FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in FIXED.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.co", "x..y@z", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.004.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "é", " ", "a@b@c.d.e", "12", "-", ".", "%+-@q.r", "5500005555555559"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert op3_pii.base_spans(text) == brute_base(text), text


def test_pii_adds_secrets_and_leaves_plain_text(spark):
    secrets = ['token = "%s" then' % hashlib.sha1(b"%d" % i).hexdigest() for i in range(30)] + ["password=%s end" % hashlib.md5(b"%d" % i).hexdigest()[:18] for i in range(30)] + ["key AKIA6FZM54CNMW7H%dEU x" % i for i in range(10, 30)]
    plain = ["the token is lost and the password was forgotten by 12 people in 1999", "Licensed under version 2.0 of the key = value form"] * 40
    docs = spark.createDataFrame(list(enumerate(secrets + plain)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in op3_pii.query(docs).collect()}
    assert all("secret:" in got[i] for i in range(len(secrets)))
    assert not any(got[i] for i in range(len(secrets), len(got)))


def test_pii_takes_long_values_whole(spark):
    rng = random.Random(4)
    token = "eyJ" + "".join(rng.choice("abcdefghijkXYZ") + rng.choice("23456789") + "-" for _ in range(150))
    parted = "x7" * 120 + "/10.20.30.40/" + "y8" * 120
    hexed = "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(150))
    prefixed = "ghp_" + "".join(rng.choice("abcdefXYZ") + rng.choice("0123456789") for _ in range(150))
    short = ['token = "%s" then' % hashlib.sha1(b"%d" % i).hexdigest() for i in range(30)] + ["key %s end" % hashlib.sha1(b"%d" % i).hexdigest() for i in range(30)]
    texts = [f"token: {token} end", f"see {hexed} end", f"use {prefixed} end", f"token: {parted} end", *short, *["the token is lost and the password was forgotten by 12 people in 1999"] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in op3_pii.query(docs).collect()}
    assert [got[0], got[1], got[2]] == [f"secret:7:{7 + len(token)}", "secret:4:304", f"secret:4:{4 + len(prefixed)}"]
    new = {r["doc_id"]: r["text"] for r in op3_pii.stage(docs).collect()}
    assert [new[i] for i in range(4)] == ["token: <SECRET> end", "see <SECRET> end", "use <SECRET> end", "token: <SECRET><IP><SECRET> end"]


def test_added_spans_beside_base_spans_against_brute_force():
    rng = random.Random(5)
    weights = np.zeros(2 * len(op3_pii.LABELERS) + op3_pii.SHAPE + 1)  # everything is a span
    for _ in range(500):
        base = [("x", a, a + rng.randrange(1, 30)) for a in (rng.randrange(300) for _ in range(rng.randrange(12)))]
        at, found = 0, []
        while at < 300:
            a = at + rng.randrange(20)
            at = a + rng.randrange(4, 60)
            found.append((a, at, "-" * len(op3_pii.LABELERS) + "0000"))
        want = []
        for a, b, _ in found:
            free = "".join("0" if any(x <= p < y for _, x, y in base) else "1" for p in range(a, b))
            want += [("secret", a + m.start(), a + m.end()) for m in re.finditer("1{4,}", free)]
        assert op3_pii.added(found, base, weights, 0.5) == want


def test_adding_spans_is_linear_in_base_spans():
    import time

    took = []
    for n in (20_000, 80_000):
        base = [("ip", 20 * i, 20 * i + 8) for i in range(n)]
        found = [(20 * i + 9, 20 * i + 18, "y" * len(op3_pii.LABELERS) + "0000") for i in range(n)]
        began = time.perf_counter()
        op3_pii.added(found, base, np.ones(2 * len(op3_pii.LABELERS) + op3_pii.SHAPE + 1), 0.5)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_shape_tells_random_values_from_words():
    assert op3_pii.shape("password") < op3_pii.shape("p4S9w0rDq8") and op3_pii.shape("é")[1] == "0"
    assert [op3_pii.listed(v) for v in ("DE44500105175407324931", "QQ12 3456 7890", "me (at) host.org", "me (at) host.zzz", "changeme1")] == ["y", "-", "y", "-", "n"]


# 4 and 8 ---------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op4_langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "")], "doc_id long, text string")
    model = op4_langid.learn(docs)
    assert [r["lang_pred"] for r in op4_langid.classify(odd, model, ["doc_id"]).collect()] == ["und"] * 3


def test_language_slices_lose_no_n_gram(monkeypatch):
    is_letter = op4_langid.letters()
    points = op4_langid.code_points(words_of(60, 3) + " x", is_letter)
    whole = np.sort(op4_langid.grams(points, 16))
    for size in (3, 4, 7, 100):
        monkeypatch.setattr(op4_langid, "SLICE", size)
        got = np.concatenate([op4_langid.grams(part, 16, again) for part, again in op4_langid.pieces(points)])
        assert len(whole) == 2 * len(points) - 3 and (np.sort(got) == whole).all()


def test_language_scores_against_brute_force(spark):
    # the same naive Bayes over plain n-grams, in dictionaries
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}
    say = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, say(alphabets[lang], 30), lang) for i, lang in enumerate(sorted(alphabets) * 40)]
    rows += [(1000 + i, say(rng.choice(list(alphabets.values())) + rng.choice(list(alphabets.values())), 3), None) for i in range(60)]
    got = {r["doc_id"]: r["lang_pred"] for r in op4_langid.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = [(t, lang) for d, t, lang in rows if lang and zlib.crc32(str(d).encode()) % 5]
    counts = {lang: {2: Counter(), 3: Counter()} for lang in alphabets}
    all_grams = lambda t, n: (f" {t} "[i : i + n] for i in range(len(t) + 3 - n))
    for t, lang in learned:
        for n in (2, 3):
            counts[lang][n].update(all_grams(t, n))
    known = {n: set().union(*(counts[lang][n] for lang in alphabets)) for n in (2, 3)}

    def score(t, lang):
        total = np.log(sum(x == lang for _, x in learned))
        for n in (2, 3):
            size = sum(counts[lang][n].values()) + 0.5 * len(known[n])
            total += sum(np.log((counts[lang][n][g] + 0.5) / size) for g in all_grams(t, n) if g in known[n])
        return total

    want = {d: max(sorted(alphabets), key=lambda lang: score(t, lang)) for d, t, _ in rows}
    assert sum(got[d] != want[d] for d in want) <= 1  # buckets may collide


def test_language_stage_drops_what_is_in_no_learned_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    strange = ["съешь же ещё этих мягких французских булок " * 5, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)), None, "12 34"]
    extra = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra.withColumn("lang", F.lit(None).cast("string")))
    kept = {r["doc_id"] for r in op4_langid.stage(both).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert op4_langid.stage(odd).columns == odd.columns


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = op8_toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["toxic"] == 1) == (got["predicted"] == 1)).mean() > 0.95


# 5 ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6, "Á x\r\ny z <|endoftext|> it's 12,5 ßÉİ   end"), (10**6 + 1, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    got = op5_packing.query(docs).toPandas()
    for doc, rows in got.groupby("doc_id"):
        ids, at = want[doc], 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert set(got["doc_id"]) == set(want)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum()[:-1]] and rows["length"].sum() <= 2048
    assert got["length"].sum() / (2048 * got["sequence_id"].nunique()) > 0.97


def test_chunks_are_tokenised_like_whole_texts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(7)
    monkeypatch.setattr(op5_packing, "PART", 200)
    monkeypatch.setattr(op5_packing, "KNOWN", 50)
    made = op5_packing.Ids(path)
    pieces = ["word", "Word.", "word,,", "...", "a.b", "3.5", "12!", "é?", "ÉÀ;", '"q".', "x's", "don't.", "<|endoftext|>", "<|startoftext|>.", "\t", " ", "\n", "\r\n", "日本.", "ß:", "İ", "e\u0301.", "_", "-.", ".-", "\u00a0", "x\u00a0.", "²."]
    for _ in range(300):
        texts = [rng.choice([None, "", "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(80)))]) for _ in range(4)]
        for text, ids in zip(texts, made(texts)):
            assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_repeated_rows_and_rows_without_an_id_spread_over_groups(spark):
    rows = spark.createDataFrame([(None, 0, 5, 9, 5)] * 400, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").repartition(3)
    got = op5_packing.pack(written(rows, "same-pieces"), 50).toPandas()
    assert (got["sequence_id"] // (1 << 32)).value_counts().max() < 120 and len(got) == 400


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 2049, 3000))[::-1]
    rooms, want = [], []
    for size in lengths.tolist():
        fit = min((r for r in rooms if r >= size), default=None)
        if fit is None:
            rooms.append(2048 - size)
        else:
            rooms.remove(fit)
            rooms.append(fit - size)
        want.append(fit)
    sequence, offset = op5_packing.best_fit(lengths)
    assert [None if o == 0 else 2048 - o for o in offset.tolist()] == [None if w is None or w == 2048 else w for w in want]
    assert len(set(sequence)) == len(rooms)


# 6 ---------------------------------------------------------------------------------------------------------------


def huffman_file(coefficients, restart):
    """A plain encoder with run lengths: units x 1 x 64 in zigzag order, one component."""
    symbols = [(run << 4 | size) for run in range(16) for size in range(1, 11)] + [0x00, 0xF0]
    table = lambda values: (bytes([0] * 7 + [len(values)] + [0] * 8), bytes(values))
    dc, ac = table(list(range(12))), table(symbols)
    codes = [{s: format(i, "08b") for i, s in enumerate(t[1])} for t in (dc, ac)]

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    out, before = [], 0
    intervals = []
    for u, block in enumerate(coefficients[:, 0]):
        if restart and u and u % restart == 0:
            intervals.append("".join(out))
            out, before = [], 0
        size, extra = value(int(block[0]) - before)
        before = int(block[0])
        out.append(codes[0][size] + extra)
        run = 0
        last = max(np.flatnonzero(block[1:]) + 1, default=0)
        for v in block[1 : last + 1].tolist():
            if not v:
                run += 1
                continue
            while run > 15:
                out.append(codes[1][0xF0])
                run -= 16
            size, extra = value(v)
            out.append(codes[1][run << 4 | size] + extra)
            run = 0
        if last < 63:
            out.append(codes[1][0])
    intervals.append("".join(out))
    data = b""
    for i, bits in enumerate(intervals):
        bits += "1" * (-len(bits) % 8)
        data += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(intervals) else b"")
    seg = op6_jpeg._segment
    n = len(coefficients)
    return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([3] * 64)) + seg(0xC0, bytes([8]) + (8).to_bytes(2, "big") + (8 * n).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])) + seg(0xC4, bytes([0x00]) + dc[0] + dc[1] + bytes([0x10]) + ac[0] + ac[1]) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_files_decode(restart):
    rng = np.random.default_rng(restart)
    want = np.where(rng.random((10, 1, 64)) < 0.2, rng.integers(-300, 300, (10, 1, 64)), 0)
    own = op6_jpeg.encode(op6_jpeg.padded(b"\xff" * 500))
    (headers, got), (other, payload) = op6_jpeg.decode_many([huffman_file(want, restart), own])
    assert (got == want).all() and (headers["width"], headers["height"]) == (80, 8)
    assert op6_jpeg.payload_of(other, payload) == op6_jpeg.padded(b"\xff" * 500)
    assert op6_jpeg.thumbnail(headers, got).shape == (1, 10)


def huffman_decoded(file):
    """Coefficients of a file with one interval a unit, bit by bit, in plain Python: units x 3 x 64."""
    head = op6_jpeg.parse(file)
    codes = {}
    for key, (counts, symbols) in head["huffman"].items():
        code, at = 0, 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                codes[key, size, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        assert code <= (1 << 17) - 2  # all ones is no code word
    out = []
    for a, b in zip(head["starts"].tolist(), [*head["starts"].tolist()[1:], len(head["data"])]):
        bits = "".join(f"{x:08b}" for x in head["data"][a:b].tolist())
        at, unit = 0, []

        def symbol(table):
            nonlocal at
            code = size = 0
            while (table, size, code) not in codes:
                code, size, at = code << 1 | int(bits[at]), size + 1, at + 1
            return codes[table, size, code]

        def extra(n):
            nonlocal at
            v = int(bits[at : at + n] or "0", 2)
            at += n
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(3):
            block = [extra(symbol(0))] + [0] * 63
            k = 1
            while k < 64:
                s = symbol(0x10)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = extra(s & 15)
                k += 1
            unit.append(block)
        assert len(bits) - at < 8 and set(bits[at:]) <= {"1"}
        out.append(unit)
    return np.array(out)


def test_files_against_a_plain_decoder():
    rng = np.random.default_rng(5)
    texts = [b"", words_of(200, 3).encode(), "é日本 \U0001f600".encode() * 30, b" " * 500 + b"x" + b" " * 300, bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), b"\xff" * 400, bytes(range(256))]
    payloads = [op6_jpeg.padded(t) for t in texts]
    files = op6_jpeg.encode_many(payloads)
    assert files == [op6_jpeg.encode(p) for p in payloads]
    for payload, file, (head, got) in zip(payloads, files, op6_jpeg.decode_many(files)):
        want = huffman_decoded(file)
        assert (got == want).all() and op6_jpeg.payload_of(head, want) == payload == op6_jpeg.payload_of(head, got)
    sizes = {n for n in range(16) if op6_jpeg.AC_TABLE[0][n]}
    assert len(sizes) > 6 and len(files[1]) < len(payloads[1]) * 1.2 + 400


def test_thumbnail_hash_looks_at_all_cells():
    rng = np.random.default_rng(1)
    strip = rng.integers(0, 255, 720)
    other = strip.copy()
    other[np.arange(720) % 10 != 0] = rng.integers(0, 255, 648)
    assert op6_jpeg.thumbnail_hash(strip) != op6_jpeg.thumbnail_hash(other)
    flat = np.add.reduceat(strip, np.arange(0, 720, 10)).reshape(8, 9)
    assert op6_jpeg.thumbnail_hash(strip) == np.packbits(flat[:, :-1] < flat[:, 1:]).tobytes().hex()
    assert op6_jpeg.thumbnail_hash(np.array([[7]])) == "0" * 16


def test_media_round_trip(spark, monkeypatch):
    monkeypatch.setattr(op6_jpeg, "LANES", 50)
    texts = ["", None, "a" * 192, "é" * 1000, words_of(2000, 4), "a" * 192]
    got = {r["doc_id"]: r for r in op6_jpeg.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        file = op6_jpeg.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[2]["feature"] == got[5]["feature"]
    wide = op6_jpeg.padded(b"q" * (192 * 8200))
    assert op6_jpeg.shape(len(wide) // 192) == (2, 4100)
    assert op6_jpeg.payload_of(*op6_jpeg.decode_many([op6_jpeg.encode(wide)])[0]) == wide
    with pytest.raises(ValueError):
        op6_jpeg.decode_many([b"\xff\xd8 no jpeg at all"])


# 7 ---------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_shingle_sets_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " ", "one", "one two\tthree four", words_of(5, 1), *["".join(rng.choice("ab \n\t") for _ in range(rng.randrange(400))) for _ in range(60)]]
    whole = op7_jaccard.shingle_sets(texts)
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    for piece in (1, 7, 50):
        monkeypatch.setattr(op7_jaccard, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, op7_jaccard.shingle_sets(texts)))


def near(text, edits, rng):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op7_jaccard, "SMALL", 6)
    monkeypatch.setattr(op7_jaccard, "BLOCK", 16)
    rng = random.Random(9)
    passage = words_of(60, 77, 5000)
    rows = [(i, words_of(rng.randrange(3, 150), i, 5000)) for i in range(80)]
    rows += [(100 + i, near(rows[i % 20][1], 1 + i % 3, rng)) for i in range(60)]
    hub = words_of(150, 500, 5000)
    rows += [(200 + i, near(hub, i % 4, rng)) for i in range(70)]
    rows += [(300 + i, words_of(40, 900 + i, 5000) + " " + passage) for i in range(60)]
    rows += [(400, "one two"), (401, "one two"), (402, "one  two\n"), (403, "one two three"), (404, ""), (405, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in op7_jaccard.query(docs).collect())
    assert got == brute_jaccard(rows)


def test_unsettled_large_buckets_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(op7_jaccard, "SMALL", 2)
    monkeypatch.setattr(op7_jaccard, "led_limit", lambda s: -1)
    rng = random.Random(1)
    hub = words_of(120, 3, 5000)
    rows = [(i, near(hub, 1, rng)) for i in range(25)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in op7_jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_jaccard(rows)


def test_pairs_that_share_a_frequent_passage_are_found(spark, monkeypatch):
    # leaders alone would join the crowds
    monkeypatch.setattr(op7_jaccard, "SMALL", 20)
    monkeypatch.setattr(op7_jaccard, "led_limit", lambda s: -1)
    rows = []
    for crowd in range(5):
        passage = words_of(156, -1 - crowd, 5000)
        for pair in range(40):
            own = words_of(8, 10_000 + len(rows), 5000)
            rows += [(len(rows) + k, f"{passage} {own} {words_of(20, 20_000 + len(rows) + k, 5000)}") for k in range(2)]
    assert {d: n for d, _, n in brute_jaccard(rows[:6])} == dict.fromkeys(range(6), 1)
    got = {r["doc_id"]: r["n_links"] for r in op7_jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(not n for n in got.values()) / len(rows) < 0.01


def test_runs_hold_the_target_on_pairs_drawn_anew():
    from itertools import islice

    for level in (2, 8):
        runs = op7_jaccard.runs_for(0.8, level)
        assert runs > 1 and list(islice(op7_jaccard.misses(0.8, level, 4000), runs))[-1] < 0.005
    rng = np.random.default_rng(99)
    one = rng.integers(0, 1 << 32, (2000, op7_jaccard.COORDINATES), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    met = np.zeros(2000, bool)
    for root in op7_jaccard.roots_of(0, op7_jaccard.runs_for(0.8)):
        ends = []
        for values in (one, two):
            row, paths = op7_jaccard.children(np.full(2000, root), values, 0.8)
            again, paths = op7_jaccard.children(paths, values[row], 0.8)
            ends.append(set(zip(row[again].tolist(), paths.tolist())))
        met[[r for r, _ in ends[0] & ends[1]]] = True
    assert met.mean() > 0.99


def test_crowds_beside_a_cloud_of_near_copies(spark, monkeypatch):
    # leaders, the triangle inequality and settled buckets at work: some sets are near the leader, some only near those
    monkeypatch.setattr(op7_jaccard, "SMALL", 8)
    monkeypatch.setattr(op7_jaccard, "FEW", 4)
    monkeypatch.setattr(op7_jaccard, "BLOCK", 16)
    rng = random.Random(12)
    cloud = [words_of(110, 71, 5000)]
    for i in range(70):
        cloud.append(near(cloud[max(0, i - rng.randrange(1, 6))], 1, rng))
    passage = " ".join(cloud[0].split()[:70])
    crowd = [f"{passage} {words_of(rng.randrange(5, 60), 400 + i // 2, 5000)}" for i in range(60)]
    rows = list(enumerate(cloud + crowd))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op7_jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: (c, n) for d, c, n in brute_jaccard(rows)}
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)


def test_forest_holds_what_is_alike_together():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 32, (4, op7_jaccard.COORDINATES), dtype=np.uint32)
    which = rng.integers(0, 4, 200)
    values = np.where(rng.random((200, op7_jaccard.COORDINATES)) < 0.93, centres[which], rng.integers(0, 1 << 32, (200, op7_jaccard.COORDINATES), dtype=np.uint32))
    marks = op7_jaccard.sketch(values).view(np.uint64)
    left, right = op7_jaccard.forest(marks, op7_jaccard.limit(0.8))
    assert len(left) == 200 - 4 and (which[left] == which[right]).all()
    a, b, c = marks[:60], marks[60:120], marks[120:180]
    assert (op7_jaccard.unlike(a, c) <= op7_jaccard.unlike(a, b) + op7_jaccard.unlike(b, c)).all()
    assert (op7_jaccard.unlike(a, b) == [(((x ^ y) >> np.arange(0, 64, 2, dtype=np.uint64)[:, None]) & np.uint64(3) != 0).sum() for x, y in zip(a, b)]).all()


def test_near_duplicate_stage_keeps_one_of_each_class(odd):
    kept = [r["doc_id"] for r in op7_jaccard.stage(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 9, 10, 11] and kept.count(None) == 1
    assert op7_jaccard.stage(odd).columns == odd.columns


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    one, two, three, four, five, six = (words_of(80, 40 + i, 5000) for i in range(6))
    # 1: a repeated row; 2: two texts, one of them a copy of 1; 3: two texts, one of them repeated and copied by 5; no ids; no shingles
    rows = [(1, one), (1, one), (2, one), (2, two), (3, three), (3, three), (3, four), (5, three + " end"), (None, five), (None, six), (4, ""), (4, None)]
    got = op7_jaccard.stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, one), (2, two), (3, three), (3, four), (None, five), (None, six), (4, ""), (4, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_duplicate_stage_takes_rows_without_an_id_as_documents(spark):
    rng = random.Random(2)
    one, two, three = (words_of(90, 60 + i, 5000) for i in range(3))
    rows = [(None, one), (None, one), (None, near(one, 1, rng)), (None, two), (4, near(two, 1, rng)), (None, three), (None, ""), (None, None), (None, ""), (9, words_of(50, 3, 5000))]
    got = op7_jaccard.stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    left = [r["text"] for r in got if r["doc_id"] is None]
    assert len(left) == 5 and three in left and two not in left and sum(not t for t in left) == 3
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [4, 9]


# stages on odd tables ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("module", [op4_langid, op7_jaccard, op3_pii, op10_mixing], ids=lambda m: m.__name__.split(".")[-1])
def test_stages_on_odd_and_empty_tables(module, odd, empty):
    run = getattr(module, "stage", None) or module.mixed_documents
    got = run(odd)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    if module is op3_pii:
        assert len(rows) == len(odd_rows())
    if module is op4_langid:
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 7, 10, 11, None}
    if module is op10_mixing:
        assert {r["doc_id"] for r in rows} <= {r[0] for r in odd_rows() if r[1] and r[1].strip()}
    assert run(empty).count() == 0 and run(empty).columns == empty.columns


# 9 ---------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_counts_against_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "c\n", " ", "#", "é", " ", "ab ab ab ", "\x1c", "\t"]) for _ in range(rng.randrange(80)))
        t = op9_quality.Text(text)
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_quality(text), repr(text)


def test_quality_verdict_does_not_depend_on_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = op9_quality.order(docs)
    a, b = (sorted(map(tuple, op9_quality.judge(docs, r).collect())) for r in (names, names[::-1]))
    assert a == b and sorted(names) == sorted(op9_quality.RULES)


def test_cascade_order_follows_what_reaches_a_rule():
    names = list(op9_quality.RULES)
    rejects, work = np.zeros((10, len(names)), bool), np.ones((10, len(names)), int)
    rejects[:6, 3] = rejects[:5, 0] = rejects[6:8, 1] = True  # rule 0 rejects only what rule 3 does
    work[:, 3] = 1
    got = op9_quality.best_order(rejects, work)
    assert got[:2] == [names[3], names[1]] and sorted(got) == sorted(names)
    work[:, 3] = 1000
    assert op9_quality.best_order(rejects, work)[:2] == [names[0], names[1]]
    assert op9_quality.best_order(rejects[:0], work[:0]) == names


def test_quality_against_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["- ", " * ", "• ", ""]) + words_of(6, i) for i in range(n)) for n in (9, 10, 30) for _ in range(6)]
    texts += ["\n".join("- " + words_of(6, i) for i in range(n)) for n in (9, 10, 12)] + ["STOP NOW! " * 3 + " ".join(f"GO{chr(65 + i % 26)}{chr(65 + i // 26)}!" for i in range(90)), "# " * 60 + words_of(60, 1), words_of(70, 2), "", None, "1 2 3 " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(con.sql(queries.OP9_SQL).fetchall()) == sorted(tuple(r) for r in op9_quality.query(docs).collect())
    assert op9_quality.order(docs) == op9_quality.order(docs)


# 10 --------------------------------------------------------------------------------------------------------------


def test_mixing_against_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.OP10_SQL).fetchall())
    got = sorted(tuple(r) for r in op10_mixing.query(docs).collect())
    assert [w[:3] + w[4:] for w in want] == [g[:3] + g[4:] for g in got]
    assert np.allclose([w[3] for w in want], [g[3] for g in got])


def test_mixing_tree_is_exact(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents, draws = op10_mixing.mix(docs, words_per_shard=5000)
    quota = {r["rank"]: r["quota"] for r in documents.select("rank", "quota").distinct().collect()}
    rows = draws.toPandas()
    assert rows.groupby("rank")["words"].sum().to_dict() == {k: v for k, v in quota.items() if v}
    assert not rows.duplicated(["key", "epoch"]).any() and rows["shard"].nunique() > 8
    assert (rows["words"] < rows["size"]).sum() <= len(quota)  # a source's last document


def test_splitting_tree_partitions_the_quotas(spark):
    quotas = {1: 4000, 2: 1, 3: 977, 4: 0, 5: 123_456}
    goals = spark.createDataFrame(list(quotas.items()), "rank long, blocks long")
    rows = op10_mixing.split(goals, 5).toPandas()
    per = (rows["high"] - rows["low"]).groupby(rows["shard"]).sum()
    assert len(per) == 32 and per.max() - per.min() <= 1
    for rank, own in rows.sort_values("low").groupby("rank"):
        assert own["low"].tolist() == [0, *own["high"].tolist()[:-1]] and own["high"].max() == quotas[rank]
        # as by chance: near the share of all
        assert ((own["high"] - own["low"] - quotas[rank] / 32).abs() < 6 * (quotas[rank] / 32) ** 0.5 + 3).all()
    assert set(rows["rank"]) == {1, 2, 3, 5}


@pytest.mark.parametrize(("colour", "drawn", "total"), [(5, 7, 12), (40, 30, 100), (300, 500, 1000), (3, 20_000, 50_000), (60_000, 100_000, 200_000)])
def test_draws_follow_the_hypergeometric_law(spark, colour, drawn, total):
    from math import lgamma

    n = 6000
    key = F.col("id")
    got = Counter(r[0] for r in spark.range(n).select(op10_mixing._drawn(F.lit(colour).cast("long"), F.lit(drawn).cast("long"), F.lit(total).cast("long"), F.lit("t"), key)).collect())
    log = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    low, high = max(0, drawn - (total - colour)), min(colour, drawn)
    law = np.exp([log(colour, k) + log(total - colour, drawn - k) - log(total, drawn) for k in range(low, high + 1)])
    assert min(got) >= low and max(got) <= high and abs(law.sum() - 1) < 1e-6
    # bins of twenty expected draws or more, then chi-square
    bins, have, want, square = 0, 0.0, 0.0, 0.0
    for k, p in zip(range(low, high + 1), law):
        have, want = have + got.get(k, 0), want + n * p
        if want >= 20:
            bins, square, have, want = bins + 1, square + (have - want) ** 2 / want, 0.0, 0.0
    assert square < bins + 5 * (2 * bins) ** 0.5 + 5


def test_mixing_splits_ids_that_many_rows_share(spark):
    rows = [(None, words_of(3 + i % 5, i), "a") for i in range(300)] + [(i, words_of(4, i), "b") for i in range(100)] + [(7, "x y z", "b")] * 120
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, source string"), "many")
    sized = op10_mixing.sizes(docs, "doc_id", rows_per_block=20).toPandas()
    assert sized.groupby(["source", "block", "part"]).size().max() < 60
    got = op10_mixing.query(docs)
    again = sorted(map(repr, got.collect()))
    assert again == sorted(map(repr, op10_mixing.query(docs).collect())) and len(again) == len(rows)
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(abs(r["n"] - r["target"]) < 1 for r in per)


def test_mixed_documents_hold_the_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = op10_mixing.mixed_documents(docs.withColumn("rank", F.lit("own")))
    count = F.sum(F.regexp_count("text", F.lit(op10_mixing.WORD)))
    want = op10_mixing.query(docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(count).first()[0] == want and mixed.columns == [*docs.columns, "rank"]
    # shards lie together, each in its own order
    draws = op10_mixing.mix(docs, words_per_shard=5000)[1].collect()
    once = {r["key"]: r["shard"] for r in draws}
    for r in draws:
        if r["epoch"]:
            once.pop(r["key"], None)  # may be in several shards
    order = [once[r["doc_id"]] for r in op10_mixing.mixed_documents(docs, words_per_shard=5000).collect() if r["doc_id"] in once]
    assert len(set(order)) > 4 and 1 + sum(a != b for a, b in zip(order, order[1:])) == len(set(order))
    twice = docs.limit(5).unionByName(docs.limit(5))
    assert op10_mixing.mixed_documents(twice).agg(count).first()[0] == op10_mixing.query(twice).agg(F.sum("taken")).first()[0]


# pipeline --------------------------------------------------------------------------------------------------------


def test_workers_let_the_tokenizer_go_when_other_tasks_come(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text").repartition(8)

    def held(ids):
        import gc

        return {"n": [sum(type(x).__name__ == "Ids" for x in gc.get_objects())] * len(ids)}

    def most():
        return max(r["n"] for r in map_rows(docs, ["doc_id"], held, StructType([StructField("n", LongType())])).collect())

    written(op5_packing.query(docs), "tokens")
    assert most() == 0
    one, two = (written(op5_packing.query(docs), "tokens").count() for _ in range(2))
    assert one == two == 64


def test_written_tables_send_bounded_batches_to_workers(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) AS text")  # 20 MB in one task
    got = written(docs.mapInArrow(run, "rows long, bytes long"), "batches").collect()
    assert sum(r["rows"] for r in got) == 200 and max(r["bytes"] for r in got) < 5 << 20
    # the session's own setting is as it was, and holds where there is one
    assert spark.conf.get(BATCH_CONF, None) is None
    spark.conf.set(BATCH_CONF, str(2 << 20))
    try:
        got = written(docs.mapInArrow(run, "rows long, bytes long"), "batches").collect()
        assert sum(r["rows"] for r in got) == 200 and max(r["bytes"] for r in got) < 3 << 20
        assert spark.conf.get(BATCH_CONF) == str(2 << 20)
    finally:
        spark.conf.unset(BATCH_CONF)


def test_pipeline_by_stages(spark, sf_dir):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs, written(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert docs.columns == first.columns
        if name == "language":
            assert docs.count() == last.count()  # all have letters
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept == {d for d, c, _ in brute_jaccard([(r["doc_id"], r["text"]) for r in last.collect()]) if d == c}
        if name == "personal_data":
            assert docs.count() == last.count()
            assert not [r for r in docs.collect() if op3_pii.base_spans(r["text"])]
    assert docs.count() > 0 and {"sequence_id", "offset"} <= set(docs.columns)
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert one == two
