import hashlib
import itertools
import random
import time

import duckdb
import pytest
from odd import counted

from promptloom.llm import html_layout as L
from promptloom.llm import warc_fixity as X
from promptloom.llm.queries import op5_warc_fixity

CASES = [
    ("<ul><li>a<li>b<ol start=3><li>c<li>d <b>x</b></ol><li>e</ul>tail", "- a\n- b\n  3. c\n  4. d x\n- e\n\ntail"),
    ("<p>one<p>two<br>three<div>four</div>five", "one\n\ntwo\nthree\n\nfour\nfive"),
    ("<table><tr><th>Name<th>Value<tr><td>a<td>100<tr><td>long name<td>x<br>y</table>z", "Name       Value\na          100\nlong name  x\n           y\n\nz"),
    ("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td>c</td></tr><tr><td colspan=2>wide one</td></tr></table>", "a  b\nc\nwide one"),
    ("<table><tfoot><tr><td>f</table>", "f"),
    ("x<script>if (a < b) p('</p>')</script><style>p{}</style><noscript>n</noscript><template>t</template>y", "xy"),
    ("<div style='color:red; display : none'>no</div><p hidden>no</p><span style=\"visibility:hidden\">no</span>yes", "yes"),
    ("<head><title>T &amp; U</title></head><body>b</body>", "b"),
    ("a &lt;b&gt; &eacute;&#233;&nbsp;c", "a <b> éé\xa0c"),
    ("<pre> a\n\n  b\tc\n</pre>d", " a\n\n  b     c\n\nd"),
    ("a <b> b </b> c", "a b c"), ("a<!-- <p>x</p> -->b", "ab"), ("1 < 2 and 3>2", "1 < 2 and 3>2"), ("<p>a</b></i>b</p></div>c", "ab\n\nc"),
    ("<dl><dt>T<dd>D<dd>E</dl>", "T\n  D\n  E"), ("<blockquote><p>q</p></blockquote>r", "  q\n\nr"), ("<img alt='pic' src=x> y<input type=hidden value=v><input type=submit value=Go>", "pic yGo"),
    # the chosen option of a control is on the page
    ("<select><option>a<option>b</select>z", "az"), ("<select><option>a<option selected>b</select>z", "bz"), ("<select multiple><option>a<option>b</select>", "a\nb"),
    ("x <textarea>\na  <b>\n c</textarea>", "x a  <b>\n c"), ("a <math><mi>x</mi><annotation>no</annotation></math> b", "a x b"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>yes</text></svg>", "yes"), ("<map><p>in</p><area></map>out", "in\n\nout"),
    ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<style>/* .x{} */ .gone, p#off { display : none } @media print { b { display: none } } @media screen { i { visibility: hidden } }</style><b>b</b><i>no</i><p id=off>no</p><div class='a gone'>no</div><u class=gone style='display:inline'>u</u>", "bu"),
    ("<style>.x{display:none} .x.y{display:block}</style><div class='x'>no</div><div class='y x'>yes</div>", "yes"),
    ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"), ("<table><tr>loose<td>A</td></tr><tbody><div>div</div><tr><td>B</table>", "loose\ndiv\n\nA\nB"),
    ("<table><tr><table><tr><td>in</table><td>out</table>", "in\n\nout"), ("<table><tr><td colspan=100>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
    ("<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"), ("a<b c='x", "a"), ("<a b=\"1\"c='2'd=3 / e>t</a>", "t"), ("a<hr>b", "a\n\nb"), ("", ""), ("   ", ""), ("<", "<"), ("<a href='x>y'>t</a>", "t"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert L.render(page)[1] == text


def test_title_and_deep_and_broken_pages():
    assert L.render("<title> a\n b </title>x") == ("a b", "x")
    assert L.render("<div>" * 3000 + "deep" + "</div>" * 3000)[1] == "deep"
    assert "end" in L.render("<table><tr><td>" * 200 + "end")[1]
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "<td>", "<tr>", "</table>", "<li>", "<ul>", "</ul>", "word ", "<!--", "-->", "<b", ">", "<script>", "</script>", "&amp", "<pre>", "\n", "</div>"]
    for _ in range(300):
        L.render("".join(rng.choice(bits) for _ in range(60)))


def test_no_visible_word_is_lost():
    rng = random.Random(2)
    for _ in range(100):
        words = [f"w{i}" for i in range(30)]
        page = "".join(rng.choice(["<p>", "<li>", "<div>", "<td>", "<b>", "</b>", "<table><tr><td>", "</table>", "<ul>", "</ul>", " "]) + w + " " for w in words)
        assert sorted(L.render(page)[1].replace("- ", " ").split()) == sorted(words)


def tree(rng, depth, out, seen):
    """A page part with optional tags left out at will; visible words are added to ``out`` in the order of the text."""

    def word():
        w = f"w{rng.randrange(10**9)}"
        if seen == "seen":
            out.append(w)
        return f" {w} "

    def inner(n=3, s=None):
        return "".join(tree(rng, depth - 1, out, seen if s is None else s) for _ in range(rng.randrange(1, n)))

    maybe = lambda tag: rng.choice(["", tag])
    kind = rng.choice("word word inline block list table hidden unseen seen raw control loose".split()) if depth > 0 else "word"
    if kind == "word":
        return word()
    if kind == "inline":
        return f"<b>{inner()}</b>"
    if kind == "block":
        tag = rng.choice(["div", "section", "blockquote", "article"])
        return f"<{tag}>{inner()}</{tag}>"
    if kind == "list":
        return "<ul>" + "".join(f"<li>{inner()}{maybe('</li>')}" for _ in range(rng.randrange(1, 4))) + "</ul>"
    if kind in ("table", "loose"):
        between = lambda: f"<i>{word()}</i>" if kind == "loose" and rng.random() < 0.4 else ""
        rows = "".join(f"<tr>{between()}" + "".join(f"<td>{inner(2)}{maybe('</td>')}" for _ in range(rng.randrange(1, 4))) + maybe("</tr>") for _ in range(rng.randrange(1, 4)))
        return f"<table>{maybe('<tbody>')}{rows}</table>"
    if kind == "hidden":
        return f"<div {rng.choice(['hidden', 'style=display:none', 'class=gone'])}>{inner(s='gone')}<b style='visibility:visible'>no</b></div>"
    if kind == "unseen":
        return f"<div style='visibility:hidden'>{inner(s='gone' if seen == 'gone' else 'unseen')}</div>"
    if kind == "seen":
        return f"<div style='visibility:visible'>{inner(s='gone' if seen == 'gone' else 'seen')}</div>"
    if kind == "raw":
        return rng.choice(["<script>if (a<b) x('</div>')</script>", "<!-- <p>no</p> -->", "<template><td>no</template>", "<style>.other{}</style>"])
    return f"<select><option>{word()}<option>no</select><textarea>{word()}</textarea>"


def test_generated_trees_against_the_words_they_show():
    rng = random.Random(12)
    for _ in range(400):
        out = []
        page = "<style>.gone{display:none}</style>" + "".join(tree(rng, 4, out, "seen") for _ in range(4))
        got = L.render(page)[1]
        words = [w for line in got.split("\n") for w in line.split() if w != "-"]
        assert sorted(words) == sorted(out), page
        if "<table" not in page:  # cells stand side by side
            assert words == out


@pytest.mark.parametrize("bit", ["<a '", "<b ", "<td>", "<td>x", "<style></style ", "<!--", "</", "<a b=\"", "<tr><td rowspan=9>x", "<td colspan=1000>x", "<table><tr><td>x", "<i>x", "<li>x", "<p style='color:red'>x", "&amp", "<select><option>x", "<table>x", "<![CDATA["])
def test_long_hostile_pages(bit):
    began = time.process_time()
    L.render(bit * (1_000_000 // len(bit)))
    assert time.process_time() - began < 8


@pytest.mark.parametrize("bit", ["<tr><td rowspan=60000>x<td>y</tr>", "<tr><td rowspan=9000 colspan=3>x<td rowspan=70>y<td>z</tr>", "<td>a<br>b"])
def test_long_hostile_tables(bit):
    began = time.process_time()
    L.render("<table>" + bit * (1_000_000 // len(bit)))
    assert time.process_time() - began < 8


def test_held_columns_equal_a_grid():
    rng = random.Random(5)
    for _ in range(300):
        held, until = L._Held(), {}
        for y in range(rng.randrange(1, 30)):
            held.release(y)
            x = 0
            for _ in range(rng.randrange(5)):
                x = held.free_from(x)
                want = next(c for c in itertools.count(0) if c >= x and until.get(c, 0) <= y)
                assert x == want
                wide, high = rng.choice((1, 1, 2, 7)), rng.choice((1, 2, 3, 9))
                if high > 1:
                    held.take(x, x + wide, y + high)
                    for c in range(x, x + wide):
                        until[c] = max(until.get(c, 0), y + high)
                x += wide
                assert all((held.free_from(c) == c) == (until.get(c, 0) <= y) for c in range(x, x + 40))


def test_no_more_than_a_thousand_blanks_align_a_cell():
    text = L.render(f"<table><tr><td>{'w' * 3000}<td>a<tr><td>b<td>c<td>d</table>")[1]
    assert text == f"{'w' * 3000}  a\nb{' ' * 1000}c  d"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record string, slot int, text string, title string")


ODD = [(0, "u", "<p>a", "r", 1, "t", "t"), (1, None, None, "r", 1, "t", "t"), (1, None, None, "r", 1, "t", "t"), (None, "v", "<b>x</b>", None, None, None, None), (2, "", "", None, None, None, None), (-5, "n", "neg", None, None, None, None), (5000, "far", "é" * 100000, None, None, None, None)]


def test_odd_pages(spark):
    rows = L.extract(pages(spark, ODD)).collect()
    assert counted((r["page_id"], r["text"]) for r in rows) == counted((r[0], L.render(r[2])[1]) for r in ODD)
    assert L.extract(pages(spark, ODD).limit(0)).count() == 0


def record(key, url, body):
    body = body or ""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if key is None else key}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}"


def test_audit_against_brute_force(spark):
    rng = random.Random(6)
    one = [(i, f"u{i}", f"body {i} é") for i in range(0, 9000, 3)]
    other = [(k, u, b + "!" if rng.random() < 0.01 else b) for k, u, b in one if rng.random() > 0.005] + [(8192 + 1, "new", "added")]
    wanted = {}
    a, b = ({k: record(k, u, h) for k, u, h in side} for side in (one, other))
    for k in a.keys() | b.keys():
        if a.get(k) != b.get(k):
            wanted[k] = "lost" if k not in b else "added" if k not in a else "altered"
    starts, at = {}, {}
    for k in sorted(a):
        starts[k] = at.get(k // 4096, 0)
        at[k // 4096] = starts[k] + len(a[k].encode()) + 4
    make = lambda rows: X.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = X.audit(make(one), make(other)).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        if r["verdict"] != "added":
            k = r["page_id"]
            assert r["start_offset"] == starts[k] and r["end_offset"] == starts[k] + len(a[k].encode()) + 4
            assert r["primary_sha256"] == hashlib.sha256(a[k].encode()).hexdigest()
    assert X.audit(make(one), make(one)).count() == 0
    assert X.audit(make(one[:9]), make(one[:0])).count() == 9 == X.audit(make(one[:0]), make(one[:9])).count()


def test_audit_odd_rows(spark):
    whole = X.records(pages(spark, ODD))
    assert X.audit(whole, X.records(pages(spark, ODD[::-1]))).count() == 0
    less = X.audit(whole, X.records(pages(spark, ODD[:1] + ODD[2:]))).collect()  # one of two equal rows is lost
    assert [(r["page_id"], r["verdict"]) for r in less] == [(1, "altered")]


def test_archives_are_warc_files(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}\r\n\r\nWARC/1.1\r\n é") for i in range(5000, 5020)] + [(3, "", "")]
    made = X.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    X.write_archives(made, str(tmp_path / "w"))
    back = X.read_archives(spark, str(tmp_path / "w"))
    assert X.audit(made, back).count() == 0 and back.count() == 21
    part = next((tmp_path / "w" / "archive=1").glob("part-*"))
    data = part.read_bytes()
    part.write_bytes(data.replace(b"<p>5007", b"<p>5oo7"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    found = X.audit(made, X.read_archives(spark, str(tmp_path / "w"))).collect()
    assert [(r["page_id"], r["verdict"]) for r in found] == [(5007, "altered")]
    assert data[found[0]["start_offset"] : found[0]["end_offset"]].startswith(b"WARC/1.1") and b"<p>5007" in data[found[0]["start_offset"] : found[0]["end_offset"]]


def test_audit_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    want = db.sql(X.AUDIT_SQL)
    got = op5_warc_fixity(spark, folder)
    assert counted(got.select(*want.columns).collect()) == counted(want.fetchall())


def rewritten(folder, archive, change):
    part = next((folder / f"archive={archive}").glob("part-*"))
    part.write_bytes(change(part.read_bytes()))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)


def test_records_that_changed_places_are_found(spark, tmp_path):
    made = X.records(spark.createDataFrame([(i, f"u{i}", "b" * (i - 90)) for i in range(100, 120)], "page_id long, url string, html string"))
    X.write_archives(made, str(tmp_path / "w"))
    back = lambda: X.read_archives(spark, str(tmp_path / "w"))
    roots = lambda rows: [tuple(r) for r in X.roots(rows).collect()]
    whole = roots(back())
    assert whole == roots(made)

    def swap(data):
        parts = data.split(b"\r\n\r\nWARC/1.1")
        parts[5], parts[9] = parts[9], parts[5]
        return b"\r\n\r\nWARC/1.1".join(parts)

    rewritten(tmp_path / "w", 0, swap)
    found = X.audit(made, back()).collect()
    assert counted((r["page_id"], r["verdict"]) for r in found) == counted([(105, "moved"), (109, "moved")])
    assert roots(back())[0][0] == 0 and roots(back())[0][1] != whole[0][1]
    # a lost record alone moves nothing
    rewritten(tmp_path / "w", 0, lambda d: swap(d).replace(record(103, "u103", "b" * 13).encode() + b"\r\n\r\n", b""))
    assert [(r["page_id"], r["verdict"]) for r in X.audit(made, back()).collect()] == [(103, "lost")]


def test_damage_in_bytes_that_are_not_text_is_found(spark, tmp_path):
    made = X.records(spark.createDataFrame([(i, "u", "picture: ??") for i in range(5)], "page_id long, url string, html string"))
    for name, end in (("a", b"\xff\xfe"), ("b", b"\xff\xfd")):
        X.write_archives(made, str(tmp_path / name))
        rewritten(tmp_path / name, 0, lambda d, end=end: d.replace(b"??", b"\xff\xfe", 4).replace(b"??", end))
    one, other = (X.read_archives(spark, str(tmp_path / n)) for n in "ab")
    assert [(r["page_id"], r["verdict"]) for r in X.audit(one, other).collect()] == [(4, "altered")]
