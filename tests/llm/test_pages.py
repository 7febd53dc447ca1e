import base64
import gzip
import hashlib
import html as h
import re

from lectern.llm import html_extract, warc
from lectern.llm._common import scratch_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    bodies = ["<p>a</p>", FAKE, "<p>a</p>", None, "", "x" * 200_000 + FAKE + FAKE, FAKE + "tail", "<p>a</p>", "é\r\n\r\n\n"]
    rows = [(k, f"http://x/{k}\n" if k else None, b, "e") for k, b in enumerate(bodies)] + [(None, "u", "<p>a</p>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size string").repartition(3)
    path = scratch_path(spark, "w")
    warc.write_archives(df, path, records_per_file=4)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    first = {}
    for k, b in enumerate(bodies):
        first.setdefault(b or "", k)
    for k, _, b, _ in rows:
        r = got[None if k is None else str(k)]
        assert r["payload_bytes"] == len((b or "").encode()) and r["payload_digest"] == sha(b)
        own = k == first[b or ""]
        assert r["record_type"] == ("response" if own else "revisit")
        assert r["refers_to"] == (None if own else str(first[b or ""]))


def test_small_payloads_may_all_be_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 50), (4, "u", "a" * 50)], "page_id long, url string, html string")
    path = scratch_path(spark, "w")
    warc.write_archives(df, path, min_revisit_bytes=10)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table(spark):
    path = scratch_path(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_headers():
    assert warc.header_of(FAKE[7:].encode()) == ({"warc-type": "response", "warc-record-id": "<urn:page:99>", "content-length": "3"}, len(FAKE) - 14)
    assert warc.header_of(b"0\r\nContent-Length: 5") == ({"content-length": "5"}, 24)
    for bad in (b"", b"2\r\nContent-Length: 5", b"0\r\nContent-Length: x\r\n\r\n", b"0\r\nno colon\r\nContent-Length: 5\r\n\r\n", b"0\r\n\r\n"):
        assert warc.header_of(bad) is None


def record(page, body, kind="response", length=None, more=""):
    size = len(body.encode()) if length is None else length
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\n{more}Content-Length: {size}\r\n\r\n{body}\r\n\r\n"


NASTY = [
    "plain", "", "\r\n", "\r\n\r\n", "x\r\n\r\nWARC/1.", "WARC/1.0\r\n", "\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n",
    FAKE * 3, "y" * 5000 + "\r\n\r\n" + FAKE * 40 + "z" * 3000, FAKE, "tail\r\n\r\n" + FAKE, "é" * 800, "\r\n\r\n" + record(98, "w" * 9000, length=20_000),
]


def test_archives_are_read_in_parts(spark, tmp_path):
    """Plain archives of many parts, with payloads that hold records and cuts, also across parts."""
    bodies = NASTY * 2
    (tmp_path / "a.warc").write_bytes("".join(record(k, b, more="WARC-Target-URI: http://x/WARC/1.0\r\n") for k, b in enumerate(bodies)).encode())
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write("".join(record(1000 + k, b) for k, b in enumerate(bodies)).encode())
    want = {str(n + k): (len(b.encode()), sha(b)) for n in (0, 1000) for k, b in enumerate(bodies)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = warc.read_archives(spark, str(tmp_path)).collect()
            assert len(got) == len(want) and all(r["error"] is None for r in got)
            assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_damaged_archives(spark, tmp_path):
    good = [record(k, f"body {k} " * 30) for k in range(12)]
    broken = [*good[:3], record(3, "body " * 30, length=77), *good[4:8], record(8, "b" * 50, length=999_999), *good[9:]]
    (tmp_path / "a.warc").write_text("".join(broken), newline="")
    (tmp_path / "b.warc").write_text("junk before" + "".join(good[:2]).replace("page:", "page:b"), newline="")
    (tmp_path / "c.warc").write_text(record("c0", "whole") + record("c1", "cut off")[:-9], newline="")
    (tmp_path / "d.warc").write_text(record("d0", "typeless").replace("WARC-Type: response\r\n", "") + record("d1", "", "revisit", more="WARC-Refers-To: <urn:page:gone>\r\n"), newline="")
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert set(got) == {*map(str, range(12)), "b1", "c0", "c1", "d0", "d1"}
    assert {k for k, r in got.items() if r["error"]} == {"3", "8", "c1", "d1"}
    assert got["d0"]["record_type"] is None and got["d0"]["payload_digest"] == sha("typeless")
    assert all(got[str(k)]["payload_digest"] == sha(f"body {k} " * 30) for k in range(12) if k not in (3, 8))


def test_every_page_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))
        want[r["page_id"]] = " ".join(h.unescape(body).split())
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice"><p>We use cookies, many of them, and ask you to agree to all of them now.</p></div>
<div id="main"><h1>Head</h1><p>One, two, three and <a href=y>four</a> words&nbsp;&amp; more<p>Second&#33; para<br>graph
<form><p>Your mail, please</p></form><ul><li>item one<li>item two</ul><script>"<p>no</p>"</script>
<div class="comments"><p>First comment, long, long, long, long, long, long, long, long.</p></div></div>
<aside><p>Side, side, side</p></aside><footer>Foot</footer></body></html>"""


def test_a_page_without_article():
    assert html_extract.extract(PAGE) == "Head One, two, three and four words & more Second! para graph item one item two"


PROSE = "This paragraph tells, at some length, what there is to say about the matter, and it goes on, as such texts do. " * 3


def test_siblings_of_the_container_stay():
    page = f"<body><nav>Menu</nav><h1>Title</h1><p>Short lead.</p><div><p>{PROSE}</p><p>{PROSE}</p></div><h2>More</h2><p>End note.</p><div class=footer>F</div></body>"
    prose = PROSE.strip()
    assert html_extract.extract(page) == f"Title Short lead. {prose} {prose} More End note."


def test_link_lists_inside_an_article_stay_and_menus_go():
    refs = "<ul>" + "".join(f'<li><a href=r{k}>Source {k}</a>' for k in range(9)) + "</ul>"
    want = PROSE.strip() + " " + " ".join(f"Source {k}" for k in range(9))
    for tag in ("article", "main"):
        assert html_extract.extract(f"<body>{refs}<{tag}><div><p>{PROSE}</p></div>{refs}</{tag}></body>") == want
    assert html_extract.extract(f"<body>{refs}<div><p>{PROSE}</p></div></body>") == PROSE.strip()
    long_refs = "<ol><li><a href=a>Author, A long title of a work that the text relies on, 1999</a></ol>"
    assert html_extract.extract(f"<body><div><p>{PROSE}</p>{long_refs}</div></body>").endswith("relies on, 1999")


def test_parts_of_an_article():
    page = f"<main><h1>T</h1><article><header><p>By line</p></header><section><p>{PROSE}</p></section><section><p>b</p></section><div class='share'>x</div></article><div>other</div></main>"
    assert html_extract.extract(page) == f"T By line {PROSE.strip()} b"


def test_attributes_are_told_apart():
    page = f'<body><div data-id="share" title="a class=menu"><p>{PROSE}</p></div><div id=footnote>Note.</div></body>'
    assert html_extract.extract(page) == PROSE.strip() + " Note."
    assert html_extract.extract(f'<div class="content has-sidebar"><p>{PROSE}</p></div><div class="left sidebar">x</div>') == PROSE.strip()


def test_unicode_white_space():
    assert html_extract.extract("<p>a\u2003b\u3000\u2028c&nbsp;&#8195;d\x85e\u200bf</p>") == "a b c d e\u200bf"


def test_characters_that_are_no_markup():
    assert html_extract.extract("<p>1 < 2 and 3<4, a <- b & c</p><!-- x > y --><p>d<![CDATA[x]]>e</p><p title='>'>f</p>") == "1 < 2 and 3<4, a <- b & c de f"
    assert html_extract.extract('<p>a</p><p title="never closed>b</p><p>c</p>') == "a b c"
    assert html_extract.extract("<p>a</p><p>b <a href=") == "a b"


def test_hostile_markup_takes_linear_time():
    import time

    n = 100_000
    pages = ["<a " * n, "<a '" * n, '<a ="' * n, "<span>" * n + "</b>" * n, "<span>" * n + "<div></div>" * n, "<li><ul>" + "<blockquote>" * n + "<li></li>" * n]
    pages += ["<script>" + "</script " * n, "<div>" * n + "<header></header>" * n, "<!--" * n, "<p><span>" * n + "<li>" * n, "<table><tr><td>" * n, "</p>" * n, "<" * n]
    for page in pages:
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 8


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "t", 5, "k")], "page_id long, url string, html string, text string, n_chars long, _h string")
    assert html_extract.main_text(df).collect()[0].asDict() == {"page_id": 1, "url": "u", "text": "a", "n_chars": 1}


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", ""), (3, "u", "<p>cut off"), (4, "u", "no markup"), (5, "u", "<nav>x</nav>")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_extract.main_text(df).collect())
    assert got == [(1, ""), (1, ""), (2, ""), (3, "cut off"), (4, "no markup"), (5, "")]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_deep_nesting_is_no_recursion():
    assert html_extract.extract("<div>" * 20_000 + "<p>deep text</p>" + "</div>" * 20_000) == "deep text"
