import io
import zipfile

from pyspark.sql import functions as F

from lectern.options import CleaningOptions
from lectern.plans import engine
from lectern.sources import extract as X
from lectern.sources import routing as R
from lectern.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in files.items():
            z.writestr(n.replace("__S__", "/"), x)
    return out.getvalue()


def raw(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in files["names"].items():
            z.writestr(n, x)
    return out.getvalue()


DOCX = raw(names={"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hi </w:t><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
PPTX = raw(names={f"ppt/slides/slide{k}.xml": f'<s xmlns:a="x"><a:p><a:t>Slide text {k}</a:t></a:p></s>' for k in (1, 2, 10)})
XLSX = raw(
    names={
        "xl/workbook.xml": '<workbook xmlns:r="q"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>n</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>',
    }
)
ZIP = raw(names={"a.txt": "alpha", "__MACOSX/b.txt": "no", ".c.txt": "no", "d.png": "no", "sub/e.json": '{"k": 1}'})
MAIL = b"Subject: Hello\nFrom: a@b\nTo: c@d\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nBody text\n"

FILES = {
    "t.txt": (b"caf\xc3\xa9 au lait", True, "caf\xe9 au lait"),
    "l.txt": (b"caf\xe9 au lai", True, "caf\xe9 au lai"),
    "h.html": (b"<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>One</p></body></html>", True, "T\nmenu\nOne"),
    "c.csv": (b"a;b\n1;2\n3;4\n", True, "a b\n1 2\n3 4"),
    "j.json": (b'{"a": [1, 2]}', True, '{\n"a": [\n1,\n2\n]\n}'),
    "bad.json": (b"{", False, ""),
    "m.eml": (MAIL, True, "Subject: Hello\nFrom: a@b\nTo: c@d\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nBody text"),
    "d.docx": (DOCX, True, "Hi there\nTables:\na | b"),
    "p.pptx": (PPTX, True, "Slide 1:\nSlide text 1\nSlide 2:\nSlide text 2\nSlide 3:\nSlide text 10"),
    "x.xlsx": (XLSX, True, "Sheet: Data\nname n\nNaN 7"),
    "z.zip": (ZIP, True, '=== a.txt ===\nalpha\n=== sub/e.json ===\n{\n"k": 1\n}'),
    "bad.zip": (b"PK", False, ""),
    "b.bin": (b"readable", True, "readable"),
    "p.pdf": (b"%PDF", False, ""),
    "u.xyz": (b"?", False, ""),
}


def test_formats(spark, tmp_path):
    for n, (data, _, _) in FILES.items():
        (tmp_path / n).write_bytes(data)
    files = X.read_files(spark, str(tmp_path))
    got = {r["metadata"].get("filename") or r["source"].rpartition("/")[2]: r for r in X.extract(files, CleaningOptions()).collect()}
    for n, (_, ok, text) in FILES.items():
        assert (got[n]["success"], got[n]["text"]) == (ok, text), n
        assert bool(got[n]["error"]) != ok
    assert got["c.csv"]["metadata"]["delimiter"] == ";" and got["t.txt"]["metadata"]["file_size"] == "13"
    assert "Unsupported" in got["u.xyz"]["error"]


def test_equal_files_are_extracted_once_and_all_returned(spark):
    df = spark.createDataFrame([("s1", "a.txt", bytearray(b"x y")), ("s2", "a.txt", bytearray(b"x y")), ("s3", "a.txt", None)], "source string, filename string, content binary")
    got = {r["source"]: r["text"] for r in X.extract(df).collect()}
    assert got == {"s1": "x y", "s2": "x y", "s3": ""}


def test_plugin(spark):
    @X.register(".up")
    def upper(data, options):
        return data.decode().upper(), {}

    assert X.extracted_row(b"abc", ".up", CleaningOptions())["text"] == "ABC"
    del X.REGISTRY[".up"]


def test_fetching(spark):
    def fetch(url):
        if "fail" in url:
            raise OSError("no")
        return 200, "text/plain", url.encode()

    src = spark.createDataFrame([("http://a/x",), ("http://fail",), ("http://a/y.BIN",)], "source string")
    got = {r["source"]: r["status"] for r in X.fetched(src, fetch).collect()}
    assert got == {"http://a/x": 200, "http://fail": None}
    routes = {r["source"]: r["route"] for r in R.routed(X.fetched(src, fetch)).collect()}
    assert routes == {"http://a/x": "document", "http://fail": "failed"}


def test_routing(spark):
    rows = [(200, "application/json; charset=utf-8"), (200, "text/html"), (200, "text/csv"), (404, "text/html"), (None, None), (200, None), (200, "image/png")]
    df = spark.createDataFrame(rows, "s int, c string").coalesce(1)
    assert [r[0] for r in df.select(R.url_type(F.col("s"), F.col("c"))).collect()] == ["api", "web", "document", "error", "error", "unknown", "unknown"]
    names = [("https://a/b", None), ("https://a/b.pdf?x=1", None), ("https://a/", "application/pdf"), ("https://a", "image/png"), ("https://a/é#t", "x")]
    df = spark.createDataFrame(names, "u string, c string").coalesce(1)
    assert [r[0] for r in df.select(R.fetched_name(F.col("u"), F.col("c"))).collect()] == ["b.txt", "b.pdf", "document.pdf", "document.jpg", "é.txt"]
    df = spark.createDataFrame([("file:///a/b",), ("file:/a/b",), ("/a/b",)], "u string").coalesce(1)
    assert [r[0] for r in df.select(R.local_path(F.col("u"))).collect()] == ["/a/b"] * 3


def test_cache(spark):
    src = spark.createDataFrame([("https://a/b",), ("https://c",)], "source string").withColumn("cache_key", R.cache_key(F.col("source")))
    held = src.where("source = 'https://c'").withColumn("text", F.lit("t"))
    assert [r["source"] for r in R.uncached(src, held).collect()] == ["https://a/b"]
    assert [r["text"] for r in R.cached(src.select("cache_key"), held).collect()] == ["t"]
    assert R.cache_stats(src, held).first()["hit_rate"] == "50.00%"
    assert R.cache_stats(src.limit(0), held.limit(0)).first()["hit_rate"] == "0.00%"


def test_question_answering_from_files(spark):
    docs = spark.createDataFrame([("a.txt", "Paris is the capital of France. Berlin is in Germany."), ("b.txt", "Bananas are yellow.")], "source string, text string")
    q = spark.createDataFrame([(1, "What is the capital of France?")], "query_id long, query string")
    assert "Paris" in engine.ask(docs, q, "lexical").first()["answer"]
    assert "empty" in engine.ask(docs.limit(0), q).first()["answer"]


def test_stream(spark, tmp_path):
    rows = [(1, "one two three", "2024-01-01 00:00:00"), (2, "one two three", "2024-01-01 00:01:00"), (3, "four", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.unrepeated(ingest.arriving(spark, f"{tmp_path}/in", df.schema), "ts")
    ingest.append_to(ingest.chunk_stream(stream, "doc_id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["four", "one two three"]


def test_dispatch_with_cache(spark, tmp_path):
    from lectern.sources import dispatch as D

    bodies = {
        "http://h/w": (200, "text/html", b"<html><nav>n</nav><p>web text</p></html>"),
        "http://h/a": (200, "application/json", b'{"k": 1}'),
        "http://h/d.csv": (200, "text/csv", b"a,b\n1,2\n"),
        "http://h/u": (200, None, b"unknown kind"),
        "http://h/x": (404, "text/html", b""),
        "http://h/e": (200, "text/plain", b" "),
    }

    def fetch(url):
        return bodies[url]

    src = spark.createDataFrame([(u,) for u in [*bodies, "http://h/z.bin", "http://h/gone"]], "source string")
    done, entries = D.cached_parse(src, fetch)
    got = {r["source"][9:]: r for r in done.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"w": "success", "a": "success", "d.csv": "success", "u": "success", "x": "failed", "e": "failed", "z.bin": "failed", "gone": "failed"}
    assert got["w"]["text"] == "web text" and got["u"]["text"] == "unknown kind" and got["z.bin"]["error"] == "binary files are refused"
    D.save_entries(entries, f"{tmp_path}/cache")
    cache = spark.read.parquet(f"{tmp_path}/cache")
    again, more = D.cached_parse(src.where("source like '%/w'"), lambda u: 1 / 0, cache)
    assert [r["text"] for r in again.collect()] == ["web text"] and more.count() == 0
    assert D.clear_cache(spark, f"{tmp_path}/cache") and D.clear_expired(spark, "x") == 0


def test_pages(spark):
    from lectern.sources import dispatch as D

    good = "A page with a good many words, read well."
    rows = [("s", 2, good, "", 0.0), ("s", 1, "", "scanned words of page one", 0.0), ("s", 3, " ", None, 0.0), ("t", 1, good, "other", 0.0)]
    got = {r["source"]: r for r in D.assembled_pages(spark.createDataFrame(rows, "source string, page int, digital string, ocr string, area double")).collect()}
    assert got["s"]["text"] == f"scanned words of page one\n\n{good}" and got["s"]["ocr_used"] and not got["t"]["ocr_used"]


def test_long_texts_stay_whole(spark, tmp_path):
    """Texts of over 100,000 characters, the default bound of cleaning."""
    from lectern.queries import QUERIES

    words = [f"word{k:06d}" for k in range(20_000)]
    text = " ".join(words)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    page = f"<html><body><p>{text}</p></body></html>"
    spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seen = {w for r in QUERIES["streaming_chunks"](spark, str(tmp_path)).collect() for w in r["text"].split()}
    assert seen == set(words)
    for name in ("html_web_text", "html_file_text"):
        assert QUERIES[name](spark, str(tmp_path)).first()["text"].split() == words


_CUT = "<html><head><title>a&amp;&amp; b&amp</title></head><body><nav>n&lt</nav><p>x &lt;&lt y &ampz; &copy &amp;lt; &quot;q&quot &#x27;&nosuch; & z&amp</p></body></html>"


def _against_sql(spark, tmp_path, name):
    import duckdb

    from lectern.queries import ORACLE, QUERIES

    spark.createDataFrame([(1, "http://h/1", _CUT)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect()] == want.fetchall()


def test_file_text_with_cut_references(spark, tmp_path):
    _against_sql(spark, tmp_path, "html_file_text")
    assert X.page_text(_CUT, X.FILE_DROPPED, "|")[0].startswith("a&& b&|n<|x << y &z; \u00a9")  # as browsers read it


def test_web_text_with_cut_references(spark, tmp_path):
    _against_sql(spark, tmp_path, "html_web_text")


def test_title_with_cut_references(spark, tmp_path):
    _against_sql(spark, tmp_path, "html_title")
