import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforge.operators import prefix
from lexforge.sources import epub, files, importing, markup, pdf_pages, snapshot


def paragraphs(source):
    return [t for _, t in markup.paragraphs(markup.tree(source))]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>One</p><p>Two</p>", ["One", "Two"]),
        ("<div><p>a</p><p>b</p></div>", ["a", "b"]),
        ("<div>lead<p>a</p></div>", ["lead a"]),
        ("<p><span>D</span>rop cap</p>", ["Drop cap"]),
        ("<p>a<br/>b<hr>c</p>", ["a b c"]),
        ("<p>fish &amp; chips &nosuch; & &#233;</p>", ["fish & chips &nosuch; & é"]),
        ("<p>a<!-- <p>x</p> -->b</p>", ["ab"]),
        ("text outside<p>in</p>", ["in"]),
        ("<p>open <b>bold<p>next", ["open bold next"]),
        ("</div><p>stray</p></p>", ["stray"]),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes</p>", ["yes"]),
        ("<blockquote><p>q</p></blockquote><ul><li>l</li></ul>", ["q", "l"]),
        ("<p> \n </p><p>x  \n y</p>", ["x y"]),
        ("<P CLASS='a'>Upper</P>", ["Upper"]),
        ("<p>1 < 2</p>", ["1 < 2"]),
        ("<xhtml:p>prefixed</xhtml:p>", ["prefixed"]),
        ("", []),
    ],
)
def test_paragraphs(source, want):
    assert paragraphs(source) == want


def test_titles():
    assert markup.read_chapter("<head><title>T</title></head><h2>H</h2><p>x</p>") == (["H", "x"], "H", "T")


def test_deep_nesting_does_not_overflow():
    assert paragraphs("<div>" * 5000 + "<p>x</p>") == ["x"]


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>ab</p><p>cde</p>"), (2, "v", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in markup.page_paragraphs(pages).orderBy("block_idx").collect()] == [(1, 0, 0, 2, "ab"), (1, 1, 4, 7, "cde")]
    assert {r["page_id"]: r["title"] for r in markup.page_titles(pages).collect()} == {1: "u", 2: "v"}


CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
OPF = """<package><metadata><dc:title> </dc:title><dc:title>A Book</dc:title><dc:creator>Someone</dc:creator></metadata><manifest>
<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="c1" href="text/one%20two.xhtml"/><item id="c2" href="text/two.xhtml"/>
<item id="c3" href="text/empty.xhtml"/><item id="c4" href="text/missing.xhtml"/><item id="img" href="cover.jpg" properties="cover-image"/></manifest>
<spine><itemref idref="nav"/><itemref idref="c1"/><itemref idref="c3"/><itemref idref="c4"/><itemref idref="c2" linear="no"/></spine></package>"""
NAV = '<nav epub:type="landmarks"><a href="text/two.xhtml">No</a></nav><nav epub:type="toc"><ol><li><a href="text/one%20two.xhtml#x">One</a><ol><li><a href="text/two.xhtml">Two</a></li></ol></li></ol></nav>'


def make_epub(**more):
    out = io.BytesIO()
    parts = {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/nav.xhtml": NAV, "OEBPS/text/one two.xhtml": "<head><title>t</title></head><p>abc</p><p>de</p>", "OEBPS/text/two.xhtml": "<h1>Second</h1><p>x</p>", "OEBPS/text/empty.xhtml": "<p> </p>", "OEBPS/cover.jpg": b"\xff\xd8\xff"} | more
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_epub():
    book = epub.Book(make_epub())
    assert (book.package.title, book.package.author) == ("A Book", "Someone")
    assert list(book.chapters()) == [(1, "OEBPS/text/one two.xhtml", "One", ["abc", "de"]), (4, "OEBPS/text/two.xhtml", "Second", ["Second", "x"])]
    assert book.cover() == b"\xff\xd8\xff"
    with pytest.raises(epub.NotABook):
        epub.Book(b"no zip")


def test_hrefs():
    assert epub.resolve("a/b.opf", "../c%20d/./e.xhtml#f") == "c d/e.xhtml"
    assert epub.resolve("a/b.opf", "#f") == "a/b.opf"


def test_older_table_of_contents():
    ncx = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="t.xhtml#a"/></navPoint><navPoint><navLabel><text>Again</text></navLabel><content src="t.xhtml"/></navPoint></navMap></ncx>'
    assert epub.ncx_titles("x/toc.ncx", ncx) == {"x/t.xhtml": "One"}


def test_epub_files(spark, tmp_path):
    for name, data in (("a.epub", make_epub()), ("copy.EPUB", make_epub()), ("bad.epub", b"x"), ("no.txt", b"y")):
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path))
    assert found.count() == 3 and {r["format"] for r in found.collect()} == {"epub"}
    chapters = epub.read_epubs(found.select("path", "content"))
    assert chapters.where("error is not null").count() == 1
    books, ch, blocks = epub.library_rows(chapters)
    assert books.count() == 1 and [r["idx"] for r in ch.orderBy("idx").collect()] == [0, 1]
    assert [(r["char_start"], r["char_end"]) for r in blocks.where("idx = 0").orderBy("block_idx").collect()] == [(0, 3), (5, 7)]


def test_a_folder_becomes_a_library(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lib")
    folder.mkdir()
    other = make_epub(**{"OEBPS/text/two.xhtml": "<p>other</p>"})
    for name, data in (("a.epub", make_epub()), ("copy.EPUB", make_epub()), ("bad.epub", b"x"), ("Some_Notes.pdf", b"one|two goes|on here."), ("blank.pdf", b" ")):
        (folder / name).write_bytes(data)

    def extractor(content):
        return content.decode().split("|")

    name_of = lambda rows: {os.path.basename(r["path"]): r["outcome"] for r in rows.collect()}
    assert name_of(importing.import_folder(spark, str(folder), root, extractor)) == {"a.epub": "imported", "copy.EPUB": "already", "bad.epub": "failed", "Some_Notes.pdf": "imported", "blank.pdf": "failed"}
    library = snapshot.Library(spark, root)
    library.verify()
    books = {r["title"]: r["book_id"] for r in library.read("books").collect()}
    assert set(books) == {"A Book", "Some Notes"}
    rows = library.read("blocks").where(F.col("book_id") == books["Some Notes"]).orderBy("block_idx").collect()
    assert [r["text"] for r in rows] == ["one two goes on here."]
    texts = [r["text"] for r in library.read("blocks").where(F.col("book_id") == books["A Book"]).orderBy("block_id").collect()]
    assert texts == ["abc", "de", "Second", "x"] and library.read("chapters").count() == 3
    # Again: nothing new but a file that was added, and one whose content changed.
    (folder / "new.epub").write_bytes(other)
    (folder / "Some_Notes.pdf").write_bytes(b"changed")
    again = importing.import_folder(spark, str(folder), root, extractor)
    assert name_of(again) == {"a.epub": "already", "copy.EPUB": "already", "bad.epub": "failed", "Some_Notes.pdf": "conflict", "blank.pdf": "failed", "new.epub": "imported"}
    assert {r["outcome"]: r["n"] for r in importing.import_report(again).collect()} == {"already": 2, "failed": 2, "conflict": 1, "imported": 1}
    assert library.read("books").count() == 3 and library.read("books").select("book_id").distinct().count() == 3
    library.verify()
    (folder / "x.pdf").write_bytes(b"p")
    assert name_of(importing.import_folder(spark, str(folder), root))["x.pdf"] == "failed"


def test_folder_scan(tmp_path):
    for name in ("Nested/b.EPUB", "a.epub", "c.PDF", ".hidden/c.epub", "notes.txt"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path, tmp_path / "Nested" / "loop")
    os.symlink(tmp_path / "a.epub", tmp_path / "z.epub")
    os.symlink(tmp_path / "gone", tmp_path / "gone.epub")
    scan = files.find_books(str(tmp_path))
    assert [os.path.relpath(p, tmp_path) for p in scan.paths] == ["Nested/b.EPUB", "a.epub", "c.PDF"]
    assert [os.path.basename(p) for p in scan.unreadable] == ["gone.epub"]


def test_hash(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert files.file_hash(str(tmp_path / "x")).startswith("ba7816bf")


def test_covers(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xd8\xffx")), (3, bytearray(b"GIF"))], "book_id long, image binary")
    got = {r["book_id"]: r for r in files.cover_rows(rows).collect()}
    assert [got[k]["source"] for k in (1, 2, 3)] == ["none", "image", "unavailable"] and len(got[2]["key"]) == 12 and got[3]["thumb"] is None


# --- pages


@pytest.mark.parametrize(
    ("text", "line", "want"),
    [("", "a", "a"), ("gen-", "erosity", "generosity"), ("Attribution-", "NonCommercial", "Attribution-NonCommercial"), ("won ­", "Derful", "wonDerful"), ("1-", "a", "1- a"), ("end.", "Next", "end. Next")],
)
def test_joined_lines(text, line, want):
    assert pdf_pages.joined(text, line) == want


def test_page_paragraphs():
    assert pdf_pages.paragraphs_of(["a", "b", "", "c­", "", "d"]) == ["a b", "cd"]


def one_by_one(pages):
    """The paragraphs of pages in order; the first of a page goes on where the page before it ends in mid-sentence."""
    out = []
    for k, own in enumerate(pages):
        for i, text in enumerate(own):
            end = pages[k - 1][-1] if k and pages[k - 1] and not i else None
            if end and (end.endswith(pdf_pages.SOFT) or end[-1] not in '.?!:"”’)' and text[0].islower()):
                out[-1][1] = pdf_pages.joined(out[-1][1], text)
            else:
                out.append([k + 1, text])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("rows", [3, 100_000])
def test_paragraphs_go_on_across_pages(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix, "RANGE", rows)
    rnd = random.Random(4)
    words = ["goes", "On", "end.", "half-", "Ünder", "soft\u00ad", "ßa", "1", "say,", "stop!"]
    books = {
        1: [["one", "goes on"], ["and on"], ["here.", "New"]], 2: [["Ends."], ["lower"]], 3: [["a"], [], ["b"], ["c"]], 4: [[], ["x", "y"]], 5: [["a"]] + [["b"]] * 40 + [["C"]],
        6: [[" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))] for _ in range(200)],
    }
    lines = [(b, p, k, t) for b, pages in books.items() for p, own in enumerate(pages, 1) for k, t in enumerate(x for q in (own or [""]) for x in (q, ""))]
    frame = spark.createDataFrame(lines, "book_id long, page long, line_no long, line string")
    got = {}
    for r in pdf_pages.book_paragraphs(frame).orderBy("book_id", "page", "block_idx").collect():
        own = got.setdefault(r["book_id"], [])
        assert r["block_idx"] == sum(p == r["page"] for p, _ in own)
        own.append((r["page"], r["text"]))
    for b, pages in books.items():
        assert got[b] == one_by_one([pdf_pages.paragraphs_of([x for q in own for x in (q, "")]) for own in pages])


def page_lines(spark, pages):
    return spark.createDataFrame([(1, p, k, t) for p, ls in enumerate(pages, 1) for k, t in enumerate(ls)], "book_id long, page long, line_no long, line string")


def test_running_lines(spark):
    lines = page_lines(spark, [["Head 1", "text a", "1"], ["Head 2", "text b", "2"], ["", "Head 3", "text c", ""], ["Other", "d", "iv"]])
    out = pdf_pages.without_running_lines(lines)
    assert [r["line"] for r in out.orderBy("page", "line_no").collect()] == ["", "text a", "", "", "text b", "", "", "", "text c", "", "Other", "d", ""]
    assert [(r["running"], r["n"]) for r in pdf_pages.running_heads(lines).collect()] == [("Head", 3)]
    assert [r["text"] for r in pdf_pages.book_paragraphs(out).orderBy("page", "block_idx").collect()][0] == "text a text b text c"


def test_outlines(spark):
    outline = spark.createDataFrame([(1, 0, 1, "One", 3), (1, 1, 2, "sub", 4), (1, 2, 1, "Two a", 5), (1, 3, 1, "Two b", 5), (1, 4, 1, "far", 99)], "book_id long, ord int, level int, title string, page long")
    pages = spark.createDataFrame([(b, p) for b in (1, 2) for p in range(1, 46 if b == 2 else 9)], "book_id long, page long")
    got = pdf_pages.outline_spans(outline, pages)
    of = lambda b: [(r["title"], r["first_page"], r["last_page"]) for r in got.where(F.col("book_id") == b).orderBy("first_page").collect()]
    assert of(1) == [("Front matter", 1, 2), ("One", 3, 4), ("Two b", 5, 8)]
    assert of(2) == [("Pages 1–20", 1, 20), ("Pages 21–40", 21, 40), ("Pages 41–45", 41, 45)]
    text = spark.createDataFrame([(1, 1, 0, "x"), (1, 5, 0, "yy"), (1, 6, 0, "z")], "book_id long, page long, block_idx long, text string")
    rows = pdf_pages.assemble(text, got.where("book_id = 1"))
    assert [(r["idx"], r["title"], r["block_idx"], r["char_start"]) for r in rows.orderBy("idx", "block_idx").collect()] == [(0, "Front matter", 0, 0), (1, "Two b", 0, 0), (1, "Two b", 1, 4)]


def test_titles_of_page_books(spark):
    books = spark.createDataFrame([("Untitled", None, "Page Title", None, "my_file"), ("my_file", None, None, None, "my_file")], "info_title string, xmp_title string, page_title string, header_title string, stem string")
    assert [r["title"] for r in pdf_pages.book_titles(books).collect()] == ["Page Title", "my file"]
    big = [(24.0, c) for c in "A Test Book"] + [(10.0, c) for c in "body text goes on and on"]
    assert pdf_pages.title_run([big]) == (0, "A Test Book")
    assert pdf_pages.title_in_page("Buddhi s t Life", "x Buddhist\nLife y") == "Buddhist Life"


def test_scanned_and_failing_files(spark):
    pages = spark.createDataFrame([(1, 1, "x " * 20), (2, 1, "x" * 60)], "book_id long, page long, text string")
    assert [r["book_id"] for r in pdf_pages.scanned(pages).collect()] == [1]
    data = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b""))], "path string, content binary")

    def extract(raw):
        if not raw:
            raise ValueError("empty")
        return ["p1", "p2"]

    got = pdf_pages.extract_pages(data, extract).collect()
    assert sum(r["error"] is not None for r in got) == 1 and len(got) == 3


def test_a_page_is_folded_in_time_of_its_length():
    import time

    lines = [f"line {k} of a paragraph that goes on and on with-" if k % 2 else "more of it here" for k in range(20_000)]
    began = time.process_time()
    assert len(pdf_pages.paragraphs_of(lines)) == 1
    assert time.process_time() - began < 10


def test_pages_are_folded_once(spark, monkeypatch):
    tables = []
    keep = pdf_pages.written
    monkeypatch.setattr(pdf_pages, "written", lambda df, name: tables.append(name) or keep(df, name))
    rows = spark.createDataFrame([(1, p, k, t) for p in range(1, 6) for k, t in enumerate(["Head", f"begins on {p}", "and goes on", str(p)])], "book_id long, page long, line_no long, line string")
    out = pdf_pages.book_paragraphs(pdf_pages.without_running_lines(rows))
    assert {"edges", "pages", "numbered", "told"} <= set(tables)
    assert [(r["page"], r["text"]) for r in out.orderBy("page", "block_idx").collect()] == [(1, "begins on 1 and goes on begins on 2 and goes on begins on 3 and goes on begins on 4 and goes on begins on 5 and goes on")]


def test_pages_are_read_a_few_at_a_time(spark, monkeypatch):
    from lexforge.functions import words

    html = "<html><head><title>T{0}</title></head><body><p>" + "word " * 200 + "</p></body></html>"
    rows = spark.createDataFrame([(i, html.format(i), "u") for i in range(40)] + [(40, None, "v")], "page_id long, html string, url string")
    monkeypatch.setattr(markup, "AT_ONCE", 3000)
    got = {r["page_id"]: r["title"] for r in markup.page_titles(rows).collect()}
    assert got == {i: f"T{i}" for i in range(40)} | {40: "v"}
    batch = rows.where("page_id < 40").toArrow().combine_chunks().to_batches()[0]
    assert len(list(words.slices(iter([batch]), "html", 3000))) == 20
