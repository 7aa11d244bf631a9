import io
import sys
import threading
import time
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmark import cli, scratch
from leafmark.plans.inputs import CLEAN
from leafmark.plans.run import Extraction, extract_files, run_folder
from leafmark.sources import adapters, discover, html, ocr
from leafmark.streaming import extract as stream


def epub(chapters):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters) + 1))
        z.writestr("o/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="s" href="s.css" media-type="text/css"/></manifest></package>')
        for i, c in enumerate(chapters):
            z.writestr(f"o/c{i}.xhtml", c)
    return b.getvalue()


def test_html():
    page = "<html><nav>menu</nav><script>var a='</p>';</script><p><b>x</b> y &amp; z</p><!-- c --><style>q</style>  t  </html>"
    assert html.text_lines(page) == "x\ny & z\nt"
    assert html.text_lines(None) == ""


def test_epub_numbers_count_unreadable_items(spark):
    rows = list(adapters.read_epub(epub(["<p>one</p>", "<p>two</p>"])))
    assert [(n, t) for n, t, _ in rows] == [(1, "one"), (2, "two"), (3, None)] and "KeyError" in rows[2][2]
    df = spark.createDataFrame([("a.epub", "epub", bytearray(b"no zip")), ("b.pdf", "pdf", bytearray(b"x"))], "file string, kind string, content binary")
    got = {r.file: r.error for r in adapters.read_files(df).collect()}
    assert got["a.epub"].startswith("EPUB read failed: ") and got["b.pdf"].startswith("Failed to open PDF: ")


def test_folder_run(spark, tmp_path):
    def read_stub(content):  # local, so that workers get it by value
        for i, page in enumerate(content.decode().split("\f"), 1):
            yield i, page, None

    src = tmp_path / "in"
    src.mkdir()
    (src / "Good Book.pdf").write_bytes(f"{CLEAN * 12}\f{CLEAN * 12}".encode())
    (src / "scan.PDF").write_bytes(b"\f")
    (src / "bad.epub").write_bytes(b"no")
    (src / "tale.epub").write_bytes(epub([f"<p>{CLEAN}</p>", "<p>short</p>"]))
    (src / "notes.txt").write_text("x")
    ocr = lambda file, n: CLEAN * 12 if n == 1 else 1 / 0
    readers = {"pdf": read_stub, "epub": adapters.read_epub}
    res = {r.file: r for r in run_folder(spark, str(src), str(tmp_path / "out"), readers=readers, ocr=ocr).collect()}
    assert set(res) == {"Good Book.pdf", "scan.PDF", "bad.epub", "tale.epub"}
    assert res["Good Book.pdf"].pages_via_text == 2 and res["scan.PDF"].pages_via_ocr == 1 and res["scan.PDF"].ocr_errors == ["p2: ZeroDivisionError: division by zero"]
    assert res["bad.epub"].issues and res["tale.epub"].pages_extracted == 1 and res["tale.epub"].avg_score == 0
    assert (tmp_path / "out/good-book.md").read_text().startswith("# Good Book\n\n> Source: `Good Book.pdf`\n> Pages extracted: 2 (text: 2, OCR: 0) | Pages skipped: 0\n")
    report = (tmp_path / "out/_QC_REPORT.md").read_text()
    assert "FAILED" in report and "- p2: ZeroDivisionError" in report
    again = {r.file: r.skipped_existing for r in run_folder(spark, str(src), str(tmp_path / "out"), readers=readers, ocr=ocr).collect()}
    assert again["Good Book.pdf"] and not again["tale.epub"]


def test_discovery(spark):
    items = spark.createDataFrame([(0, 1, "b.pdf"), (0, 0, "a.PDF"), (1, 0, "b.pdf"), (1, 1, "c.txt")], "source_ord int, child int, path string")
    got = discover.dedupe_sources(items).orderBy("source_ord", "child").collect()
    assert [(r.path, r.source_ord) for r in got] == [("a.PDF", 0), ("b.pdf", 0)]
    out = spark.createDataFrame([("a.md", 1000), ("b.md", 1001)], "slug string, size long")
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "file string")
    assert sorted(r.file for r in discover.skip_existing(files, out).collect()) == ["a.pdf", "c.pdf"]


def test_stream(spark, tmp_path):
    pages = [("d", i, CLEAN * 12, None, None) for i in range(1, 4)]
    schema = "doc string, page_num int, text_raw string, ocr_raw string, ocr_error string"
    spark.createDataFrame(pages, schema).coalesce(1).write.parquet(str(tmp_path / "pages"))
    got = []
    df = spark.readStream.schema(schema).parquet(str(tmp_path / "pages"))
    stream.documents(df, lambda d, n: got.extend(d.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.doc, r.pages_extracted) for r in got] == [("d", 3)]
    assert stream.judged_pages(df).isStreaming


def test_health():
    assert adapters.health(lambda p: "Hello there", b"")[0] and not adapters.health(lambda p: "??", b"")[0]
    assert adapters.health(lambda p: 1 / 0, b"") == (False, "ZeroDivisionError: division by zero")


def test_command_line(tmp_path, capsys):
    assert cli.main(["package", "--list"]) == 0 and "cursor-rules" in capsys.readouterr().out
    (tmp_path / "a.md").write_text("x")
    assert cli.main(["package", str(tmp_path / "a.md"), "--target", "chatgpt-gpt", "--out", str(tmp_path)]) == 0
    assert (tmp_path / "gpt-untitled/PROMPT.md").exists()
    assert cli.main(["package", "--target", "chatgpt-gpt", "--out", str(tmp_path)]) == 1
    assert cli.main(["extract", str(tmp_path / "none")]) == 1


def test_native_html_agrees(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(html.parsed_html("html").alias("a"), html.native_html("html").alias("b"))
    assert df.filter(F.col("a") != F.col("b")).count() == 0


def test_mixed_sources(spark, tmp_path):
    folder = tmp_path / "a [1]"
    folder.mkdir()
    (folder / "sub.pdf").mkdir()
    for name in ("z.pdf", "b.EPUB", "n.txt"):
        (folder / name).write_bytes(name.encode())
    (tmp_path / "y{1}.pdf").write_bytes(b"y")
    sources = [str(tmp_path / "y{1}.pdf"), str(folder), str(folder / "z.pdf"), str(tmp_path / "none.pdf")]
    got = discover.collect_files(spark, sources)
    assert [r.file for r in got.collect()] == ["y{1}.pdf", "b.EPUB", "z.pdf"]
    assert {r.file: bytes(r.content) for r in discover.with_content(got).collect()} == {"y{1}.pdf": b"y", "b.EPUB": b"b.EPUB", "z.pdf": b"z.pdf"}
    assert discover.output_folder([str(folder)]) == str(folder / "extracted") and discover.output_folder(sources) == str(tmp_path / "extracted")
    assert discover.output_folder([str(folder), str(tmp_path)]) == str(tmp_path / "extracted")
    urls = [f"file://{tmp_path}/a%20%5B1%5D", "https://example.org/x.pdf", f"file://{folder}/n.txt".replace(" ", "%20"), f"file://{tmp_path}/y%7B1%7D.pdf", f"file://{tmp_path}/a%20%5B1%5D"]
    assert discover.dropped_paths(urls) == [str(folder), str(tmp_path / "y{1}.pdf")]


def test_files_are_read_once(spark, tmp_path):
    def read(content):
        with open(content.decode(), "a") as f:
            f.write("x")
        yield 1, CLEAN * 12, None

    log = tmp_path / "log"
    files = spark.createDataFrame([("a.pdf", "pdf", bytearray(str(log).encode()))], "file string, kind string, content binary")
    assert [r.pages_extracted for r in extract_files(files, readers={"pdf": read}, ocr=lambda f, n: "").collect()] == [1]
    assert log.read_text() == "x"


def test_a_run_can_be_stopped(spark, tmp_path):
    def slow(content):
        time.sleep(30)
        yield 1, "x", None

    (tmp_path / "a.pdf").write_bytes(b"x")
    run = Extraction(spark, [str(tmp_path)], str(tmp_path / "out"), readers={"pdf": slow})
    got = []
    t = threading.Thread(target=lambda: got.append(run.run()))
    began = time.monotonic()
    t.start()
    time.sleep(3)
    assert 0 <= run.percent() < 100
    run.cancel()
    t.join(20)
    assert not t.is_alive() and got == [None] and time.monotonic() - began < 25 and not (tmp_path / "out/_QC_REPORT.md").exists()


@pytest.fixture
def fakes(monkeypatch):
    """Stand-ins of the optional libraries; pictures are what they say."""

    class Page:
        def __init__(self, text):
            self.text = text

        def get_text(self, kind):
            return self.text if kind == "text" and self.text != "broken" else 1 / 0

        def get_pixmap(self, matrix, alpha):
            return types.SimpleNamespace(tobytes=lambda kind: f"{self.text}@{matrix[0]:.3f}".encode())

    class Document(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    def open_(path=None, stream=None, filetype=None):
        content = stream or open(path, "rb").read()
        if content == b"bad":
            raise ValueError("no pdf")
        return Document(Page(x) for x in content.decode().split("|"))

    fitz, pil, image, engine = (types.ModuleType(x) for x in ("fitz", "PIL", "PIL.Image", "pytesseract"))
    fitz.open, fitz.Matrix, image.open, pil.Image = open_, lambda a, b: (a, b), lambda f: f.read().decode(), image
    engine.pytesseract, engine.image_to_string = types.SimpleNamespace(), lambda picture, lang, config: f"{picture} {lang} {config}"
    for m in (fitz, pil, image, engine):
        m.__spec__ = types.SimpleNamespace()
        monkeypatch.setitem(sys.modules, m.__name__, m)
    return engine


def test_pdf_pages(fakes):
    assert list(adapters.read_pdf(b"one|broken|three")) == [(1, "one", None), (2, "", None), (3, "three", None)]
    with pytest.raises(ValueError):
        list(adapters.read_pdf(b"bad"))


def test_ocr_of_a_page(fakes, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    told = tmp_path / "engine"
    told.write_text("")
    monkeypatch.setenv("TESSERACT_CMD", str(told))
    assert ocr.of_folder(str(tmp_path))("a.pdf", 2) == "two@4.167 eng --oem 1 --psm 6"
    assert fakes.pytesseract.tesseract_cmd == str(told) and ocr.missing({"pdf", "ocr"}) == []
    monkeypatch.setattr(fakes, "image_to_string", lambda *a, **k: 1 / 0)
    assert ocr.of_folder(str(tmp_path))("a.pdf", 1) == ""


def test_missing_libraries(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TESSERACT_CMD", str(tmp_path / "none"))
    monkeypatch.setattr(ocr.shutil, "which", lambda _: None)
    assert ocr.missing({"epub"}) == [] and "tesseract" in ocr.missing({"ocr"})
    bundle = tmp_path / "X.app/Contents/Resources"
    (bundle / "bin").mkdir(parents=True)
    (bundle / "tessdata").mkdir()
    (bundle / "bin/tesseract").write_text("")
    (bundle / "lib").mkdir()
    assert ocr.tesseract_binary(str(bundle / "lib/x.py")) == str(bundle / "bin/tesseract")
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert cli.main(["extract", str(tmp_path)]) == 2 and "PyMuPDF" in capsys.readouterr().err
    assert ocr.self_test()[0] is False


@pytest.mark.parametrize(("heights", "mode"), [([], 6), ([3, 4], 3), ([20, 20], 3), ([20] * 10, 6), ([20] * 8 + [60] * 2, 3), ([20] * 9 + [60], 6)])
def test_segmentation_modes(heights, mode):
    assert ocr.mode_of(heights) == mode


def test_scratch_tables_are_deleted(spark):
    since = scratch.mark()
    a, b = (scratch.written(spark.range(3), name) for name in "ab")
    scratch.delete(since, keep_last=True)
    assert b.count() == 3 and scratch.mark() == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist"):
        a.count()
    scratch.delete(since)
    assert scratch.mark() == since
