import random

import model
import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import assemble, boilerplate, export, progress, report
from leafmark.operators.arbitrate import Rules, arbitrate
from leafmark.plans.inputs import CLEAN

PAGES = "doc string, page_num int, text_raw string, ocr_raw string, ocr_error string"
GOOD = CLEAN * 12


def judge(spark, rows, rules=None):
    df = spark.createDataFrame([("d", i + 1, *r) for i, r in enumerate(rows)], PAGES)
    return arbitrate(df, rules or Rules()).orderBy("page_num").collect()


def test_branches(spark):
    got = judge(
        spark,
        [
            (GOOD, None, None), ("xq zx qq", GOOD, None), ("the of to zz zz zz zz zz", GOOD, None), ("the zz qq xxx yyy zzz", "qq", None),
            ("", "x" * 40 + "", None), ("", "", None), ("", None, "ValueError: no: engine"), (None, None, None),
        ],
    )
    assert [r.branch for r in got] == ["gate", "broken_text", "margin", "text", "ocr", "none", "none", "none"]
    assert [r.method for r in got] == ["text", "ocr", "ocr", "text", "ocr", "none", "none", "none"]
    assert got[6].ocr_error == "ValueError: no: engine" and got[0].ocr_score is None and got[5].text_score is None


def test_forced_ocr_runs_but_text_can_win(spark):
    assert judge(spark, [(GOOD, "qq", None)], Rules(force_ocr=True))[0].branch == "text"


@pytest.mark.parametrize(("n", "hits", "found"), [(19, 19, False), (20, 4, False), (20, 5, True), (30, 5, False), (30, 6, True)])
def test_running_lines_bounds(spark, n, hits, found):
    rows = [("d", i, ("  Header \n" if i < hits else "") + f"page text {i}") for i in range(n)]
    got = boilerplate.running_lines(spark.createDataFrame(rows, "doc string, page_num int, text string")).collect()
    assert [(r.line, r.n_pages) for r in got] == ([("Header", hits)] if found else [])


def test_running_lines_match_model(spark):
    r = random.Random(3)
    lines = ["Title", "ab", "7", "x" * 80, "y" * 81, " indented ", "1234", *map(str, range(5))]
    docs = {f"d{k}": ["\n".join(r.choice(lines) for _ in range(6)) for _ in range(r.choice([10, 20, 37]))] for k in range(6)}
    df = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc string, page_num int, text string")
    for row in boilerplate.strip_running_lines(df).collect():
        assert row.text == model.strip_lines(docs[row.doc][row.page_num], model.boilerplate(docs[row.doc]))


def test_document(spark):
    rows = [("d", 1, GOOD, None, None), ("d", 2, "", None, "RuntimeError: x"), ("d", 3, "12", "34", None), ("d", 4, "the skipped people " + GOOD, None, None)]
    r = assemble.extract(spark.createDataFrame(rows, PAGES)).collect()[0]
    assert (r.pages_extracted, r.pages_skipped, r.pages_via_text, r.pages_via_ocr) == (2, 2, 2, 0)
    assert r.ocr_errors == ["p2: RuntimeError: x"]
    assert r.word_count == 12 * 11 + 6  # a page that begins with the word counts nothing
    assert r.reason.startswith("OCR failed on 1 pages (RuntimeError)")
    assert r.markdown.split("\n\n")[1] == "<!-- Page 2: skipped (empty) -->" or "skipped (ocr" not in r.markdown


def test_reports(spark):
    rows = [(f"d{k}", n, GOOD if k == 0 else "", None, "E: x" if k == 2 else None) for k in range(3) for n in range(1, 61)]
    docs = assemble.extract(spark.createDataFrame(rows, PAGES)).withColumn("file", F.concat("doc", F.lit(".pdf")))
    res = report.results(docs)
    lines = [r.row for r in report.qc_rows(res).orderBy("n").collect()]
    assert lines[0].startswith("| 1 | d0.pdf | 60 | 60 | 0 | 0 |") and "GOOD" in lines[0] and lines[1].endswith("POOR | — |")
    s = report.run_summary(res).collect()[0]
    assert (s.good, s.review, s.poor) == (1, 0, 2)
    assert report.ocr_appendix(res).count() == 0
    more = spark.createDataFrame([("f", [f"p{i}: e" for i in range(53)])], "file string, ocr_errors array<string>")
    got = [r.line for r in report.ocr_appendix(more).orderBy("pos").collect()]
    assert len(got) == 51 and got[-1] == "- … and 3 more"
    failed = spark.createDataFrame([("x.pdf",)], "file string")
    assert "exists | skipped" in report.qc_rows(report.existing(failed)).collect()[0].row
    assert report.slug_collisions(spark.createDataFrame([("a.pdf",), ("a.epub",), ("b.pdf",)], "file string")).collect()[0].files == ["a.epub", "a.pdf"]


def test_smoothing(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0],)], "x array<double>")
    assert df.select(progress.smoothed_rates(F.col("x")).alias("y")).collect()[0].y[-1] == 16.875
    assert df.select(progress.file_permille(F.lit(1), F.lit(0)).alias("p"), progress.overall_percent(F.lit(2), F.lit(3)).alias("q")).collect()[0] == (0, 66)


def test_package(spark, tmp_path):
    a = tmp_path / "a.md"
    a.write_text("x")
    root = export.build_package("cursor-rules", "My Notes!", "about", [a], tmp_path / "out")
    assert root.name == "cursor-my-notes" and (root / "docs/a.md").read_text() == "x" and "about" in (root / "PROMPT.md").read_text()
    with pytest.raises(KeyError):
        export.build_package("none", "x", "", [a], tmp_path)
    with pytest.raises(ValueError):
        export.build_package("cursor-rules", "x", "", [], tmp_path)
    with pytest.raises(FileNotFoundError):
        export.build_package("cursor-rules", "x", "", [tmp_path / "no"], tmp_path)
    files = spark.createDataFrame([("a.md",), ("b.md",)], "file string")
    m = export.manifest(files, F.lit("My Notes!"))
    assert m.count() == 8
    p = {r.target: r.prompt for r in export.prompts(m, "My Notes!", "about").collect()}
    assert '{"name"' in p["chatgpt-gpt"] and "- `./gpt-my-notes/knowledge/b.md`" in p["chatgpt-gpt"]
    assert export.slug_of("  __Hello, World!__ ") == "hello-world"
    assert T.package_slug is not None


def test_a_package_is_replaced_only_by_a_whole_one(tmp_path):
    a = tmp_path / "a.md"
    a.write_text("x")
    root = export.build_package("cursor-rules", "n", "", [a], tmp_path)
    (root / "mine").write_text("y")
    with pytest.raises(FileNotFoundError):
        export.build_package("cursor-rules", "n", "", [a, tmp_path], tmp_path)  # a folder is no file
    assert (root / "mine").exists()
    again = export.build_package("cursor-rules", "n", "", [a], tmp_path)
    assert again == root and sorted(p.name for p in root.iterdir()) == ["PROMPT.md", "docs"] and not list(tmp_path.glob(".package-*"))


def test_numbers_over_ranges(spark):
    files = [f"f{(i * 37) % 500:03}" for i in range(500)]
    got = report.numbered(spark.createDataFrame([(f,) for f in files], "file string").repartition(7), "file").collect()
    assert sorted((r.n, r.file) for r in got) == list(enumerate(sorted(files), 1))


def test_console_lines(spark):
    docs = assemble.extract(spark.createDataFrame([("d", n, GOOD, None, None) for n in range(1, 4)], PAGES)).withColumn("file", F.concat("doc", F.lit(".pdf")))
    rows = report.results(docs).unionByName(report.existing(spark.createDataFrame([("y.pdf",)], "file string")))
    failed = report.results(docs.withColumn("pages_extracted", F.lit(0)).withColumn("file", F.lit("x" * 60)), issues=F.array(F.lit("Failed to open PDF: " + "z" * 80)))
    got = {r.file: r.line for r in report.log_lines(rows.unionByName(failed)).collect()}
    assert got["d.pdf"] == "d.pdf" + " " * 43 + " ✅ pages=3 (text=3, ocr=0) words=414 score=" + got["d.pdf"].rpartition("=")[2]
    assert got["y.pdf"].endswith("⏭  exists") and got["x" * 60] == "x" * 48 + " ❌ " + ("Failed to open PDF: " + "z" * 80)[:60]
    text = report.summary_text(report.run_summary(rows), 125.9).first().text
    assert text.startswith("Done in 2m 5s.\n\n✓ 1 good   ⚠ 0 review   ✗ 1 failed\n") and text.endswith(" words extracted total.")


def test_columns_of_the_same_names(spark):
    """with_quality leaves columns alone that have names of its own."""
    from leafmark.functions.quality import with_quality

    df = with_quality(spark.createDataFrame([("the people", 1, 2, 3, 4, 5)], "t string, n int, alpha int, r int, g int, L int"), "t", "q")
    r = df.collect()[0]
    assert df.columns == ["t", "n", "alpha", "r", "g", "L", "q"] and tuple(r)[1:6] == (1, 2, 3, 4, 5) and r.q.word_count == 2


def test_texts_are_scored_once(spark):
    """Pages that were gated keep their score."""
    from leafmark.operators.arbitrate import ocr_gate

    gated = ocr_gate(spark.createDataFrame([("d", 1, GOOD, None, None)], PAGES)).withColumn("text_norm", F.lit("kept"))
    assert arbitrate(gated).collect()[0].text == "kept"


def test_rows_are_made_once_to_be_numbered(spark):
    """The bounds of ranges are drawn from rows that are written, not from another run of what makes them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(i):
        made.add(1)
        return f"f{i:03}"

    got = report.numbered(spark.range(100).select(name("id").alias("file")), "file").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.file)] == list(range(1, 101)) and made.value == 100
