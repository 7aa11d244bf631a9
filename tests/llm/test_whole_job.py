import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import DATA
from tokenizers import Tokenizer

from leafmark.llm import common, html_extract, license_scan, minhash, registry, substring_dedup

SF = f"{DATA}/sf0.01"


def test_df_is_counted_for_each_shingle(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(common.ident("doc_id").alias("id"), "text").cache()
    texts = {r.id: r.text for r in rows.collect()}
    ids = sorted(texts)
    s = minhash.Shingles(pa.array([texts[i] for i in ids]))
    count = Counter(s.hash.tolist())
    want = np.array([count[h] for h in s.hash.tolist()])
    n = int((s.counts > 0).sum())
    idf = minhash.shingle_weights(rows)
    right = 1 + minhash.IDF_SHARE * np.log((n + 1) / (want + 1)) / np.log(n + 2)
    # low bits of different texts' shingles may clash
    assert (np.abs(idf[s.low] - right) > 1e-6).sum() < 1e-3 * len(want)
    assert want.max() > 5 and (want == 1).sum() > 0.5 * len(want)
    shared, docs = minhash.shared_shingles(rows)
    known = {r.id: r.known for r in minhash._with_known(rows, shared).select("id", "known").collect()}
    assert docs == n and (s.df(pa.array([known[i] for i in ids], pa.list_(pa.binary()))) == want).all()


def test_df_of_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "b c d e f"), (None, "b c d e f"), (None, "x"), (2, None), (3, "")], "id long, text string")
    rows = rows.select(common.ident("id").alias("id"), "text")
    shared, docs = minhash.shared_shingles(rows)
    got = minhash._with_known(rows, shared).toPandas()
    df = minhash.Shingles(pa.array(got.text)).df(pa.array([None if k is None else list(k) for k in got.known], pa.list_(pa.binary())))
    assert docs == 5 and sorted(df.tolist()) == [1, 2, 2, 4, 4, 4, 4]


def test_a_file_of_many_licences_has_all_of_them(spark):
    texts = [t for t, _, _ in license_scan.TEMPLATES]
    five = [texts[i] for i in (0, 4, 5, 11, 13)]
    docs = spark.createDataFrame([(1, ". ".join(five)), (2, ". ".join(texts)), (3, "clause domain mozilla commons attribution " + texts[8]), (4, "clause domain mozilla commons"), (5, "apache plain words")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].labels == "all-rights-reserved,apache,apache-2.0,cc-by,cc-by-nc,gpl,gpl-3.0,mpl"
    assert set(got[2].labels.split(",")) == {x for _, _, x in license_scan.TEMPLATES} | {x for _, x in license_scan.BASE}
    assert got[3].labels == "mit" and got[3].score == 1 and got[4].labels == got[5].labels == ""


def test_licence_texts_and_scores(spark):
    grant = license_scan.TEMPLATES[14][0]
    words = grant.split()
    edited = " ".join("x" if i in (30, 41, 55) else w for i, w in enumerate(words))  # not in the key phrase
    broken = " ".join("x" if i == 4 else w for i, w in enumerate(words))
    half = " ".join(words[:20])
    texts = ["Copyright. " + grant.capitalize() + ".", edited, broken, half, "MIT License", "the public domain", "the " * 50, None, "Licensed under the Apache License, Version 2.0 " + license_scan.TEMPLATES[18][0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].labels for i in range(9)] == ["mit", "mit", "", "", "mit", "public-domain", "", "", "apache,apache-2.0"]
    assert got[0].score == 1 and 0.5 < got[1].score < 1 and got[2].score == got[3].score == 0 and got[4].score == 1 and got[4].n_base == 1 and 0.5 <= got[5].score < 1
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(license_scan.SQL)
    names = [d[0] for d in rows.description]
    for r in rows.fetchall():
        for c, x in zip(names, r, strict=True):
            assert got[r[0]][c] == x or abs(got[r[0]][c] - x) < 1e-6


LONG = "A paragraph of some length, with commas, more of them, and words enough to count for the container that holds it."


@pytest.mark.parametrize(
    ("before", "after", "kept"),
    [
        ("<h1>T</h1><p>Long lead, and more.</p>", "<p>A long end.</p>", ("T", "Long lead, and more.", "A long end.")),
        ("<h2>T</h2><p>short</p>", "<blockquote><p>Quoted</p></blockquote>", ("T", "short", "Quoted")),
        ("<p>See <a href=x>this</a>, a paragraph with a link</p>", "loose <b>text</b>", ("See this, a paragraph with a link", "loose text")),
        ("<p><a href=a>Home</a> | <a href=b>About us</a></p><h3><a href=c>Other story</a></h3>", "<p class=share>Share</p><a href=d>more</a>", ()),
    ],
)
def test_paragraphs_and_headings_beside_the_container(before, after, kept):
    page = f"<html><body><nav>n</nav><div class=story>{before}<div class=content>{f'<p>{LONG}</p>' * 4}</div>{after}</div><footer>f</footer></body></html>"
    lines = html_extract.main_text(page).split("\n")
    assert [x for x in lines if x != LONG] == list(kept) and lines.count(LONG) == 4


P = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='page has-sidebar'><article>{P}</article></div>", [LONG]),
        (f"<div id=content class=no-comments>{P * 3}</div>", [LONG] * 3),
        (f"<div class='layout with-header'><main>{P}</main></div>", [LONG]),
        (f"<article><p class=social-science>Social science.</p>{P}</article>", ["Social science.", LONG]),
        (f"<div><article>{P * 2}</article></div><div><article>{P}<p>Second</p></article></div>", [LONG] * 3 + ["Second"]),
        (f"<div class=c>{P * 3}</div><div><a href=/x/>link link link link link</a> x</div>", [LONG] * 3),
        (f"<form id=aspnet>{P * 3}</form><form><p>search, here, for more, and more</p></form>", [LONG] * 3),
        (f"<div class=x>{P}</div><div id=comments>{P * 9}</div>", [LONG]),
        (f"<div class=a><section><h2>One</h2>{P * 3}</section><section><h2>Two</h2><p>Short.</p></section></div>", ["One", LONG, LONG, LONG, "Two", "Short."]),
        (f"<div class='sidebar-wrapper'><div class=box>{P * 5}</div></div>", [LONG] * 5),
        (f"<div class=story>{P * 3}</div><div class=sidebar><p>{LONG}</p></div><div class='ad-slot-1'>{P}</div>", [LONG] * 3),
    ],
)
def test_names_do_not_cut_the_content(page, text):
    assert html_extract.main_text(page).split("\n") == text


def test_pages_without_article_elements_give_the_same_text(spark):
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        assert html_extract.main_text(re.sub("(</?)article>", r"\1div>", page)) == html_extract.main_text(page)


def scored(page):
    """Points of the elements of a well-formed page, from the definition: names don't count here."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(page)
    up = {c: e for e in root.iter() for c in e}
    points = {e: 5.0 * (e.tag in ("div", "section", "ul", "p", "blockquote", "li")) for e in root.iter()}
    for e in root.iter():
        if e.tag in ("p", "li"):
            text = " ".join("".join(e.itertext()).split())
            gain = (len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)
            for share in (1, 0.5):
                e = up.get(e)
                if e is not None:
                    points[e] += share * gain
    full = lambda e, of: sum(len("".join(x.itertext())) for x in e.iter(of))
    return max(((1 - min(1, full(e, "a") / max(1, full(e, "p") + full(e, "li")))) * n, e.get("id")) for e, n in points.items() if e.tag in ("div", "section", "ul") and (full(e, "p") or full(e, "li")))[1]


def test_the_best_container_is_that_of_most_points():
    import random

    r = random.Random(5)
    for _ in range(60):
        part = []
        for i in range(4):
            kind = r.choice(["div", "section", "ul"])
            tag = "li" if kind == "ul" else "p"
            items = "".join(f"<{tag}>{(', ' if r.random() < 0.5 else ' ').join(['word'] * r.randint(1, 60))}{'<a>link text</a>' * r.randint(0, 2)}</{tag}>" for _ in range(r.randint(1, 5)))
            part.append(f'<{kind} id="b{i}" class="c{i}">{items}</{kind}>')
        page = f"<html><body>{''.join(part)}</body></html>"
        want = re.search(f'id="{scored(page)}".*?</(?:div|section|ul)>', page)[0]
        first = html_extract.SPACES.sub(" ", re.sub("<[^>]*>", "", re.search("<(?:p|li)>(.*?)</(?:p|li)>", want)[1])).strip()
        assert first in html_extract.main_text(page).split("\n")


def one_of_each(spark, texts):
    ids = sorted(texts)
    s = minhash.Shingles(pa.array([texts[i] for i in ids]))
    idf = minhash.shingle_weights(spark.createDataFrame([(i, texts[i]) for i in ids], "id long, text string"))
    cuts = np.cumsum(s.counts)[:-1]
    sets = list(zip((x.tobytes() for x in np.split(s.low, cuts)), (x.astype(np.uint32).tobytes() for x in np.split(s.tf, cuts)), strict=True))
    holders, parent = defaultdict(list), list(range(len(ids)))
    for row, x in zip(s.row.tolist(), s.low.tolist(), strict=True):
        holders[x].append(row)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(v[a], v[b]) for v in holders.values() for b in range(len(v)) for a in range(b)}:
        if minhash.similarity(*sets[a], *sets[b], idf) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: texts[i] for k, i in enumerate(ids) if root(k) == k}


def without_passages(texts, n=13):
    words = {i: list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    windows = {i: [tuple(m[0] for m in w[k : k + n]) for k in range(len(w) - n + 1)] for i, w in words.items()}
    owner, out = {}, {}
    for i in sorted(texts):
        for x in windows[i]:
            owner.setdefault(x, i)
    for i, w in words.items():
        gone = {j for k, x in enumerate(windows[i]) if owner[x] < i for j in range(k, k + n)}
        text, last = "", None
        for k, m in enumerate(w):
            if k not in gone:
                gap = "" if last is None else texts[i][w[last].end() : m.start()]
                text += (gap if last == k - 1 else "" if last is None else "\n" if "\n" in gap else " ") + m[0]
                last = k
        out[i] = text if gone else texts[i]
    return out


def test_a_hot_phrase_with_very_many_continuations(spark):
    """Seven words in every row, followed by 100,000 different continuations, and a few passages that do repeat."""
    hot = "here stands a phrase that is everywhere"
    texts = {i: " ".join(f"{hot} " + " ".join(f"c{i}_{j}_{k}" for k in range(6)) for j in range(100)) for i in range(1000)}
    shared = " ".join(f"s{k}" for k in range(20))
    for i in (17, 400, 999):
        texts[i] += f" {hot} {shared} end{i}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in substring_dedup.drop_repeated_passages(docs, counts=True).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {400, 999}
    assert all(got[i].n_removed == 27 and got[i].text == texts[i].replace(f" {hot} {shared}", "") for i in (400, 999))
    assert all(got[i].text == t for i, t in texts.items() if i not in (400, 999))


@pytest.mark.parametrize("window", [3, 4, 13, 20])
def test_windows_of_other_lengths(spark, window):
    import random

    r = random.Random(window)
    texts = {i: " ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for i in range(40)}
    texts |= {100 + i: texts[i] + " tail" for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.text for x in substring_dedup.drop_repeated_passages(docs, window=window).collect()}
    assert got == without_passages(texts, window) and substring_dedup.levels(window)[-1] == window


def test_null_ids_and_copies_fill_no_bucket(spark):
    """Rows without an id are one document, whose copies stay; where they lie doesn't matter."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text)] * 50 + [(5, text), (5, text + " x"), (6, "y " + text)], "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.drop_repeated_passages(docs, counts=True).collect())
    assert got == {(None, 0): 50, (5, 30): 2, (6, 30): 1}


def test_pipeline_is_its_five_stages(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    one = {r.doc_id: texts[r.doc_id] for r in registry.queries()["op8_quality_rules"](spark, SF).collect() if r.kept}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for i in sorted(one):
        for line in one[i].split("\n"):
            owner.setdefault(key(line), i)
    two = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in one.items()}
    three = one_of_each(spark, two)
    four = without_passages(three)
    assert len(one) > len(three) and three != four
    rows = corpus_pipeline.run(spark, SF).collect()
    hf, pieces, placed = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        placed[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == four.keys()
    for i, text in four.items():
        ids = np.array([*hf.encode(text, add_special_tokens=False).ids, 2], "<u4")
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 1024)))
        ends = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == ends and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            ends += r.length
        assert ends == len(ids)
    for items in placed.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 1024
