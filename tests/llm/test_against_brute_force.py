import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmark.llm import ann, bpe, common, html_extract, minhash, packing, pipeline, quality_rules, registry, toxicity

SF = f"{DATA}/sf0.01"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
BPE = bpe.encoder(RANKS)
HF = Tokenizer.from_file(JSON)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS)[0], special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, SF), duck("sf0.01"), registry.oracle_sql()[name])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeilnorst ABC'\n\t .,0129é漢🙂\x1c\x85　"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=80))
def test_bpe_ids(text):
    ids = BPE.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert BPE.text(ids, chunk=1) == text


@given(st.text(max_size=60), st.integers(1, 5))
def test_utf8_stream(text, n):
    data, s = text.encode("utf-8", "replace"), bpe.Utf8Stream()
    assert "".join(s.feed(data[i : i + n]) for i in range(0, len(data), n)) + s.feed(b"", True) == data.decode()


def test_utf8_stream_of_broken_bytes():
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe6") == "a" and s.feed(b"\xbc\xa2\xff") == "漢�" and s.feed(b"\xe6", True) == "�"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE6, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5]), st.integers(0, 255)), max_size=14), st.integers(1, 6))
def test_utf8_stream_of_any_bytes(data, n):
    data, s, one = bytes(data), bpe.Utf8Stream(), bpe.Utf8Stream()
    assert "".join(s.feed(data[i : i + n]) for i in range(0, len(data), n)) + s.feed(b"", True) == data.decode("utf-8", "replace")
    assert "".join(map(one.step, data)) + one.feed(b"", True) == data.decode("utf-8", "replace")


def test_op7(spark, texts):
    for r in registry.queries()["op7_byte_bpe"](spark, SF).collect():
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op9(spark, texts):
    hf, rows = Tokenizer.from_file(JSON), registry.queries()["op9_best_fit_packing"](spark, SF).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    used = Counter()
    for doc_id, text in texts.items():
        ids = np.array([*hf.encode(text, add_special_tokens=False).ids, 2], "<u4")
        got = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        assert all(r.length == 1024 for r in got[1:]) and len(got) == -(-len(ids) // 1024)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    large, whole = sum(r.length > 512 for r in rows), -(-sum(r.length for r in rows) // 1024)
    assert len(used) <= 1.01 * max(large, whole) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|padding|>", " <|endoftext|>x", "\n\n", "  ", "don't", " 1234", "\x1c", "\u00e9", "漢字"]), st.text(max_size=8)), max_size=8))
def test_packing_ids_are_those_of_tokenizers(parts):
    """Special tokens in the text included."""
    text = "".join(parts).encode("utf-8", "replace").decode()
    ids = packing.tokenizer(JSON).encode_to_numpy(text, allowed_special="all", disallowed_special=()).tolist() if text else []
    assert ids == HF.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200))
def test_packing_plan(lengths):
    counts = Counter(lengths)
    runs = sorted(packing.plan(counts, 60))
    assert len(runs) < 2000
    at = defaultdict(list)
    for n, number in ((n, k) for n, c in counts.items() for k in range(c)):
        run = [r for r in runs if r[0] == n and r[1] <= number][-1]
        at[run[2] + number - run[1]].append((run[3], n))
    for items in at.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 60
    assert sum(map(len, at.values())) == len(lengths)


def base_counts(text):
    words, seen, again = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n, hit = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if n[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(hit)


def test_op8(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = Counter()
    for r in registry.queries()["op8_quality_rules"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            right[labels[r.doc_id], r.kept] += 1
    assert right[1, False] <= 0.01 * right[1, True] and right[0, True] <= 0.1 * max(1, right[0, False])


def test_lines_of_mixed_pages_have_labels_of_their_own():
    """Boilerplate is planted in lines of some pages; only documents are labelled."""
    rng = np.random.default_rng(2)
    line = lambda: " ".join(rng.choice(["alpha", "river", "house", "window", "table", "stone"], 12)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["HOME", "MENU", "LOGIN", "SHARE", "BUY"], 6)) + " !!! ### $$$"
    pages, good, want = [], [], []
    for i in range(240):
        kinds = [0] * 8 if i % 4 == 0 else [0, 0, 1, 0, 0, 0, 0, 0] if i % 4 == 1 else [1] * 6 if i % 4 == 2 else [0, 1, 1, 1, 1, 1, 1, 0]
        pages.append("\n".join(junk() if k else line() for k in kinds))
        good.append(i % 4 < 2)
        want += kinds
    lines = quality_rules.Lines(pa.array(pages))
    crf = quality_rules.LineCrf.trained(lines.features, lines.of_row, lines.chars, np.array(good))
    marked = crf.viterbi(lines.features, lines.of_row)
    assert (marked == want).mean() > 0.98
    share = quality_rules._share(marked == quality_rules.CONTENT, lines.chars, lines.of_row)
    assert ((share > 0) & (share < 1)).sum() >= 110 and ((share >= crf.least_share) == good).all()


def test_equal_lines_are_found_as_bytes():
    lines = quality_rules.Lines(pa.array(["a\nb\na\n \n \na ", None, "", "a", "\n\nb\nb"]))
    assert lines.by_row(lines.again).tolist() == [1, 0, 0, 0, 1] and lines.of_row.tolist() == [6, 1, 1, 1, 4]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    crf = quality_rules.LineCrf(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = rng.normal(size=(n, 3))
        value = lambda p, x=x: sum((x @ crf.weights)[i, k] for i, k in enumerate(p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(np.ndindex(*[2] * n), key=value)
        assert tuple(crf.viterbi(x, np.array([n]))) == best
    many = [rng.normal(size=(n, 3)) for n in (3, 1, 7, 2, 7, 5)]  # together as on their own
    alone = [crf.viterbi(x, np.array([len(x)])) for x in many]
    assert (crf.viterbi(np.concatenate(many), np.array([len(x) for x in many])) == np.concatenate(alone)).all()


def test_op3(spark, texts):
    ids = sorted(texts)
    s = minhash.Shingles(pa.array([texts[i] for i in ids]))
    idf = minhash.shingle_weights(spark.read.parquet(f"{SF}/documents.parquet").select(common.ident("doc_id").alias("id"), "text"))
    cuts = np.cumsum(s.counts)[:-1]
    sets = list(zip((x.tobytes() for x in np.split(s.low, cuts)), (x.astype(np.uint32).tobytes() for x in np.split(s.tf, cuts)), strict=True))
    holders, shared = defaultdict(list), Counter()
    for i, (low, _) in enumerate(sets):
        for x in np.frombuffer(low, np.uint32).tolist():
            holders[x].append(i)
    for v in holders.values():
        shared.update((v[a], v[b]) for b in range(len(v)) for a in range(b))
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in shared:
        if minhash.similarity(*sets[a], *sets[b], idf) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {ids[i]: ids[root(i)] for i in range(len(ids))}
    got = {r.doc_id: r.class_id for r in registry.queries()["op3_minhash_near_dedup"](spark, SF).collect()}
    assert got == want and sum(k != v for k, v in got.items()) > 50


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.sort(np.concatenate([a[:270], rng.integers(0, 2**63, 30, dtype=np.uint64)]))
    a = np.sort(a)
    x, y = (minhash.samples(h, np.ones(300, np.float32), np.array([300]), 2000)[0] for h in (a, b))
    assert abs((x == y).mean() - 270 / 330) < 0.03


@pytest.mark.parametrize(("block", "spokesmen"), [(minhash.BLOCK, minhash.SPOKESMEN), (3, 2), (2, 500)])
def test_classes_join_through_chains_and_hot_buckets(spark, monkeypatch, block, spokesmen):
    """Near copies of one text, each with other words changed: classes must be those of all pairs, also where buckets are cut by prefixes."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SPOKESMEN", spokesmen)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 16), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.shingle_weights(docs.select(F.col("doc_id").alias("id"), "text"))
    s = minhash.Shingles(pa.array([t for _, t in rows]))
    sets = [x.tobytes() for x in np.split(s.low, np.cumsum(s.counts)[:-1])]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if minhash.similarity(sets[a], None, sets[b], None, idf) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_prefixes_of_similar_texts_meet():
    rng = np.random.default_rng(11)
    docs, met, alike = 1000, 0, 0
    for _ in range(300):
        n = int(rng.integers(3, 60))
        pool = np.sort(rng.choice(2**32 - 1, 2 * n, replace=False).astype(np.uint32))
        df_of = dict(zip(pool.tolist(), np.minimum(2 + rng.zipf(1.5, 2 * n), docs).astype(np.uint32).tolist(), strict=True))
        tf_of = dict(zip(pool.tolist(), rng.integers(1, 4, 2 * n).tolist(), strict=True))
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.sort(np.unique(np.concatenate([a[rng.random(n) < 0.95], rng.choice(pool, int(rng.integers(0, 3)))])))
        if not len(b):
            continue
        packed = [(x.tobytes(), np.array([tf_of[i] + (rng.random() < 0.05) for i in x.tolist()], np.uint32).tobytes(), np.array([df_of[i] for i in x.tolist()], np.uint32).tobytes()) for x in (a, b)]
        weights = [minhash._weights(minhash._idf(low, df, docs), tf) for low, tf, df in packed]
        if minhash._similarity(a, weights[0], b, weights[1]) >= 0.8:
            rows = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 1]), *(pa.array([x[k] for x in packed], pa.binary()) for k in range(3))], ["node", "component", "low", "tf", "df"])
            out = next(minhash._prefixes(docs, 0.8)(iter([rows])))
            keys = [{k for n_, k in zip(out.column("node").to_pylist(), out.column("key").to_pylist(), strict=True) if n_ == side} for side in (0, 1)]
            alike += 1
            met += bool(keys[0] & keys[1])
            assert len(keys[0]) < 0.6 * n + 2
    assert alike > 50 and met == alike


def test_many_texts_of_one_id(spark):
    """A null id (or a repeated one) with very many texts is no pair of each two of them."""
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words) + f" x{i}") for i in range(60)] + [(7, "one two three four five six"), (7, "seven eight nine ten eleven twelve"), (9, "seven eight nine ten eleven twelve"), (None, None), (11, None), (3, "  ")]
    got = {r.id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-(2**63): -(2**63), 7: 7, 9: 7, 11: 11, 3: 3}


def test_op4_held_out(spark):
    sf = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = registry.queries()["op4_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 500
    order = np.argsort([r.score for r in got], kind="stable")
    y = np.array([r.toxic for r in got])[order]
    auc = (np.flatnonzero(y) + 1).sum() / (y.sum() * (1 - y).sum()) - (y.sum() + 1) / (2 * (1 - y).sum())
    assert auc > 0.85 and sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 0.02 * len(got)


def fitted(texts, labels):
    model = toxicity.FactorizationMachine.trained(texts, labels, float(np.mean(labels)))
    terms = toxicity.Terms({t: i for i, t in enumerate(model.terms.tolist())})
    return model, lambda t: model.score(terms(t))


def noise(rng, n=6, words=60):
    return " ".join(f"w{k}" for k in rng.integers(0, words, n))


def test_pairs_of_terms_are_learnt():
    """Toxic is the insult together with the group; neither alone."""
    rng = np.random.default_rng(3)
    _, score = fitted([f"{t} {noise(rng)}" for _ in range(150) for t in ("insultx groupy", "insultx", "groupy", "")], [1, 0, 0, 0] * 150)
    assert score("insultx groupy w1") > 0.5 > max(score("insultx w2"), score("groupy w3"), score("w4 w5"))


def test_terms_that_tell_labels_apart_in_pairs_alone():
    """No term is more frequent in toxic texts than in others."""
    rng = np.random.default_rng(1)
    kinds = ("insultx groupy", "slurz plantq", "insultx plantq", "slurz groupy")
    model, score = fitted([f"{t} {noise(rng, 20, 200)}" for _ in range(200) for t in kinds], [1, 1, 0, 0] * 200)
    assert not model.w.any() and model.paired.any()
    assert [score(f"{t} w3 w4") > 0.5 for t in kinds] == [True, True, False, False]


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    model = toxicity.FactorizationMachine(np.arange(6), -0.3, rng.normal(size=6), np.concatenate([rng.normal(size=(4, 3)), np.zeros((2, 3))]))
    x = {0: 1.0, 1: 2.5, 3: 1.7, 5: 1.0}
    z = -0.3 + sum(model.w[i] * v for i, v in x.items()) + sum(model.v[i] @ model.v[j] * x[i] * x[j] for i in x for j in x if i < j) / 3
    assert abs(model.score(x) - 1 / (1 + np.exp(-z))) < 1e-12 and model.score({}) == 1 / (1 + np.exp(0.3))


def test_a_term_of_few_rows_has_no_weight():
    """What the penalty leaves out from the start couldn't have had a weight."""
    rng = np.random.default_rng(8)
    rows = [(np.append(rng.choice(40, 8, replace=False), [50] if i in (3, 7) else []).astype(np.int32), np.ones(9 if i in (3, 7) else 8, np.float32)) for i in range(200)]
    y = np.array([i % 3 == 0 or i in (3, 7) for i in range(200)], float)
    x = toxicity._Rows(rows, 0)
    _, w = toxicity._weights(x, y, 2 / 200, 0.0, np.zeros(len(x.terms)), 0.0, 400)
    assert w[x.terms == 50] == 0 and w.any()


def test_op2(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in registry.queries()["op2_html_extract"](spark, SF).collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in lines if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<header>h</header><main><p>One, two.</p><ul><li>a</li><li>b</li></ul></main><div id=comments><p>me too, and me, and all of us, really</p></div>", "One, two.\na\nb"),
        ("<div class='cookie-notice'><p>We use cookies, you know, for many, many things.</p></div><div><p>Text&nbsp;of <b>it</b><br>all &lt;here&gt;</p></div>", "Text of it all <here>"),
        ("<article><p>a, b</p><aside>x</aside><form><p>q</p></form><script>p('</article>')</script><p>c</p></article><nav>n</nav>", "a, b\nc"),
        ("<p>open <p>two", "open\ntwo"), ("<div hidden><p>no</p></div><p>yes</p>", "yes"), ("&am &amp &quot;x", '&am & "x'),
    ],
)
def test_html_shapes(page, text):
    assert html_extract.main_text(page) == text


def recall(df, got, k=20, every=20):
    rows = df.collect()
    ids, v, found = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), defaultdict(list)
    for r in got.orderBy("rank").collect():
        found[r.query_id].append(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % every == 0):
        s = v @ v[i]
        s[i] = -np.inf
        assert len(found[ids[i]]) == min(k, len(ids) - 1)
        hits.append(len({*ids[np.lexsort((ids, -s))[:k]].tolist()} & {*found[ids[i]]}) / min(k, len(ids) - 1))
    return np.mean(hits)


def test_op6_recall(spark):
    assert recall(spark.read.parquet(f"{SF}/embeddings.parquet"), registry.queries()["op6_multiprobe_ann"](spark, SF)) >= 0.9


def vectors(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("lengths", [False, True])
def test_neighbours_in_clusters(spark, lengths):
    """Few rows are candidates there; and of vectors of different lengths the long ones are found."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = vectors(spark, v * rng.lognormal(0, 0.5, (3000, 1)) if lengths else v)
    found, n = ann.candidates(df, F.col("vec_id") % 20 == 0)
    assert recall(df, ann._best(found, 20)) >= 0.9 and n == 3000
    # a row counts once for each table that it is found in
    assert lengths or found.agg(F.sum("seen")).first()[0] < 0.5 * ann.TABLES * n * n / 20


def test_far_queries_find_as_many_as_there_are(spark):
    """Nearly all rows are in one bucket, and some queries are far from it."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(1, 32)) + 0.01 * rng.normal(size=(600, 32)), rng.normal(size=(40, 32))])
    df = vectors(spark, v)
    got = Counter(r.query_id for r in ann.nearest(df, F.col("vec_id") >= 600).collect())
    assert len(got) == 40 and set(got.values()) == {20}


def test_hot_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    df = vectors(spark, np.concatenate([np.repeat(rng.normal(size=(1, 8)), 300, axis=0), rng.normal(size=(300, 8))]))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == list(range(1, 21)) and got[100] == list(range(20)) and len(got) == 6


def test_buckets_are_visited_in_the_order_of_their_chances():
    h = ann.Hashes(8, 2, 3)
    rng = np.random.default_rng(2)
    q = rng.normal(size=(4, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, n = h.visits(q, np.full(4, 0.7), 1, 0.8, 125)
    for i in range(4):
        z = rng.normal(size=(200_000, 8)) * 1.0
        z -= (z @ q[i])[:, None] * q[i]
        near = 0.7 * q[i] + np.sqrt(1 - 0.49) * z / np.linalg.norm(z, axis=1, keepdims=True)
        share = Counter(h.codes(near, 1).tolist())
        seen = np.array([share[c] / 200_000 for c in codes[i].tolist()])
        assert abs(seen[: n[i]].sum() - 0.8) < 0.12 and seen[0] > 0.6 * seen.max() and seen[: n[i]].min() >= 0.0


def test_pipeline(spark, texts):
    """Each stage against its definition on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in registry.queries()["op8_quality_rules"](spark, SF).collect()}
    one = pipeline.quality(spark, docs, SF).cache()
    assert {r.doc_id for r in one.collect()} == {i for i, r in kept.items() if r.kept}
    two = {r.doc_id: r.text for r in pipeline.lines(spark, one, SF).collect()}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for i in sorted(two):
        for line in texts[i].split("\n"):
            owner.setdefault(key(line), i)
    assert two == {i: "\n".join(x for x in texts[i].split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i in two}
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in last.select("doc_id").collect()} <= set(two)
