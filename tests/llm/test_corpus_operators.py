"""Resampling, spelling variants and page extraction against brute force, on tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, n long, word string, bucket int, batch long, weight long"


def text(rng, n, letters="abz"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t"), (3, "Naïve CAFÉBARS cafebars, x")]
    rows += [(i, text(rng, 30 + i % 9)) for i in range(10, 90)]
    rows += [(90, text(rng, 3000)), (91, rows[20][1]), (91, rows[20][1]), (None, rows[21][1]), (None, None), (92, "z" * 40_000), (93, "Ünïcode " * 40)]
    rows += [(200 + i, "thermodynamics thermodynamic" + " hot" * 20) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, 7, "w", 1, 2, 3) for i, t in corpus], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


@pytest.mark.parametrize("max_n", [1, 2])
def test_resampling(spark, docs, empty, corpus, max_n, monkeypatch):
    from tracklens.llm import resampling

    monkeypatch.setattr(resampling, "PART", 1)
    target = [text(random.Random(k), 12) for k in range(9)] + [None, ""]
    runs = lambda t: Counter(zlib.crc32(b" ".join(w[i : i + n])) % 97 for w in [words(t)] for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    s, t = sum((runs(x) for _, x in corpus), Counter()), sum((runs(x) for x in target), Counter())
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in s}
    rows = []
    for i, x in corpus:
        own = runs(x)
        weight = sum(n * gain[b] for b, n in own.items())
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, own.total(), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    tdf = spark.createDataFrame([(k, x, 1) for k, x in enumerate(target)], "item_id long, text string, doc_id long")
    got = resampling.resample(docs, tdf, n_buckets=97, max_n=max_n).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((tuple(r[:5]) for r in rows), key=repr)
    if max_n == 1:
        assert resampling.resample(empty, tdf).count() == 0
        assert {r.weight for r in resampling.resample(docs, empty, n_buckets=97).collect() if not r.n_features} == {0}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


@pytest.mark.parametrize("piece", [4_000, 40, 3])
def test_spelling(docs, empty, corpus, piece):
    """Also with pieces so small that most prefixes are cut many levels deep."""
    from tracklens.llm import spelling

    n = Counter()
    for i, t in corpus:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    vocabulary = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    want, form = {}, {}
    for w, k in vocabulary.items():
        by = sorted((-vocabulary[v], v) for v in vocabulary if near(w, v))
        form[w] = by[0][1] if by and -by[0][0] >= 10 * k else None
        want[w] = (k, len(by), form[w], vocabulary.get(form[w]))
    for w in want:
        top = w
        while form[top]:
            top = form[top]
        want[w] += (top,)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, piece=piece).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 20
    if piece == 3:
        assert spelling.variants(empty).count() == 0


def test_spelling_roots_chain(spark):
    from tracklens.llm import spelling
    from tracklens.llm.common import Scratch

    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(18)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, Scratch(spark, "roots")).collect()} == {"w18"}


def test_trie_pairs_deep():
    from tracklens.llm import spelling

    long = "x" * 5000
    assert {(a, b) for a, _, b, _ in spelling.trie_pairs([(long, 1), (long + "y", 2), (long[1:], 3)], 0)} == {(long, long + "y"), (long + "y", long), (long, long[1:]), (long[1:], long)}


def soup(k, body, extra=""):
    return f"""<html><body class="home"><div class="top"><a href=/>Home</a> <a href=/a>About us</a></div>
<div id="wrap"><h1>Title {k}</h1><div class="story"><p>{body}<p>Second &lt;part&gt; of {k}: {"word " * 30}</div><div class="more">Follow our news every day for free and win</div></div>
<div class="sidebar"><p>Latest {k}</div>{extra}<div class="legal">All rights reserved by Example Media Group Limited</div></body>"""


def test_extraction(spark):
    from tracklens.llm import extraction

    rows = [(k, f"https://Soup.example/{k}", soup(k, f"Body&nbsp;of\n {k} &amp; more", '<div class="cookie-notice">We use cookies</div>' * (k % 2))) for k in range(8)]
    soups = {k: f"Title {k}\n\nBody of {k} & more\n\nSecond <part> of {k}: " + " ".join(["word"] * 30) for k in range(8)}
    article = "<nav><a>Menu</a></nav><article><header><h1>T</h1></header><p>One <b>bold<br>line<p>a < b<script>var x='</p>'</script><form>mail</form><div class=comments><p>me too</div></article><footer>f</footer><p>loose"
    rows += [(20, "https://one.example/", article), (21, None, None), (22, "no url", ""), (23, "https://one.example/", article), (24, "https://odd.example", "<p>Cut off <a href='x"), (25, None, "plain &eacute;\r\n text")]
    want = soups | {20: "T\n\nOne bold line\n\na < b", 21: "", 22: "", 23: "T\n\nOne bold line\n\na < b", 24: "Cut off", 25: "plain é text"}
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, page int").repartition(4)
    got = extraction.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(pages.where("page_id < 0")).count() == 0


def test_extraction_without_broadcast(spark, monkeypatch):
    """Equal rows if templates are joined by a shuffle, with most pages on one host."""
    from tracklens.llm import extraction, native

    rows = [(k, f"https://{'hot' if k % 3 else k}.example/{k}", soup(k, f"Body {k}")) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    want = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(native, "SPLIT", 32)
    assert {r.page_id: r.text for r in extraction.extract(pages).collect()} == want
    assert all(f"Body {k}\n\nSecond" in t and "Home" not in t for k, t in want.items())


def test_template_classes_must_nest():
    """A class whose tokens lie in several slots of a more frequent one, or in another order, is not valid."""
    from tracklens.llm import extraction

    tokens = [{"id": i, "class": c, "n": n, "kind": 0, "up": 0} for i, c, n in [(1, 10, 9), (2, 10, 9), (3, 20, 6), (4, 20, 6)]]
    run = lambda ids: {r[2]: (r[3], r[4]) for r in extraction._check("h", tokens, ids, [0] * 4, [0] * 4, [0] * 4, [0] * 4)}
    assert run([1, 3, 4, 2])[20][1] and not run([3, 1, 4, 2])[20][1]
    assert run([1, 3, 4, 2])[20][0] != run([1, 4, 3, 2])[20][0]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words of a test item that nobody else has at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_near_duplicates_keep_nameless_texts_once(spark, tmp_path):
    import corpus_pipeline

    a, b = text(random.Random(1), 60), text(random.Random(2), 60)
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted([(False, 1, a), (True, 0, b), (True, 0, "")])
