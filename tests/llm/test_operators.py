"""Every operator on small tables with awkward rows, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, place string, `_at` int"
STOP = "the of and to in is that it for on was as".split()


def prose(rng, n, stops=0.3):
    return [rng.choice(STOP) if rng.random() < stops else "".join(rng.choice(["er", "an", "th", "on", "ti", "re", "sh", "ble"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = "edit" + str(rng.randrange(10**6))
    return out


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): null and blank texts, copies, near copies, shared passages, a long text, repeated rows, a null id."""
    rng = random.Random(11)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "one TWO")]
    base = prose(rng, 120)
    for i in range(10, 40):
        rows.append((i, " ".join(near(rng, base, rng.randrange(0, 4)))))
    passage = prose(rng, 70)
    for i in range(40, 50):
        rows.append((i, " ".join(prose(rng, 60) + passage + prose(rng, rng.randrange(0, 60)))))
    for i in range(50, 60):
        rows.append((i, "\n".join(" ".join(prose(rng, 15)) for _ in range(5))))
    rows += [(60, rows[20][1]), (61, rows[20][1]), (62, "Ünï " + " ".join(prose(rng, 20_000))), (63, rows[50][1]), (63, rows[50][1]), (None, rows[50][1]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", 1) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *cols):
    return sorted(((r.doc_id, *(r[c] for c in cols)) for r in df.collect()), key=repr)


def test_quality_rules(docs, empty, corpus):
    from tracklens.llm import quality_rules as q

    led = q.verdicts(q.ledger(docs)).cache()
    want = []
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))))
    assert by_row(led, "n_words", "word_chars", "n_symbols", "n_dup_lines") == sorted(want, key=repr)
    assert all(not r.kept for r in led.where("n_words < 10").collect())
    total = led.count()
    kept = led.where("kept").count()
    rows = q.ablation(led).collect()
    assert {r.rule for r in rows} == set(q.BIT) and all(kept <= r.n_kept_without <= total and r.n_kept_without - kept == r.n_only for r in rows)
    assert q.ledger(empty).count() == 0


def test_license_scan(spark, docs, empty):
    from tracklens.llm import licenses

    more = spark.createDataFrame([(900, "Released under the MIT License."), (901, "gnu general public license gnu general public license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert (got[900].base_labels, got[900].labels, got[900].first_word, got[901].n_base, got[901].last_word) == ("mit", "mit,mit-license", 3, 2, 4)
    assert got[0].n_words == 0 and got[62].n_words == 20_001 and got[10].labels == ""
    assert licenses.scan(empty).count() == 0


def test_token_ids(docs, empty, corpus, tmp_path):
    from tokenizers import Tokenizer

    from tracklens.llm import tokens

    path = tokens.public_vocabulary()
    lib = Tokenizer.from_file(path)
    got = sorted(tokens.read_ids(tokens.write_ids(docs, str(tmp_path / "ids"), path, end_id=2)).collect(), key=lambda r: r.start)
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    again = tokens.open_ids(docs.sparkSession, str(tmp_path / "ids"))
    assert again.agg({"n_docs": "sum"}).first()[0] == len(corpus)
    assert tokens.read_ids(tokens.write_ids(empty, str(tmp_path / "none"), path, end_id=2)).count() == 0


def test_token_ids_are_read_by_select(monkeypatch):
    """Every boundary and doc_id comes from select; one that is off by one is seen."""
    from tracklens.llm import tokens

    ef = lambda *v: tokens.EliasFano.build(np.array(v, np.uint64)).to_bytes()
    record = tokens.Record(1, -7, ef(0, 5, 5, 900), ef(0, 1, 4, 4, 9, 10), 2, np.arange(10, dtype="<u2").tobytes())
    assert [record.doc_id(k) for k in range(len(record))] == [None, -7, -2, -2, 893]
    assert [record.span(k) for k in range(len(record))] == [(0, 1), (1, 4), (4, 4), (4, 9), (9, 10)]
    assert [list(record.find(i)) for i in (-7, -2, 893, -8, 0, 1000)] == [[1], [2, 3], [4], [], [], []]
    select = tokens.EliasFano.select
    monkeypatch.setattr(tokens.EliasFano, "select", lambda self, i: select(self, i) + 1)
    assert record.span(1) == (2, 5) and record.doc_id(1) == -6


def test_packing(docs, empty, corpus):
    """Pieces are the library's ids of each row, cut at the capacity; bins are gapless and nearly as few as can be."""
    from tokenizers import Tokenizer

    from tracklens.llm import packing, tokens

    lib = Tokenizer.from_file(tokens.public_vocabulary())
    got = packing.pack_documents(docs, tokens.public_vocabulary(), capacity=512, keep_ids=True).collect()
    want = []
    for i, t in corpus:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want += [(i, p, at, np.array(ids[at : at + 512], "<u4").tobytes()) for p, at in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    bins: dict[int, list] = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 512 + 1
    assert packing.pack_documents(empty, tokens.public_vocabulary()).count() == 0


def brute_substrings(rows, n):
    """Words kept of each row."""
    words = [(i, (t or "").split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - n + 1) if i is not None else ():
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_anchors": 50}])
def test_substring_dedup(docs, empty, corpus, options):
    from tracklens.llm import substrings

    got = substrings.dedup(docs, n=50, keep=["lang", "n_words"], **options)
    assert by_row(got.select("doc_id", *(c for c in ("n_removed", "kept_sha256"))), "n_removed", "kept_sha256") == sorted(((i, c, d) for i, _, c, d in brute_substrings(corpus, 50)), key=repr)
    if not options:
        assert substrings.dedup(empty).count() == 0


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[k : k + n]) for k in range(len(w) - n + 1)))))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, corpus, n, num, monkeypatch):
    from tracklens.llm import jaccard

    monkeypatch.setattr(jaccard, "SHORT", 3)  # so that long lists, leaders and differences have work here
    assert by_row(jaccard.near_duplicates(docs, n, num, 100), "n_shingles", "component_id") == brute_components(corpus, n, num, 100)
    if n == 3:
        assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_join_of_large_groups_stays_linear(spark, monkeypatch):
    """Two families of 400 different near copies each, which share passages but do not link: pairs grow with the members, not their product."""
    from tracklens.llm import jaccard, native

    rng = random.Random(21)
    shared, rows = prose(rng, 60), []
    for f in range(2):
        base = shared + prose(rng, 60)
        for i in range(400):
            w = list(base)
            w[rng.randrange(60, 120)] = f"edit{i}"
            rows.append((1000 * f + i, " ".join(w)))
    rows += [(5000 + i, rows[7][1]) for i in range(300)]
    monkeypatch.setattr(native, "SPLIT", 40)  # so that joins have parts here
    seen = []
    verified = jaccard.Join.verified
    monkeypatch.setattr(jaccard.Join, "verified", lambda self, pairs, *a: seen.append(pairs.count()) or verified(self, pairs, *a))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n=3, num=90, den=100).collect()
    want = {i: 0 if i < 1000 or i >= 5000 else 1000 for i, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert sum(seen) < 40 * 800


def test_decontamination(spark, docs, empty, corpus):
    from tracklens.llm import decontamination as d

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = dict(corpus)
    items = [(1, " ".join(texts[12].split()[20:45]).upper()), (2, "one two"), (3, None), (4, "ünï " + " ".join(texts[62].split()[1:11])), (5, ", ".join(texts[45].split()[70:80])), (5, "one two"), (6, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontaminate(docs, bench)
    want = []
    for i, t in corpus:
        w, hit, names = words(t), set(), set()
        for item, s in items:
            k = words(s)
            for g in [k[a : a + 10] for a in range(max(1, len(k) - 9))] if k else []:
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        names.add(str(item))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(got, *cols) == sorted(want, key=repr) and any(x[2] for x in want)
    assert d.decontaminate(empty, bench).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_proximity(spark):
    """All words of a window, as often as it has them, within len + slop words: against every span of every text."""
    from tracklens.llm import decontamination as d

    rng = random.Random(3)
    rows, items = [], [(1, "a b c a d e"), (2, "k l"), (3, "z")]
    for i in range(60):
        w = rng.choices("a b c d e k l x y".split(), [2, 1, 1, 1, 1, 0.4, 0.4, 4, 4], k=rng.randrange(0, 40))
        rows.append((i, " ".join(w + ["z"] * (i == 7))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n, slop in ((4, 2), (10, 0)):
        want = {}
        for i, t in rows:
            w = t.split()
            for item, s in items:
                k = s.split()
                for g in [k[a : a + n] for a in range(max(1, len(k) - n + 1))]:
                    spans = [w[p : p + len(g) + slop] for p in range(len(w))]
                    if any(all(x.count(y) >= g.count(y) for y in g) for x in spans):
                        want.setdefault(i, set()).add(str(item))
        got = d.decontaminate(docs, bench, n=n, slop=slop)
        assert {r.doc_id: set(r.near_items) for r in got.collect() if r.n_near} == want and len(want) > 2
        assert got.where("size(array_except(items, near_items)) > 0").count() == 0


def test_ids_of_single_documents(docs, corpus, tmp_path):
    from tokenizers import Tokenizer

    from tracklens.llm import tokens

    path = tokens.public_vocabulary()
    lib = Tokenizer.from_file(path)
    store = tokens.write_ids(docs, str(tmp_path / "ids"), path, end_id=2)
    want = sorted((i, [*lib.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in corpus if i in (0, 20, 62, 63))
    assert sorted((r.doc_id, r.ids) for r in tokens.ids_of(store, [63, 0, 62, 20, 12345]).collect()) == want


def test_null_ids_count_distinct_shingles(spark):
    from tracklens.llm import jaccard

    rows = [(None, "a b c d e f " * 4), (None, "one"), (None, None), (1, "a b c d e f " * 4)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == [(0, 0), (0, 1), (0, 6), (1, 6)]
    assert all(r.component_id == r.doc_id for r in got)


def test_url_filter(spark):
    from tracklens.llm import url_filter as u

    urls = ["http://www.Example.com/en/1", "https://a.example.com/en/x?q", "https://b.net/es/", "https://b.net/es", "ftp://h.org/bad/", "http://www.h.org/bad", "http://h.org/good", None, "nonsense", "http://com", "http://", "x://net?/es/"]
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://h.org/bad#x",), (None,), ("",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, listed).collect()}
    assert got == {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("b.net", "/es/", "net/es/", "block"), 3: ("b.net", "/es", None, "allow"),
                   4: ("h.org", "/bad/", None, "block"), 5: ("www.h.org", "/bad", None, "block"), 6: ("h.org", "/good", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("com", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("net", "", None, "allow")}
    assert u.judge(pages, listed.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert u.judge(pages.limit(0), listed).count() == 0


def test_toxicity(spark, docs, empty):
    from tracklens.llm import toxicity as t

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1000, 1400):
        bad = i % 4 == 0
        w = prose(rng, 60)
        if bad:
            w[rng.randrange(60)] = rng.choice(["awfulword", "nastyword"]) + rng.choice(["", "!", "s"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = t.toxicity(both, lab).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    test = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out and r.doc_id >= 1000]
    assert sum(a == b for a, b in test) / len(test) > 0.95
    assert any(r.evidence for r in got if r.predicted)
    assert t.toxicity(empty, lab).count() == 0
    assert all(r.predicted == 0 for r in t.toxicity(docs, lab.limit(0)).collect())


def test_toxicity_of_rare_words(spark):
    """Each toxic word is in a few examples only; texts that have no other one are found and have evidence."""
    from tracklens.llm import toxicity as t

    rng = random.Random(19)
    rows = []
    for i in range(400):
        w = prose(rng, 60)
        if i % 4 == 0:
            w[rng.randrange(60)] = "zq" + "abcdefghijklmnop"[i // 4 % 16] * 4
        rows.append((i, " ".join(w)))
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = [r for r in t.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect() if r.held_out]
    assert all(r.evidence for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) / len(got) > 0.9
    assert sum(r.predicted for r in got) > 10


def test_toxicity_evidence_equals_brute_force(spark):
    """Neighbours, similarities and ties of whole texts, from TF-IDF vectors made here."""
    from collections import Counter

    from tracklens.llm import toxicity as t
    from tracklens.llm.common import Scratch

    rng = random.Random(23)
    rows = [(i, " ".join(prose(rng, 40, 0.5) + ["vile"] * (i % 5 == 0))) for i in range(150)]
    rows += [(200 + i, rows[3 + i % 2][1]) for i in range(6)] + [(300, None), (301, "1 2 3"), (302, rows[0][1]), (302, rows[1][1])]
    lab = [(i, int(i % 5 == 0)) for i, _ in rows if i < 210] * 2
    docs = spark.createDataFrame([(i, x, "x") for i, x in rows], "doc_id long, text string, evidence string").repartition(3)
    model, vocabulary = t.fit(docs, spark.createDataFrame(lab, "doc_id long, toxic int"), Scratch(spark, "t"))
    terms = lambda x: Counter(y for w in (x or "").split() for y in t.terms_of(w))
    known = {i: terms(x) for i, x in rows if i < 210 and zlib.crc32(str(i).encode()) % 5}
    assert set(vocabulary) == {y for n in known.values() for y in n} and model.ids.tolist() == sorted(known)
    df = Counter(y for _, x in rows for y in set(terms(x)))
    a, b = (Counter(y for i, n in known.items() if int(i % 5 == 0) == c for y in n) for c in (1, 0))
    pos = sum(i % 5 == 0 for i in known)
    weight = {y: (np.log((len(rows) + 1) / (df[y] + 1)) + 1) * t.relevance(np.array([a[y]]), np.array([b[y]]), pos, len(known) - pos)[0] for y in vocabulary}

    def vector(n):
        v = {y: (1 + np.log(c)) * weight[y] for y, c in n.items() if y in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {y: x / size for y, x in v.items()}

    index = {i: vector(n) for i, n in known.items()}
    texts = dict(rows)
    got = t.scores(docs, model, vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id >= 300:
            assert r.doc_id == 302 or (r.evidence == [] and abs(model.empty - r.score) < 1e-5)
            continue
        q = vector(terms(texts[r.doc_id]))
        best = sorted(((-round(sum(x * v.get(y, 0) for y, x in q.items()), 6), i) for i, v in index.items()))[: t.K]
        assert np.allclose([e.similarity for e in r.evidence], [-x for x, _ in best], atol=2e-6)
        assert all(abs(sum(x * index[e.doc_id].get(y, 0) for y, x in q.items()) - e.similarity) < 2e-6 for e in r.evidence)
        near = [e.doc_id for e in r.evidence if e.similarity > 1 - 1e-6]
        assert near == sorted(near) and (not 200 <= r.doc_id < 206 or set(near) >= {i for i in index if i >= 200 and i % 2 == r.doc_id % 2})


def test_quality_classifier(spark, docs, empty):
    from tracklens.llm import quality_classifier as q

    rng = random.Random(8)
    rows = []
    for i in range(2000, 2300):
        w = prose(rng, 80)
        kind = i % 10
        w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "***" for x in w] if kind == 1 else [w[0]] * 80 if kind == 2 else w
        rows.append((i, " ".join(w)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.kept): r.score for r in q.classify(both).collect()}
    assert all((i, i % 10 > 2) in got for i in range(2000, 2300))
    assert got[0, False] == got[1, False] == got[2, False] == 0.0 and (62, True) in got
    assert q.classify(empty).count() == 0


def test_pipeline_rows_without_doc_id_and_repeated_rows(spark, corpus, tmp_path):
    """Every stage on the awkward rows: one row of a group, copies without doc_id too; null and blank texts are rejected."""
    import corpus_pipeline as p

    rng = random.Random(31)
    a, b, c, d = (" ".join(prose(rng, 90)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, c), (None, d), (None, d), (None, None), (5, None), (6, " \t"), *corpus]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_words int")
    bench = spark.createDataFrame([(1, " ".join(c.split()[10:30])), (None, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    fine = p.quality(spark, docs, str(tmp_path))
    assert fine.columns == p.COLUMNS and fine.where("text IS NULL OR trim(text) = ''").count() == 0
    own = docs.where("doc_id IS NULL OR doc_id < 4 OR doc_id IN (5, 6)").limit(11)
    got = sorted(((r.doc_id, r.text) for r in p.near_duplicates(spark, own, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (3, c), (None, d), (None, None), (5, None), (6, " \t")], key=repr)
    left = p.decontaminate(spark, own, str(tmp_path))
    assert sorted((r.doc_id or 0 for r in left.collect())) == sorted(i or 0 for i, t in rows[:11] if t != c)
    packed = p.pack(spark, docs, str(tmp_path))
    assert packed.select("doc_id", "piece", "offset", "sequence_id").distinct().count() == packed.count() >= len(rows)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_classifier_agrees_with_labels(spark):
    """On the labelled rows of the test tables, which training never sees; equal rows get equal scores."""
    import os

    from tracklens.llm import quality_classifier as q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = q.classify(docs.unionByName(docs)).distinct()
    assert got.count() == docs.select("doc_id").distinct().count()
    rows = got.join(labels.where("quality IS NOT NULL"), "doc_id").select("kept", "quality").collect()
    assert len(rows) > 30 and sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95


def test_pipeline_stages(spark, tmp_path, corpus):
    """run() against the stages' brute-force versions: which documents stay, and which words of them."""
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus if i is not None and i < 62] + [(200 + i, " ".join(prose(rng, 90)), "en", "s", 1) for i in range(30)]
    rows += [(300 + i, " ".join(x.upper() + "!!" for x in prose(rng, 60)), "en", "s", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bench = " ".join(rows[-20][1].split()[5:25])
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(corpus_pipeline.public_vocabulary())
    left = [r.asDict() for r in corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()]
    assert {r["doc_id"] for r in left} >= {r[0] for r in rows if 200 <= r[0] < 230} and not any(300 <= r["doc_id"] < 320 for r in left)
    kept = [(r["doc_id"], r["text"]) for r in left]
    kept = [(i, t) for (i, t), c in ((x, next(c for j, _, c in brute_components(kept, 5, 80, 100) if j == x[0])) for x in kept) if c == i]
    gone = {i: (n, d) for i, _, n, d in brute_substrings(kept, 50)}
    hashes = {i: d for i, (n, d) in gone.items()}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
    after = {r.doc_id: r.text for r in docs.collect()}
    assert set(after) == set(hashes)
    assert all(hashlib.sha256(" ".join(t.split()).encode()).hexdigest() == hashes[i] for i, t in after.items())
    clean = {i for i, t in after.items() if bench not in " ".join(t.split())}
    assert len(clean) == len(after) - 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == clean
    assert sum(r.length for r in got) == sum(len(lib.encode(after[i], add_special_tokens=False).ids) + 1 for i in clean)


def test_url_filter_hits_false_positives_and_big_lists(spark, monkeypatch):
    """A filter of one block passes nearly everything; the exact join then decides, broadcast or shuffled."""
    from pyspark.sql import functions as F

    from tracklens.llm import url_filter as u

    urls = [f"http://{w}h{i % 7}.org/p/{i}{tail}" for i in range(60) for w, tail in (("", ""), ("www.", "/"), ("m.", ".html?x"))] + ["http://H1.org/p/1", None, None, "http://h1.org/" + "x" * 50_000]
    pages = spark.createDataFrame([(i // 2, x, "v") for i, x in enumerate(urls)], "page_id long, url string, verdict string")
    bad = {f"h{i % 7}.org/p/{i}" for i in range(0, 60, 3)}
    listed = spark.createDataFrame([(f"https://www.{x}/#y",) for x in sorted(bad)] * 2 + [("http://h1.org/" + "x" * 50_000,)], "url string")
    want = sorted("block" if x and (f"h{i // 3 % 7}.org/p/{i // 3}" in bad or i >= 183) and i not in (180,) else "allow" for i, x in enumerate(urls))
    monkeypatch.setattr(u, "bloom_blocks", lambda n: 1)
    keys = listed.select(u.canonical(u.host(F.col("url")), u.path(F.col("url"))).alias("k"))
    own = pages.select(u.canonical(u.host(F.col("url")), u.path(F.col("url"))).alias("k"))
    false = u.possible_hits(own, "k", u.bloom(keys, "k", 1), 1).where("_maybe").join(keys, "k", "left_anti").count()
    assert false > 0
    for limit in (u.BROADCAST_BYTES, 0):
        monkeypatch.setattr(u, "BROADCAST_BYTES", limit)
        assert sorted(r.verdict for r in u.judge(pages, listed).collect()) == want


def test_quality_classifier_against_brute_force(spark):
    """Votes, EM and scorer again, document by document and without the operator's code for them."""
    import math

    from tracklens.llm import quality_classifier as q

    rng = random.Random(11)
    nouns = "house river green table stone night paper winter market bridge".split()
    fine = [" ".join(rng.choice([*"the of and to in is".split(), *nouns]) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(5, 160))) for _ in range(60)]
    junk = [rng.choice([lambda: "BUY NOW!! " * rng.randrange(3, 30), lambda: "a|b | c|" * rng.randrange(4, 40), lambda: "same line here\n" * rng.randrange(4, 60), lambda: "x " * rng.randrange(10, 90), lambda: "$$% ## ** " * 20])() for _ in range(40)]
    text = [*fine, *junk, "", " \n\t", None, "A", "é" * 3000, fine[0]]
    ids = [*range(len(text) - 1), 0]  # one doc_id twice: its smallest text is learnt from
    table = spark.createDataFrame(list(zip(ids, text, ["k"] * len(text), strict=True)), "doc_id long, text string, _score string").repartition(3)
    got = sorted((r.doc_id, r.score, r.kept) for r in q.classify(table).collect())

    def counted(t):
        words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        return {
            "n": len(words), "upper": sum("A" <= c <= "Z" for c in t), "letters": sum(c.isascii() and c.isalpha() for c in t), "symbols": sum(c in "#*$%&<>^~=" for c in t),
            "runs": sum(a == b for a, b in zip(words, words[1:])), "function": sum(w.encode() in q.FUNCTION_WORDS for w in words), "bars": t.count("|"), "loud": t.count("!!"), "kinds": len(set(words)), "lines": len(lines), "own": len(set(lines)), "words": words,
        }

    def ballot(c):
        n = c["n"]
        three = lambda x, bad, good: -1 if x > bad else 1 if x <= good else 0
        return (
            three(c["symbols"] / n, 0.2, 0.02), three(c["upper"] / max(1, c["letters"]), 0.3, 0.12), three(c["runs"] / n, 0.1, 0.02), three(c["bars"] / n, 0.1, 0.01), three(c["loud"] / n, 0.1, 0),
            0 if n < 20 else -1 if c["function"] / n < 0.04 else 1 if c["function"] / n >= 0.12 else 0,
            0 if c["lines"] < 4 else three(1 - c["own"] / c["lines"], 0.4, 0.1),
            0 if n < 50 else -1 if c["kinds"] / n**0.8 < 0.6 else 1 if c["kinds"] / n**0.8 >= 1 else 0,
        )

    full = [counted(t) for t in text if t and t.strip()]
    ballots = [ballot(c) for c in full]
    good = [0.1 if (v.count(-1) >= 2 or v.count(-1) * 2 > v.count(1)) and v.count(-1) else 0.9 for v in ballots]
    for _ in range(q.ROUNDS):
        share = (sum(good) + 1) / (len(good) + 2)
        rate = {}
        for k in range(len(q.LABELLERS)):
            for c in (0, 1):
                n = {x: 0.5 + sum((g if c else 1 - g) for g, v in zip(good, ballots, strict=True) if v[k] == x) for x in (-1, 1)}
                rate |= {(k, c, x): n[x] / (n[-1] + n[1]) for x in (-1, 1)}
        log = lambda v, c: math.log(share if c else 1 - share) + sum(math.log(rate[k, c, x]) for k, x in enumerate(v) if x)
        good = [1 / (1 + math.exp(max(-50, min(50, log(v, 0) - log(v, 1))))) for v in ballots]
    posterior = dict(zip(ballots, good, strict=True))

    def vector(t):
        c, x = counted(t), np.zeros(q.DIMS)
        n = c["n"]
        for w in c["words"]:
            shape = re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", w)))[:12]
            x[zlib.crc32(b"function" if w.encode() in q.FUNCTION_WORDS else shape.encode()) % (q.DIMS - 8)] += 1 / n
        x[-8:] = [c["runs"] / n, max(0, 1 - c["kinds"] / n**0.8), c["upper"] / max(1, c["letters"]), min(1, c["symbols"] / n), min(1, c["bars"] / n), 1 - c["own"] / c["lines"], 1 / n, 1]
        return np.sqrt(x)

    learnt = {}
    for i, t in zip(ids, text, strict=True):
        if t is not None and (i not in learnt or t < learnt[i]):
            learnt[i] = t
    learnt = [t for t in learnt.values() if t.strip()]
    x, y = np.array([vector(t) for t in learnt]), np.array([posterior[ballot(counted(t))] for t in learnt])
    w, m, v = np.zeros(q.DIMS), np.zeros(q.DIMS), np.zeros(q.DIMS)
    for step in range(1, 401):
        g = sum((1 / (1 + np.exp(-np.clip(a @ w, -30, 30))) - b) * a for a, b in zip(x, y, strict=True)) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    want = sorted((i, float(1 / (1 + np.exp(-vector(t) @ w))) if t and t.strip() else 0.0) for i, t in zip(ids, text, strict=True))
    assert [i for i, _, _ in got] == [i for i, _ in want]
    # the operator computes in single precision
    assert max(abs(a - b) for (_, a, _), (_, b) in zip(got, want, strict=True)) < 0.01
    assert all(kept == (score >= 0.5) for _, score, kept in got)
    assert sum(k for i, _, k in got if i < 60) >= 58 and not any(k for i, _, k in got if 60 <= i < 100)


def test_single_windows_stay_out_of_the_join(spark, monkeypatch):
    """op5: windows of repeated anchors that only one document has are filtered before the join's shuffle."""
    from tracklens.llm import substrings
    from tracklens.llm.common import Scratch

    shared = [f"s{i}" for i in range(45)]  # an anchor in common, never a whole window
    docs = spark.createDataFrame([(k, " ".join([*(f"a{k}_{i}" for i in range(200)), *shared, *(f"b{k}_{i}" for i in range(200))])) for k in range(20)] + [(90, " ".join(f"x{i}" for i in range(60))), (91, " ".join(f"x{i}" for i in range(60)))], "doc_id long, text string").repartition(22)
    kept, plain = [], substrings.possible_hits

    def counted(rows, column, *more):
        out = plain(rows, column, *more)
        if column == "h1":
            kept.append((rows.count(), out.where("_maybe").count()))
        return out

    monkeypatch.setattr(substrings, "possible_hits", counted)
    got = substrings.repeated_windows(docs, Scratch(spark, "single-windows")).collect()
    assert {(r.doc_id, r["at"]) for r in got} == {(91, i) for i in range(11)}
    assert len(kept) == 1 and kept[0][1] < 40 < 100 < kept[0][0]


def test_heap_is_freed_as_it_grows(spark, monkeypatch):
    """pipeline: what jobs leave in the driver is given back before it piles up, and not after every table."""
    from tracklens.llm.common import HEAP_GROWTH, Scratch

    heap, freed = [0], []
    scratch = Scratch(spark, "heap")
    monkeypatch.setattr(Scratch, "_held", 0)
    monkeypatch.setattr(Scratch, "_heap", lambda self: heap[0])
    monkeypatch.setattr(Scratch, "free", lambda self: freed.append(heap[0]) or setattr(Scratch, "_held", heap[0]))
    for k in range(6):
        heap[0] += HEAP_GROWTH // 2 + 1
        scratch.table(spark.range(1), f"t{k}")
    assert len(freed) == 3
    scratch.drop()
