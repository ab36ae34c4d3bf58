"""The parts that need no session, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracklens.llm import jaccard, licenses, packing, quality_classifier, quality_rules, substrings, tokens, toxicity
from tracklens.llm.common import FOLD, alnum_words, space_words


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], [0, 1, 10**12], list(range(0, 5000, 7)), sorted(random.Random(1).choices(range(10**6), k=3000))])
def test_elias_fano_round_trip(values):
    ef = tokens.EliasFano.from_bytes(tokens.EliasFano.build(np.array(values, np.int64)).to_bytes())
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 13)] == values[::13]


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 20, 4000))
    assert len(tokens.EliasFano.build(values).to_bytes()) < 4000 * (2 + 8 + 2) / 8 + 300


def test_word_ids_equal_the_library():
    path = tokens.public_vocabulary()
    enc = tokens.encoder(path)
    rng = random.Random(4)
    odd = ["", " ", "\x1c a\x1db", "don't we'LL IT'S", "a b c\x85d\u3000e", "İstanbul ΑΣ ς", "é e\u0301 ﬁ ½ ²", "<|endoftext|> x<|startoftext|>y", "日本語 text 한국어", "a\x00b\x7f", "x" * 500, "'s't'", "Ünïcödé—dash…", "\u200b\ufeffzero", "1234 5.6", "👩‍👩‍👧 ok", "ǅ Ǆ ŉ ẞ"]
    odd += ["".join(rng.choice("abcXYZ é'ñ.,!#1 2\n\tß|") for _ in range(200)) for _ in range(40)]
    for text in odd:
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want, text


def place(counts, capacity):
    p = packing.plan(counts, capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        entries, rank = p.by_length[length], 0
        for k, (first, slots, bin_, places) in enumerate(entries):
            last = entries[k + 1][0] if k + 1 < len(entries) else n
            assert first == rank
            for r in range(first, last):
                bins.setdefault(bin_ + (r - first) // slots, []).append((places[(r - first) % slots], length))
            rank = last
        assert rank == n
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == p.n_bins
    return p.n_bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_valid_and_tight(seed):
    rng = random.Random(seed)
    counts = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(3000))
    n = place(dict(counts), 100)
    low = -(-sum(k * v for k, v in counts.items()) // 100)
    assert n <= low * 1.02 + 1


def test_packing_swaps_the_smallest_for_a_better_pair():
    # greedy: 60 + 30, gap 10; the pair 22 + 18 fits the gap of 40 exactly
    assert packing._Counts({22: 1, 18: 1}, 100).best_pair(40, 30) in {(22, 18), (18, 22)}
    assert place({60: 1, 30: 1, 22: 1, 18: 1, 70: 1}, 100) == 2
    assert place({}, 100) == 0 and place({100: 3}, 100) == 3 and place({1: 250}, 100) == 3


def test_repeated_words_against_brute_force():
    rng = random.Random(2)
    docs = [[rng.choice(b"a b c d".split()) for _ in range(rng.randrange(0, 60))] for _ in range(60)] + [[], [b"x"] * 4, [b"x"] * 6]

    def brute(w):
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({i + j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(5)})

    assert quality_rules.repeated_word_counts(docs).tolist() == [brute(w) for w in docs]


def test_runs_and_anchors_depend_on_words_alone():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 90).astype(np.uint64), rng.integers(0, 1 << 63, 80).astype(np.uint64)
    b[20:75] = a[30:85]
    for n in (1, 2, 5, 20, 50):
        assert len(substrings._runs(a, n, substrings._P)) == 91 - n
        if n <= 50:
            assert (substrings._runs(a, n, substrings._P)[30 : 30 + 56 - n] == substrings._runs(b, n, substrings._P)[20 : 20 + 56 - n]).all()
    assert set(substrings._anchors(a, 50, 20)[30:36]) == set(substrings._anchors(b, 50, 20)[20:26])
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for w in (1, 2, 3, 7, 31):
        assert substrings._sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(41 - w)]


def test_sketch_never_underestimates():
    """Partial counts of batches, dealt to shards and added there: every anchor of two documents is found, few others are."""
    rng = np.random.default_rng(1)
    anchors = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64))[:5000]
    rng.shuffle(anchors)
    batches = [(np.concatenate([anchors[:2000], anchors[:100]]), np.concatenate([np.zeros(2000), np.ones(100)])), (anchors[1900:4000], np.full(2100, 2)), (anchors[4000:], np.full(1000, 3))]
    single, twice, known = [], [], set()
    for a, doc in batches:
        alone, others, both = substrings.partial_counts(a, doc)
        single.append(a[alone])
        twice.append(both)
        known |= set(a[others].tolist())
    assert known == set(anchors[:100].tolist()) == set(np.concatenate(twice).tolist())
    single = np.concatenate(single)
    on = substrings.merged_repeats(single, np.concatenate(twice))
    assert set(anchors[1900:2000].tolist()) <= set(single[on].tolist()) and on.mean() < 0.1
    assert substrings.merged_repeats(anchors[:5], anchors[3:8]).tolist() == [False, False, False, True, True]


def test_windows_known_within_a_batch():
    h1, h2, doc = np.array([5, 7, 5, 5, 7, 9, 9], np.uint64), np.array([1, 2, 1, 8, 2, 3, 3], np.uint64), np.array([1, 1, 2, 2, 3, 4, 4])
    assert substrings.known_later(h1, h2, doc).tolist() == [False, False, True, False, True, False, False]


def test_residual_prefixes_find_every_linked_pair():
    rng = random.Random(7)
    num, den = 80, 100
    for _ in range(300):
        leader = set(rng.sample(range(200), 40))

        def variant(base, k):
            out = set(base)
            for _ in range(k):
                out.discard(rng.choice(sorted(out)))
                out.add(rng.randrange(200, 10_000))
            return out

        x = variant(leader, rng.randrange(3, 12))
        y = variant(x, rng.randrange(0, 4))
        link = lambda a, b: den * len(a & b) >= num * len(a | b)
        if not link(x, y) or link(x, leader) and link(y, leader):
            continue
        keys = [jaccard._difference_keys(np.array([*sorted(s - leader), *sorted(leader - s)], np.uint64), len(leader), len(s), link(s, leader), num, den) for s in (x, y)]
        if x == y:
            continue
        dx, dy = len(x ^ leader), len(y ^ leader)
        shared = max(1, -(-(dx + dy - (len(x) + len(y)) * (den - num) // (den + num)) // 2))
        k = [{n: set(v.tolist()[: d - shared + 1]) for n, v in e.items()} for e, d in zip(keys, (dx, dy), strict=True)]
        assert k[0]["uu"] & k[1]["uu"] or k[0]["ul"] & k[1]["lu"] or k[0]["lu"] & k[1]["ul"]


def test_postings_equal_brute_force():
    """The k nearest by block maxima, ties included, and blocks that are skipped on the way."""
    rng = np.random.default_rng(5)
    n, terms = 900, 1500  # more terms than have a row of weights
    v = rng.random((n, terms)) * (rng.random((n, terms)) < 0.02)
    v[np.arange(n), rng.integers(0, 40, n)] += 6.0  # families with a heavy term of their own
    v[500:520] = v[0]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    who, term = np.nonzero(v)
    m = toxicity.Model(np.ones(terms), np.arange(n), np.zeros(n, np.float32), toxicity.Postings.of(n, terms, term, who, v[who, term]), (np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.1)
    assert len(m.vectors.who) and (m.vectors.at >= 0).sum() == toxicity.DENSE_TERMS
    s = np.rint((v @ v.T) * 1e6)
    for out in (None, np.arange(n)):
        if out is not None:
            np.fill_diagonal(s, -1)
        best, near = m.closest([(np.flatnonzero(x), x[x > 0]) for x in v], out)
        assert m.vectors.scored < 0.5
        assert np.allclose(best * 1e6, -np.sort(-s, axis=1)[:, : toxicity.K], atol=1.5) and np.allclose(np.take_along_axis(s, near, 1), best * 1e6, atol=1.5)
    assert m.closest([(np.flatnonzero(v[0]), v[0][v[0] > 0])])[1][0].tolist() == [0, *range(500, 514)]
    few = toxicity.Postings.of(3, 4, np.array([0, 1, 2]), np.array([0, 1, 2]), np.ones(3))
    assert toxicity.Model(np.ones(4), np.arange(3), np.zeros(3, np.float32), few, m.knots, 0.1).closest([(np.array([1, 3]), np.array([0.6, 0.8]))])[1].tolist() == [[1, -1, -1]]


def test_no_term_is_left_out():
    a, b = (x.ravel() for x in np.meshgrid(np.arange(21), np.arange(181)))
    assert (toxicity.relevance(a, b, 20, 180) > 0).all()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(4)
    x = rng.random(500)
    at, value = toxicity.isotonic(x, (rng.random(500) < x).astype(float), np.ones(500))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and abs(np.interp(0.5, at, value) - 0.5) < 0.15


def test_em_recovers_planted_accuracies():
    rng = random.Random(5)
    n: Counter = Counter()
    truth = {}
    for _ in range(20_000):
        fine = rng.random() < 0.8
        v = [0 if rng.random() < 0.2 else (1 if (rng.random() < 0.9) == fine else -1) for _ in quality_classifier.LABELLERS]
        p = quality_classifier.pattern(v)
        n[p] += 1
        truth.setdefault(p, []).append(fine)
    posterior, rates, share = quality_classifier.em(n)
    assert abs(share - 0.8) < 0.02 and (abs(rates[:, 1, 2] - 0.9) < 0.03).all()
    right = sum((posterior[p] >= 0.5) == f for p, fs in truth.items() for f in fs)
    assert right / 20_000 > 0.97


def test_words_and_license_scan():
    assert alnum_words("Ab-C É_x٣") == ["ab".encode(), b"c", "É".encode(), "x٣".encode()]
    assert space_words("a\x0bb\x1cc d") == [b"a", b"b\x1cc", b"d"]
    ix = licenses.Index(1000, {b"license": 50, b"the": 900, b"mit": 100, b"apache": 20})
    n, k, first, last, base, labels, score, spans = ix.scan(b"x Licensed under the Apache License, Version 2.0. mit LICENSE")
    assert (n, k, first, last, base, labels, score) == (11, 2, 4, 9, "apache,mit", "apache,apache-2.0,mit", 1.0)
    assert ("apache-2.0", 1, 9) in spans
    assert ix.scan(b"apache. license version 3") [4:6] == ("apache", "apache")
    assert ix.scan(None) == (0, 0, None, None, "", "", 0.0, [])


def brute_license_scan(ix, text):
    """Every template at every start, by the definition."""
    words = text.translate(FOLD).split()
    base, labels, spans, score = [], set(), set(), 0.0
    for label, template, keys, is_base in ix.templates:
        if is_base:
            at = [s for s in range(len(words)) if tuple(words[s : s + len(template)]) == template]
            base += [(s, label) for s in at]
            spans |= {(label, s, s + len(template)) for s in at}
            labels |= {label for _ in at}
            score = max([score, *(1.0 for _ in at)])
            continue
        rare = sorted(set(template), key=lambda w: (-ix.idf[w], w))[: licenses.ANCHORS]
        for s in range(1 - len(template), len(words)):
            fits = [w for j, w in enumerate(template) if 0 <= s + j < len(words) and words[s + j] == w]
            share = sum(ix.idf[w] for w in fits) / sum(ix.idf[w] for w in template)
            around = b" " + b" ".join(words[max(0, s - licenses.SLACK) : max(0, s + len(template) + licenses.SLACK)]) + b" "
            if len(set(fits) & set(rare)) >= min(licenses.AGREE, len(rare)) and share >= licenses.MIN_SHARE and all(b" " + b" ".join(k) + b" " in around for k in keys):
                labels.add(label)
                spans.add((label, max(0, s), min(len(words), s + len(template))))
                score = max(score, min(1.0, share))
    at = [s for s, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, spans


def test_license_scan_equals_brute_force():
    rng = random.Random(6)
    df = {w: rng.randrange(1, 500) for w in licenses.VOCABULARY}
    ix = licenses.Index(1000, df)
    whole = [t for t, _ in licenses.TEMPLATES.values()] + [t.upper() for t in licenses.BASE]
    filler = [w.decode() for w in licenses.VOCABULARY] + ["foo", "bar", "baz"]
    found = set()
    for k in range(120):
        text = whole[k % len(whole)].split()
        for _ in range(rng.randrange(0, 6)):  # edits, some of which move the words behind them
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(0, 3)] = rng.choices(filler, k=rng.randrange(0, 2))
        text = (" ".join(rng.choices(filler, k=rng.randrange(20))) + " " + " ".join(text) + " " + rng.choice(whole) * (k % 3 == 0)).encode()
        *got, spans = ix.scan(text)
        *want, want_spans = brute_license_scan(ix, text)
        assert got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-9 and sorted(spans) == sorted(want_spans)
        found |= set(got[5].split(","))
    assert set(licenses.TEMPLATES) <= found


def test_license_scan_intersects_postings():
    """A start that a single anchor proposes does not survive."""
    ix = licenses.Index(1000, {})
    k = next(k for k, t in enumerate(ix.templates) if t[0] == "mit-text")
    a, b = list(ix.postings[k].items())[:2]
    assert ix.starts(k, {a[0]: [100]}) == [] and ix.starts(k, {a[0]: [100], b[0]: [0]}) == []
    assert ix.starts(k, {a[0]: [7 + a[1][0]], b[0]: [7 + b[1][0], 900]}) == [7]


def test_token_ids_look_a_word_up_once():
    """op8: encode_all gives encode()'s ids of each text and asks for a distinct word once, however often a batch has it."""
    from tracklens.llm.tokens import Encoder, public_vocabulary

    asked = []

    class Counting(Encoder):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    own, plain = Counting(public_vocabulary()), Encoder(public_vocabulary())
    rows = ["alpha Beta alpha beta, it's\n\n alpha", None, "", "  alpha Ñandú 42 <|endoftext|> 漢字 İx é\x85alpha ", "alpha " * 50]
    got = own.encode_all(pa.array(rows, pa.string()))
    assert got == [plain.encode(t) for t in rows]
    assert len(asked) == len(set(asked)) and "alpha" in asked
    rows.append("a\x1cb alpha")  # separators that the vocabulary does not know as white space
    assert own.encode_all(pa.array(rows, pa.string())) == [plain.encode(t) for t in rows]


def test_token_cache_keeps_what_is_asked_for(monkeypatch):
    """op8: a full cache drops the half that was not asked for, not all of it."""
    from tracklens.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 8)
    made = []

    class Upper(tokens._Cache):
        def make(self, key):
            made.append(key)
            return key.upper()

    cache = Upper()
    for i in range(40):
        assert cache["often"] == "OFTEN" and cache[f"w{i}"] == f"W{i}"
        assert len(cache) + len(cache.older) <= 8
    assert made.count("often") == 1


def test_terms_of_a_batch():
    """op1: terms of many texts at once, a distinct word looked up once."""
    from tracklens.llm.toxicity import TermIds, count_terms, terms_of

    words = ["fiddle", "Fiddlesticks", "bad", "bad-word", "ab"]
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in words for t in terms_of(w)}))}
    rows = ["bad Bad fiddlesticks bad-word", None, "", "none of these", " fiddle ab\nfiddle"]
    of, term, n = count_terms(TermIds(vocabulary), pa.array(rows, pa.string()))
    want = [(i, vocabulary[t], k) for i, x in enumerate(rows) for t, k in Counter(t for w in (x or "").split() for t in terms_of(w) if t in vocabulary).items()]
    assert list(zip(of.tolist(), term.tolist(), n.tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in count_terms(TermIds({}), pa.array(rows, pa.string()))] == [0, 0, 0]
    # every kind of letter, alone and between others, where Arrow does the work and where it does not
    each = [w for c in range(1, 0x500) for w in (f"ab{chr(c)}cdefg", chr(c)) if w.split() == [w]] + ["ΟΔΟΣ", "İstanbul", "x\x00yz"]
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in each for t in terms_of(w)}))}
    word, term = TermIds(vocabulary).of(pa.array(each))
    assert sorted(zip(word.tolist(), term.tolist(), strict=True)) == sorted((i, vocabulary[t]) for i, w in enumerate(each) for t in terms_of(w))
