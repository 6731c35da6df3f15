"""Whole queries against plain Python: language ID, quality classifier, packing's rule."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from lakeloom.llm import langid, packing, quality
from lakeloom.llm import queries as Q
from tests.llm.fixtures import documents, odd_rows, prose

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & MASK
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ (h >> 33)


# --- 6: language ID ---


def naive_grams(text):
    """The hashes of a text's n-grams, one character at a time."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(f"\0{word}\0")
            word = ""
    for w in words:
        for n in langid.ORDERS:
            for k in range(len(w) - n + 1):
                h = n
                for c in w[k : k + n]:
                    h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 & MASK
                yield mixed(h)


def naive_model(rows, ratio=0.5, least=3):
    """The n-grams of each language from rows (text, lang), without a filter."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        counts[lang].update(naive_grams(text))
    counts = {k: {g: n for g, n in c.items() if n >= least} for k, c in counts.items()}
    total = {k: sum(c.values()) for k, c in counts.items()}
    most = collections.Counter()
    for k, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[k])
    return {k: {g for g, n in c.items() if n / total[k] >= ratio * most[g]} for k, c in counts.items()}


def test_language_query_equals_plain_python(spark):
    """Learned n-grams and predictions, with sets for filters: filters only add false hits, which the scores correct."""
    docs = {i: (t, lang) for i, t, lang in duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()}
    taught = [x for i, x in docs.items() if zlib.crc32(str(i).encode()) % 3 != 1 and x[0] is not None and x[1] is not None]
    known = naive_model(taught)
    held = spark.createDataFrame([(i, *x) for i, x in docs.items() if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, text string, lang string")
    model = langid.fit(held)
    assert model.languages == sorted(known)
    for k, name in enumerate(model.languages):
        grams = np.array(sorted(known[name]), np.uint64)
        assert len(grams) > 200 and (model.masks(grams)[:, 0] >> np.uint64(k) & np.uint64(1)).all()  # none is missed
        other = np.array([mixed(x) for x in range(20_000)], np.uint64)
        assert abs((model.masks(other)[:, 0] >> np.uint64(k) & np.uint64(1)).mean() - model.false[k]) < 0.003
    got = {r.doc_id: r for r in Q.op6_language_id(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, (text, _) in docs.items():
        hits = {k: 0 for k in known}
        for g in naive_grams(text):
            for k, own in known.items():
                hits[k] += g in own
        best = max(sorted(hits), key=hits.get)
        second = max(n for k, n in hits.items() if k != best)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif hits[best]:
            assert got[i].lang_pred == best or hits[best] - second <= 1
            assert abs(got[i].score - hits[best] / (hits[best] + second)) < 0.02


def test_filter_equals_a_scalar_one():
    """judge() against bits looked up one by one, for 70 languages, so masks of two words."""
    r = random.Random(5)
    slots = np.array([[r.getrandbits(64) & r.getrandbits(64), r.getrandbits(6) & r.getrandbits(6)] for _ in range(257)], np.uint64)
    model = langid.Model([f"l{k:02}" for k in range(70)], "l03", slots)
    texts = [None, "", "12 !", "a", "Ab cd", "école ß\U0001d538 İI", prose(1, 30), "x" * 50, "a\nb\tc"]
    names, scores, shares = model.judge(texts)
    bits = [[int(slots[s, k // 64]) >> k % 64 & 1 for k in range(70)] for s in range(257)]
    false = [(sum(b[k] for b in bits) / 257) ** langid.HASHES for k in range(70)]
    for text, name, score, share in zip(texts, names, scores, shares):
        grams = list(naive_grams(text))
        if not any(c.isalpha() for c in (text or "").lower()):
            assert (name, score, share) == ("und", 0.0, 0.0)
            continue
        hits, some = [0] * 70, 0
        for g in grams:
            at = [g % 257, *(mixed((g + k) & MASK) % 257 for k in range(1, langid.HASHES))]
            own = [all(bits[a][k] for a in at) for k in range(70)]
            hits, some = [n + x for n, x in zip(hits, own)], some + any(own)
        any_false = 1 - math.prod(1 - f for f in false)
        assert math.isclose(share, max(0.0, some - len(grams) * any_false) / (1 - any_false) / len(grams), abs_tol=1e-12)
        real = [max(0.0, n - len(grams) * f) / (1 - f) for n, f in zip(hits, false)]
        best = max(range(70), key=lambda k: (real[k], -k))
        second = max(x for k, x in enumerate(real) if k != best)
        if real[best] > 0:
            assert name == f"l{best:02}" and math.isclose(score, real[best] / (real[best] + second))
        else:
            assert (name, score) == ("l03", 0.0)


def test_language_ties(spark):
    """Languages with the same texts: the first by name."""
    rows = [(i, prose(i % 6, 40), lang) for i, lang in enumerate(["bb", "aa", "cc"] * 6)]
    df = spark.createDataFrame([(i, prose(i // 3, 40), lang) for i, _, lang in rows], "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and {r.score for r in got} == {0.5}


# --- 7: quality classifier ---


def naive_statistics(text):
    """The labellers' statistics of one text, counted plainly."""
    text = text or ""
    own = set("\n.,!?'\"-:;()|")
    kinds = collections.Counter()
    for c in text:
        kinds["own" if c in own else "lower" if c.isalpha() and c.islower() else "upper" if c.isalpha() and c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "symbol"] += 1
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, letters = max(1, len(words)), max(1, kinds["lower"] + kinds["upper"] + kinds["letter"])
    return [
        kinds["symbol"] / max(1, len(text)),
        kinds["upper"] / letters,
        text.count("!") / n,
        text.count("|") / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        1 - len(set(words)) / max(1, min(n, 12 * n**0.5)),
        sum(not w[-1].isalnum() for w in words) / n,
    ], len(words)


def naive_votes(text):
    stats, words = naive_statistics(text)
    return [quality.ABSTAIN if words < least else quality.BAD if x >= bad else quality.GOOD if x <= good else quality.ABSTAIN for x, (_, _, bad, good, least) in zip(stats, quality.LABELLERS)]


def naive_em(rows, rounds=100):
    """Expectation-maximisation over single rows of votes."""
    n = len(quality.LABELLERS)
    right, share = [[0.995, 0.30] for _ in range(n)], 0.1

    def posterior(votes):
        good, bad = 1 - share, share
        for k, v in enumerate(votes):
            if v == quality.GOOD:
                good, bad = good * right[k][0], bad * (1 - right[k][1])
            elif v == quality.BAD:
                good, bad = good * (1 - right[k][0]), bad * right[k][1]
        return bad / (good + bad)

    for _ in range(rounds):
        p = [posterior(v) for v in rows]
        share = min(0.9, max(1e-4, sum(p) / len(p)))
        for k in range(n):
            for c, prior, low, high in ((quality.GOOD, 0.995, 0.99, 0.9995), (quality.BAD, 0.30, 0.05, 0.999)):
                said = sum((q if c else 1 - q) for q, v in zip(p, rows) if v[k] != quality.ABSTAIN)
                hit = sum((q if c else 1 - q) for q, v in zip(p, rows) if v[k] == c)
                right[k][c] = min(high, max(low, (hit + 8 * prior) / (said + 8)))
    return right, share, [posterior(v) for v in rows]


def naive_features(text):
    text = text or ""
    classes = []
    for c in text:
        k = quality._OWN.find(c)
        if k < 0:
            k = quality._LOWER if c.isalpha() and c.islower() else quality._UPPER if c.isalpha() and c.isupper() else quality._LETTER if c.isalpha() else quality._DIGIT if c.isdigit() else quality._SPACE if c.isspace() else quality._SYMBOL
        classes.append(k)
    out, m = [0.0] * quality.BUCKETS, quality._CLASSES
    counts = collections.Counter(mixed((a * m + b) * m + c) % quality.BUCKETS for a, b, c in zip(classes, classes[1:], classes[2:]))
    for b, n in counts.items():
        out[b] = (n / sum(counts.values())) ** 0.5
    stats, words = naive_statistics(text)
    for k, x in enumerate(stats):
        level = min(15, int(x * 20)) + 16 * (words >= quality.LABELLERS[k][4])
        out[mixed((1 << 20) + 64 * k + level) % quality.BUCKETS] += 0.35
    size = sum(x * x for x in out) ** 0.5
    return [x / size for x in out]


def test_quality_query_equals_plain_python(spark):
    """Votes, label model, features and scores of all documents."""
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    texts = [*docs.values(), *(t for _, t in odd_rows())]
    stats, words = quality.statistics(texts)
    votes = quality.votes(stats, words)
    assert votes.tolist() == [naive_votes(t) for t in texts]
    assert np.allclose(stats, [naive_statistics(t)[0] for t in texts])
    assert np.allclose(quality.features(texts, stats, words), [naive_features(t) for t in texts], atol=1e-6)

    rows = [naive_votes(t) for t in docs.values()]
    right, share, bad = naive_em(rows)
    codes, n = np.unique(quality.pattern(np.array(rows)), return_counts=True)
    found, found_share = quality.estimate(dict(zip(codes.tolist(), n.tolist())))
    assert np.allclose(found, right, atol=1e-9) and math.isclose(found_share, share, rel_tol=1e-9)
    # the scorer, trained on the posteriors in double precision
    x = np.array([naive_features(t) for t in docs.values()])
    w, b = quality.train(x, np.array(bad))
    want = 1 / (1 + np.exp(x @ w + b))
    got = {r.doc_id: r for r in Q.op7_quality_classifier(spark, SF).collect()}
    assert np.allclose([got[i].quality for i in docs], want, atol=0.02)
    assert all(got[i].kept == (got[i].quality >= 0.5) for i in docs)


# --- 5: packing's rule ---


def naive_plan(counts, limit):
    """Places pieces one by one, from long to short: the sum of squares worked out for every open gap."""
    gaps, sequences, out = collections.Counter(), 0, []
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            best = None
            for g in sorted(h for h, n in gaps.items() if n and h >= s):
                after = gaps.copy()
                after[g] -= 1
                after[g - s] += 1
                cost = sum(n * n for h, n in after.items() if h)
                if best is None or cost < best[0]:
                    best = (cost, g)
            g = best[1] if best else limit
            if best:
                gaps[g] -= 1
            else:
                sequences += 1
            gaps[g - s] += 1
            out.append((s, limit - g))
    return out, sequences


@pytest.mark.parametrize("limit,n", [(10, 60), (64, 300), (128, 500)])
def test_plan_follows_the_rule(limit, n):
    r = random.Random(limit)
    counts = collections.Counter(min(limit, 1 + int(r.expovariate(4 / limit))) for _ in range(n))
    placed, sequences = naive_plan(counts, limit)
    slots, found = packing.plan(dict(counts), limit)
    assert found == sequences
    own = [(s, offset) for s, rank, times, _, offset in slots.tolist() for _ in range(times)]
    assert sorted(own) == sorted(placed)


def test_plan_of_very_many_pieces():
    """Where one placement stands for many pieces, the plan stays bounded and nearly as good: 0.1 % over the least possible."""
    r = random.Random(1)
    base = collections.Counter(min(1024, max(1, int(r.lognormvariate(4.6, 1.3)))) for _ in range(20_000))
    for times in (1, 80):
        counts = {s: times * k + (s % 7 if times > 1 else 0) for s, k in base.items()}
        slots, n = packing.plan(counts, 1024)
        assert n <= 1.001 * sum(s * k for s, k in counts.items()) / 1024 + 1
        assert len(slots) <= 8 * packing.PLAN_ITEMS


def one_by_one(counts, limit):
    """naive_plan's placements, from what each gap would change: the numbers of (length, offset), and of sequences."""
    gaps, sequences, out = [0] * limit, 0, collections.Counter()
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            g = min((g for g in range(s, limit) if gaps[g]), key=lambda g: (2 - 2 * gaps[g] + 2 * gaps[g - s] if g > s else 1 - 2 * gaps[g], g), default=limit)
            if g < limit:
                gaps[g] -= 1
            else:
                sequences += 1
            if g > s:
                gaps[g - s] += 1
            out[s, limit - g] += 1
    return out, sequences


@pytest.mark.parametrize("kind", ["falling", "spiky", "tiny"])
def test_plan_follows_the_rule_at_any_size(kind):
    """Beyond 60,000 pieces, and however few placements are made one by one, too."""
    r, limit = random.Random(kind), 32
    if kind == "falling":
        counts = collections.Counter(min(limit, 1 + int(r.expovariate(4 / limit))) for _ in range(100_000))
    else:
        counts = {s: r.choice([1, 50, 20_000]) for s in range(3, limit + 1)} | ({1: 30_000, 2: 40_000} if kind == "tiny" else {})
    assert sum(counts.values()) > packing.PLAN_ITEMS
    placed, sequences = one_by_one(counts, limit)
    for items in (10**9, packing.PLAN_ITEMS, 1):
        slots, found = packing.plan(dict(counts), limit, items)
        own = collections.Counter()
        for s, _, number, _, offset in slots.tolist():
            own[s, offset] += number
        assert found == sequences and own == placed


def test_plan_grows_with_the_lengths_only():
    r = random.Random(1)
    base = collections.Counter(min(1024, max(1, int(r.lognormvariate(4.6, 1.3)))) for _ in range(20_000))
    counts = {s: 1000 * k + s % 7 for s, k in base.items()}
    slots, n = packing.plan(counts, 1024)
    assert n <= 1.0001 * sum(s * k for s, k in counts.items()) / 1024 + 1 and len(slots) <= 30_000 and sum(slots[:, 2]) == sum(counts.values())


def test_packing_of_alike_documents(spark):
    """Ties: equal documents are packed one by one, any of them in any place."""
    docs = documents(spark, [(k % 3, "the quiet river") for k in range(50)] + [(None, None)])
    rows = packing.pack(docs, limit=16).collect()
    assert len(rows) == 51 and sum(x.doc_id is None for x in rows) == 1
    places = collections.defaultdict(list)
    for x in rows:
        places[x.sequence_id].append((x.offset, x.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) <= 16
    length = next(x.length for x in rows if x.doc_id is not None)
    assert len(places) == -(-50 // (16 // length)) or 50 % (16 // length) == 0
