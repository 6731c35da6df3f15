"""The join's links against brute force."""

import itertools

from lakeloom.llm import ngram_join
from tests.llm.fixtures import documents, prose


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_links_equal_brute_force(spark):
    rows = []
    for g in range(8):
        base = prose(g, 80).split()
        for k in range(12):
            w = list(base)
            for j in range(k % 4):
                w[(17 * k + 23 * j) % 80] = f"new{k}x{j}"
            rows.append((100 * g + k, " ".join(w)))
    rows += [(9000, None), (9001, "")]
    sets = {i: shingles(t or "") for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    found, members = ngram_join.links(documents(spark, rows, extra=False))
    held = {}
    for r in members.collect():
        held.setdefault(r["class"], []).append(r.doc_id)
    got = found.collect()
    pairs = [(min(p), max(p)) for r in got for p in (itertools.combinations(held[r.a], 2) if r.a == r.b else itertools.product(held[r.a], held[r.b]))]
    assert len(pairs) == len(set(pairs)) == sum(r.n_links for r in got) and set(pairs) == want and len(want) > 100
