"""Components, triangles and ranks against plain Python, hubs included."""

import collections
import itertools
import random
import re
import time

from lakeloom.operators import graph as G


def edges(spark, rows, schema="a long, b long"):
    return spark.createDataFrame(rows, schema)


def test_components(spark):
    r = random.Random(1)
    rows = [(k, k + 1) for k in range(0, 400)] + [(1000, 1000 + k) for k in range(1, 300)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)] + [(5, 5), (None, 3), (7, None), (1001, 1000)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        if a is not None and b is not None and a != b:
            up[top(a)] = top(b)
    least = {}
    for x in up:
        least[top(x)] = min(x, least.get(top(x), x))
    got = {x.node: x.component for x in G.connected_components(edges(spark, rows).repartition(5)).collect()}
    assert got == {x: least[top(x)] for x in up}
    assert G.connected_components(edges(spark, [(1, 1)])).count() == 0
    assert {x.node: x.component for x in G.connected_components(edges(spark, [("b", "a")], "a string, b string")).collect()} == {"a": "a", "b": "a"}


def test_triangles(spark):
    r = random.Random(2)
    rows = [(r.randrange(60), r.randrange(60)) for _ in range(500)] + [(0, k) for k in range(1, 400)] + [(3, 4), (4, 3), (4, 4), (None, 1)]
    near = collections.defaultdict(set)
    for a, b in rows:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = collections.Counter()
    for x in near:
        want[x] = sum(b in near[a] for a, b in itertools.combinations(near[x], 2))
    assert {x.node: x.triangles for x in G.triangles(edges(spark, rows)).collect()} == {k: v for k, v in want.items() if v}
    assert G.triangles(edges(spark, [])).count() == 0


def test_triangles_in_many_cells(spark):
    """Few edges a task, so that nodes have many colours; what reaches the tasks are edges, a few times each, and no pairs."""
    rows = [(a, b) for a, b in itertools.combinations(range(30), 2) if (a * b) % 7] + [(100 + k, k % 30) for k in range(40)]
    near = collections.defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    want = {x: sum(b in near[a] for a, b in itertools.combinations(near[x], 2)) for x in near}
    found = G.triangles(edges(spark, rows), looked_up=8)
    assert {x.node: x.triangles for x in found.collect()} == {k: v for k, v in want.items() if v}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 2 and "RepartitionByExpression" in text, text


def test_triangles_in_rounds_leave_no_files(spark, monkeypatch):
    """What a round sends is bounded by the edges, however many colours there are, and neither shuffles nor tables of edges
    stay on disk."""
    rows = [(a, b) for a, b in itertools.combinations(range(40), 2) if (a * b) % 7] + [(100 + k, k % 40) for k in range(60)]
    near = collections.defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    want = {x: sum(b in near[a] for a, b in itertools.combinations(near[x], 2)) for x in near}
    want = {k: v for k, v in want.items() if v}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_", disk.getAllFiles().mkString(" ")))
    tables, rounds, keep, deal = {}, [], G.materialise, G._dealt

    def seen(df, name, **more):
        tables[name] = keep(df, name, **more)
        return tables[name]

    monkeypatch.setattr(G, "materialise", seen)
    monkeypatch.setattr(G, "_dealt", lambda *a: (rounds.append(a), deal(*a))[1])
    before = shuffles()
    found = G.triangles(edges(spark, rows), looked_up=8)
    for _ in range(50):  # files go a little later
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(tables["edges"].inputFiles()[0])
    assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    assert {x.node: x.triangles for x in found.collect()} == want

    rounds.clear()
    found = G.triangles(edges(spark, rows), looked_up=8, sent_at_least=1)
    colours, cells = rounds[0][0], [x for _, now in rounds for x in now]
    assert colours > 10 and cells == list(range(colours * (colours + 1) // 2))
    assert len(rounds) >= (colours + 1) / 3 and max(len(now) for _, now in rounds) <= 3 * colours / 2 + 1
    assert {x.node: x.triangles for x in found.collect()} == want


def test_ranks_converge(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(40), r.choice([1.0, 2.0])) for _ in range(150)] + [(50 + k, 1, 1.0) for k in range(60)] + [(1, 2, 0.0), (None, 1, 1.0), (3, 99, 5.0)]
    w = collections.Counter()
    for a, b, x in rows:
        if a is not None and x > 0:
            w[a, b] += x
    out = collections.Counter()
    for (a, _), x in w.items():
        out[a] += x
    nodes = {n for e in w for n in e}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        lost = sum(rank[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
        for (a, b), x in w.items():
            new[b] += 0.85 * rank[a] * x / out[a]
        rank = new
    found, rounds = G.ranks(edges(spark, rows, "a long, b long, w double"), tolerance=1e-6)
    got = {x.node: x.rank for x in found.collect()}
    assert rounds < 100 and got.keys() == nodes and max(abs(got[n] - rank[n]) for n in nodes) < 1e-5 and abs(sum(got.values()) - 1) < 1e-9
    assert G.ranks(edges(spark, [], "a long, b long, w double"))[0].count() == 0


def test_ranks_shuffle_no_edges_in_rounds(spark, monkeypatch):
    """The shares lie in buckets, and the plan of a round has exchanges of ranks and of sums only."""
    plans = []
    keep = G.materialise

    def seen(df, name, **more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name, **more)

    monkeypatch.setattr(G, "materialise", seen)
    rows = [(k % 50, (k * 7) % 90, 1.0 + k % 3) for k in range(600)]
    G.ranks(edges(spark, rows, "a long, b long, w double"), rounds=3)
    rounds = [text for name, text in plans if name == "ranks"][1:]
    assert len(rounds) == 3
    for text in rounds:
        joined = text[text.index("ShuffledHashJoin") :] if "ShuffledHashJoin" in text else ""
        shares = [line for line in joined.splitlines() if "share#" in line and "FileScan" in line]
        assert shares and "Bucketed: true" in shares[0], text
        assert not any("Exchange hashpartitioning(a#" in above and "share#" in below for above, below in zip(joined.splitlines(), joined.splitlines()[1:]))
