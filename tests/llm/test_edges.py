"""Every operator on odd rows, on an empty table, and with clashing column names."""

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import byte_bpe, chat_format, exact_topk, langid, media, ngram_join, packing, pii, quality, toxicity
from tests.llm.fixtures import documents, odd_rows, prose


def _lang(spark, docs):
    labelled = documents(spark, [(i, prose(i, 40)) for i in range(12)], extra=False).withColumn("lang", F.lit("en"))
    return langid.identify(docs, langid.fit(labelled))


def _toxic(spark, docs):
    rows = [(i, prose(i, 30) + " you dumbhead" * (i % 2) + " dumbheads") if i % 2 else (i, prose(i, 30)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    return toxicity.score(docs, toxicity.fit(documents(spark, rows, extra=False), labels))


OPERATORS = {
    "bpe": lambda spark, d: byte_bpe.encode(d, decode=True, offsets=True),
    "media": lambda spark, d: media.sniff_column(media.store(d), keep=("doc_id",)),
    "packing": lambda spark, d: packing.pack(d),
    "language": _lang,
    "quality": lambda spark, d: quality.classify(d, quality.fit(d)),
    "pii": lambda spark, d: pii.digests(pii.find(d)),
    "toxicity": _toxic,
    "join": lambda spark, d: ngram_join.join(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = odd_rows()
    got = OPERATORS[name](spark, documents(spark, rows)).collect()
    ids = sorted((r.doc_id for r in got), key=repr)
    want = sorted((i for i, _ in rows), key=repr)
    if name == "packing":
        assert set(ids) == set(want)
    else:
        assert ids == want
        # equal texts get equal results
        own = [str(r) for r in got if r.doc_id == 6]
        assert len(own) == 2 and own[0] == own[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0


def test_defined_results_of_odd_texts(spark):
    docs = documents(spark, odd_rows())
    lang = {r.doc_id: r for r in _lang(spark, docs).collect()}
    assert [lang[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and lang[4].lang_pred == "en"
    sets = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert [sets[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [sets[i].component_id for i in (1, 2, 3, 4, 5, 6, None)] == [1, 2, 3, 4, 5, 5, None]
    stored = {r.doc_id: r for r in media.store(docs).collect()}
    assert len(stored[1].media) == len(stored[2].media) == 44 + 64
    assert {r.n_tokens for r in byte_bpe.encode(docs).collect() if r.doc_id in (1, 2)} == {0}


def test_empty_and_odd_vectors(spark):
    rows = [(20, [1.0, 0.5]), (1, [1.0]), (2, []), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf")]), (None, [1.0, 1.0]), (7, [1e30, 1e30]), (8, [1.0, 0.5]), (8, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df, df.filter("vec_id = 20"), k=9).collect()]
    assert sorted(got) == [(20, 1, 7, 2**63 - 1), (20, 2, 8, 5120), (20, 3, 8, 5120), (20, 4, 1, 4096), (20, 5, 2, 0)]
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (2, None, "assistant", "a\\#### </turn>\n### user: b"), (None, 0, "user", "q"), (3, 0, "a: b\\", "</turn></turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(0))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, 2: 1, 3: 1, None: 1}
    assert got[2].loss_chars == len(rows[3][3])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_import_of_entry_without_subpackage(tmp_path):
    """The other queries work where this subpackage and the pipeline are absent."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "lakeloom", tmp_path / "lakeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and len(q) > 80"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_rows_of_one_turn_are_in_order_of_role_and_text(spark):
    """Ties of a turn: by role, then by text, whatever order they come in; equal rows each count."""
    import hashlib

    turns = [("user", "b"), ("user", "a"), ("assistant", "z"), ("user", "a"), ("assistant", None)]
    for order in (turns, turns[::-1]):
        rows = [(1, 5, role, text) for role, text in order] + [(1, 4, "user", "first")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
        got = chat_format.read_back(chat_format.format_conversations(df)).collect()
        want = [("user", "first"), ("assistant", ""), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
        assert [r.turns_sha256 for r in got] == [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()]
        assert (got[0].n_turns, got[0].loss_chars, got[0].loss_sha256) == (6, 1, hashlib.sha256(b"z").hexdigest())
