"""Sanitisation reads whole texts."""

from lakeloom.llm import pii
from tests.llm.fixtures import documents, prose


def test_distant_terms_go(spark):
    rows = [(i, f"Zorblax {prose(i, 60)} zed@corp.example.com {prose(100 + i, 60)} ZORBLAX.") for i in range(6)]
    rows += [(i, prose(i, 60)) for i in range(10, 70)] + [(90, "Zorblax went home"), (91, rows[0][1])]
    clean = {x.doc_id: x.text for x in pii.sanitise(documents(spark, rows, extra=False)).collect()}
    assert all("zorblax" not in clean[i].lower() and "[EMAIL]" in clean[i] and clean[i].endswith(" .") for i in (*range(6), 91))
    assert clean[90] == rows[-2][1] and clean[20] == dict(rows)[20]
