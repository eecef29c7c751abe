"""The parts of the contract queries that SQL can say, over whole test tables."""

import duckdb
import pytest

from framelake.llm import queries as Q

EDITS = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS n FROM documents WINDOW w AS (ORDER BY doc_id))
    SELECT doc_id, length(t), sha256(substr(t, 1, length(t) - length(t) // 4) || substr(n, 1, length(t) // 4)) FROM d ORDER BY 1
"""
TURNS = """
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*), sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)), coalesce(sum(length(text)) FILTER (role = 'assistant'), 0), sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) FROM c GROUP BY conv_id ORDER BY 1
"""
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRETS = f"""
    SELECT doc_id, len([x FOR x IN regexp_extract_all(coalesce(text, ''), '{ASSIGN}', 2) IF length(x) >= 12]), len([x FOR x IN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') IF length(x) >= 18]),
      len([x FOR x IN regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') IF length(x) >= 16]) FROM documents ORDER BY 1
"""


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_edited_texts(spark, sf, db):
    got = [tuple(r) for r in Q.op1_fingerprints(spark, sf).select("doc_id", "n_chars", "edited_sha256").orderBy("doc_id").collect()]
    assert got == db.sql(EDITS).fetchall()


def test_turns_and_loss(spark, sf, db):
    got = Q.op5_chat(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == db.sql(TURNS).fetchall()


def test_numbers_of_base_secrets(spark, sf, db):
    got = [tuple(r) for r in Q.op10_secrets(spark, sf).select("doc_id", "n_assign", "n_access", "n_hex").orderBy("doc_id").collect()]
    assert got == db.sql(SECRETS).fetchall() and any(sum(r[1:]) for r in got)
