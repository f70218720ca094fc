"""The registered queries agree with their SQL over the smallest tables, and carry the agreed columns."""

import pytest
from conftest import SMALL
from oracle import same

from tidemark.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2": "doc_id held_out score predicted", "op3": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op4": "doc_id held_out lang_pred score",
    "op5": "doc_id n_shingles component_id", "op6": "doc_id start n_tokens ids_crc32", "op7": "doc_id size source_size target taken", "op8": "doc_id license", "op9": "query_id rank vec_id score", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns) and df.count() > 0
