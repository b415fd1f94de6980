"""Columns and types that each query's contract names."""

import pytest

from quillstack.llm import queries as Q

CONTRACTS = {
    "op1_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op2_parity_jaccard_join": "doc_id long, n_shingles long, component_id long",
    "op5_token_grammar": "doc_id long, start long, n_tokens long, ids_crc32 long",
    "op7_pivot_top_k": "query_id long, rank int, vec_id long, score long",
    "op9_exact_dedup": "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string",
    "op10_best_fit_packing": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    "op11_fill_in_middle": "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    "op12_secret_scan": "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    "op13_whitening": "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_types(spark, small, name):
    want = {k: v.replace("long", "bigint") for k, v in (c.split() for c in CONTRACTS[name].split(", "))}
    got = dict(Q.queries()[name](spark, small).dtypes)
    assert {k: got.get(k) for k in want} == want
