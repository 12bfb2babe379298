"""Every registered corpus query has SQL, or a test of its rows that is named here."""

import pathlib

import pytest

from paperlake.llm.queries import ORACLES, QUERIES

#: Tests against a brute-force version, the library or held-out rows.
TESTED = {
    "op2_licenses": ("test_text_operators", "test_licenses"),
    "op4_bpe": ("test_text_operators", "test_bpe"),
    "op5_urls": ("test_pairs", "test_urls"),
    "op6_vectors": ("test_pairs", "test_near_vectors"),
    "op7_personal_data": ("test_text_operators", "test_pii"),
    "op8_secrets": ("test_text_operators", "test_secrets"),
    "op9_near_documents": ("test_pairs", "test_near_documents"),
    "op12_packing": ("test_packing", "test_documents"),
    "pipeline": ("test_pipeline_rows", "test_rows_of_the_whole_pipeline"),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_named(name):
    module, test = TESTED[name]
    text = (pathlib.Path(__file__).parent / f"{module}.py").read_text(encoding="utf-8")
    assert f"def {test}(" in text
