"""Registered queries against their SQL on the driver's smallest tables, one family each run."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = ["a01_evidence_summary", "a07_tied_terciles", "a09_tenth_decade", "a10_bands", "a12_assessment", "a14_histogram", "a19_lead_evidence", "f03_not_in", "f04_identifier_in", "f08_eq", "f10_gt", "f22_corrections", "j03_preferred_alternative", "j04_anti_tombstone", "j10_fuzzy_candidates", "j11_points_in_cells", "j12_overlapping_boxes", "j22_continued_tables", "k10_upsert", "n01_literals", "n04_inline_units", "n11_directions", "t_sessions", "u07_sequence_differences", "w01_natural_order", "w02_workbook_order", "w09_first_front", "w16_clusters", "s01_csv", "s11_project_snapshot", "k08_published", "t_requests", "t_resumed_batches", "t_sealed_windows", "a08_rank_profile", "a18_core_membership", "a25_row_merge", "a33_fingerprint", "f14_numbered_product", "f15_source_exclusion", "f16_first_refusal", "f17_row_scope", "f19_intermediate_label", "f24_labels", "j15_cut_keys", "j16_verified_pairs", "n05_declared_units", "n09_exact_differences", "n13_identifier_keys", "n15_value_tokens", "n23_text_rows", "w09_pareto_depths", "w10_evidence_fronts", "w12_candidate_selection", "q_results_page", "q_results_choices", "n_transposed_rows", "n_unsupported_columns", "w_located_pages", "s05_shared_graphs", "n23_segments", "n24_legends", "n21_heading_members", "j13_hot_heading", "k11_revisions", "q_study_rows", "s03_role_defaults", "n20_declarations", "n22_metric_headers", "a14_strength_histogram", "a23_consensus", "w05_study_order", "w05_label_order", "a04_facet_kind", "n27_smiles_scores"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, con, name):
    assert difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_register():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
