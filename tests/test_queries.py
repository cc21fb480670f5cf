"""A cross-section of the registered queries against their SQL on the smallest tables.

``check_queries.py`` runs all of them.
"""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare

NAMES = [
    "kmer_corpus_count", "nonoverlapping_kmer_count", "vocabulary_index", "padded_batches", "path_parts",
    "overlapping_windows", "successive_merge", "majority_regroup", "rule_filter_split", "gold_gene_matches",
    "overestimation", "ontology_terms", "shuffled_negatives", "policy_clusters", "fasta_round_trip", "class_report",
    "cluster_concatenation", "cluster_region_texts", "binned_kmer_count", "incremental_fasta", "genbank_fasta_folder",
    "embedding_match_counts", "report_round_trip", "squared_hinge_predictions",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    text, _, _ = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], con, sf_dir)
    assert text.startswith("ok"), text


def test_registry(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 120
    assert entry.entry(spark).columns == ["feature", "cnt"]
