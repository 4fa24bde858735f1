"""Every query of the engine proper, with its SQL twin where SQL can express it."""

from __future__ import annotations

from strandlake.plans import alignment_queries, cluster_queries, feature_queries, graph_queries, haplotype_queries, population_queries, row_queries, sequence_queries, table_queries, tiling_queries

FLAGSHIP = "otu_summary"
#: What SQL cannot express; tests compare these with plain Python.
WITHOUT_SQL = ("aligned_to_references", "quality_controlled", "first_compatible_haplotypes", "purged_alignment")
_PARTS = (sequence_queries, cluster_queries, alignment_queries, table_queries, row_queries, graph_queries, tiling_queries, haplotype_queries, population_queries, feature_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
