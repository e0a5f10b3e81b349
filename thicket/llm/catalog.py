"""The queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from thicket.llm import clusters, frequency, mixing, overlap, quality, tokens
from thicket.sources.tables import table

QUERIES = {
    "p1_found": lambda s, d: overlap.leaf_pairs(table(s, d, "leaf")),
    "p1_links": lambda s, d: overlap.leaf_links(table(s, d, "leaf")),
    "p2_found": lambda s, d: clusters.leaf_pairs(table(s, d, "leaf")),
    "p2_members": lambda s, d: clusters.leaf_clusters(table(s, d, "leaf")),
    "p2_clusters": lambda s, d: clusters.describe(table(s, d, "leaf")),
    "p5_found": lambda s, d: frequency.marked(table(s, d, "leaf")),
    "p5_frequency": lambda s, d: frequency.leaf_frequency(table(s, d, "leaf")),
    "p6_ids": lambda s, d: tokens.document_ids(table(s, d, "documents")),
    "p6_round_trip": lambda s, d: tokens.round_trip(table(s, d, "documents")),
    "p7_found": lambda s, d: mixing.short_sources(table(s, d, "documents"), table(s, d, "mix_target")),
    "p7_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_target")),
    "p7_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_target")),
    "p8_found": lambda s, d: quality.not_prose(table(s, d, "documents"), table(s, d, "common_word")),
    "p8_statistics": lambda s, d: quality.statistics(table(s, d, "documents"), table(s, d, "common_word")),
    "p8_quality": lambda s, d: quality.quality(table(s, d, "documents"), table(s, d, "common_word")),
}
SQL = {"p8_statistics": quality.STATISTICS_SQL, "p1_found": overlap.PAIRS_SQL, "p5_found": frequency.FOUND_SQL, "p5_frequency": frequency.FREQUENCY_SQL}
