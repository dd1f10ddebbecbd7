"""All registered queries of the training-data operators, with their SQL."""

from hushframe.llm import decontaminate, divergence_cube, exact_dedup, license_scan, line_dedup, packing, piece_merges, simhash_pivots, subvector_kmeans, suffix_windows, token_orc, toxicity, url_filter  # noqa: F401  (each registers its query)
from hushframe.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
