"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op9_benchmark_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op7_kneser_ney_language
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op10_best_fit_packing
from .sharding import op6_hash_tree_sharding
from .token_counts import op1_token_counts
from .token_tables import op8_token_tables
from .toxicity import op3_factorization_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_factorization_toxicity": op3_factorization_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_hash_tree_sharding": op6_hash_tree_sharding,
    "op7_kneser_ney_language": op7_kneser_ney_language,
    "op8_token_tables": op8_token_tables,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
}
