"""Operators for training-data pipelines, with the queries that apply them to whole tables."""

from __future__ import annotations

from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .ivfpq import op6_nearest_neighbours
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixing import OP9_SQL, op9_mix_sources
from .mtree import OP5_SQL, op5_exact_top_k
from .pieces import op8_pieces
from .simhash_dedup import op2_simhash_dedup
from .substring_dedup import op1_substring_dedup
from .token_counts import op4_token_counts
from .token_tables import op11_token_tables
from .toxicity import op10_toxicity
from .warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_simhash_dedup, op3_line_dedup, op4_token_counts, op5_exact_top_k, op6_nearest_neighbours, op7_warc, op8_pieces, op9_mix_sources, op10_toxicity, op11_token_tables, op12_fill_in_middle, op13_hard_negatives)}

#: Queries that SQL can express over whole tables; the others are tested against brute force.
ORACLES = {"op3_line_dedup": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op9_mix_sources": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_hard_negatives": OP13_SQL}
