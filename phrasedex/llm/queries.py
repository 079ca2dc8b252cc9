"""Registered queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from .common import ship_package
from .decontamination import op6_decontamination
from .infill import OP11_SQL, op11_fill_in_middle
from .language_id import op5_language_id
from .mixing import OP10_SQL, op10_mix_sources
from .near_duplicates import OP8_SQL, op8_near_duplicates
from .page_text import op13_page_text
from .repeated_windows import OP4_SQL, op4_repeated_windows
from .runs import op12_periodic_runs
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op2_token_counts
from .token_files import op3_token_files
from .toxicity import op7_toxicity
from .vector_search import op9_vector_search


def _query(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    "op1_suffix_dedup": _query(op1_suffix_dedup),
    "op2_token_counts": _query(op2_token_counts),
    "op3_token_files": _query(op3_token_files),
    "op4_repeated_windows": _query(op4_repeated_windows),
    "op5_language_id": _query(op5_language_id),
    "op6_decontamination": _query(op6_decontamination),
    "op7_toxicity": _query(op7_toxicity),
    "op8_near_duplicates": _query(op8_near_duplicates),
    "op9_vector_search": _query(op9_vector_search),
    "op10_mix_sources": _query(op10_mix_sources),
    "op11_fill_in_middle": _query(op11_fill_in_middle),
    "op12_periodic_runs": _query(op12_periodic_runs),
    "op13_page_text": _query(op13_page_text),
}

ORACLE_SQL = {
    "op4_repeated_windows": OP4_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op10_mix_sources": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
