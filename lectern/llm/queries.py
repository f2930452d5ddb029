"""The registered opN queries and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm.collocations import OP12_SQL, op12_collocations
from lectern.llm.decontam import op5_benchmark_decontamination
from lectern.llm.linededup import OP6_SQL, op6_line_dedup
from lectern.llm.mainpage import op11_html_extraction
from lectern.llm.packing import op8_packing
from lectern.llm.periodic import op13_periodic_runs
from lectern.llm.sharding import op1_sharding
from lectern.llm.simhash import op2_simhash_near_dedup
from lectern.llm.suffixdedup import op4_suffix_array_dedup
from lectern.llm.tokencount import op10_token_counts
from lectern.llm.tokenfiles import op3_token_files
from lectern.llm.topk import OP7_SQL, op7_exact_topk
from lectern.llm.toxicity import op9_toxicity


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_token_files": op3_token_files,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_exact_topk": op7_exact_topk,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
        "op11_html_extraction": op11_html_extraction,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_exact_topk": OP7_SQL, "op12_collocations": OP12_SQL}
