"""The queries of this subpackage."""

from behavex.llm.ann import op7_ann
from behavex.llm.decontaminate import OP3_SQL, op3_decontaminate
from behavex.llm.html_extract import op6_html_extract
from behavex.llm.jaccard_join import op9_jaccard_join
from behavex.llm.line_dedup import op5_line_dedup
from behavex.llm.packing import op8_best_fit_packing
from behavex.llm.passages import op10_substring_dedup
from behavex.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from behavex.llm.quality import op2_quality_classifier
from behavex.llm.sharding import OP1_SQL, op1_sharding
from behavex.llm.sort_means import OP12_SQL, op12_sort_means
from behavex.llm.token_counts import op4_token_counts
from behavex.llm.toxicity import op11_toxicity


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_counts": op4_token_counts,
        "op5_line_dedup": op5_line_dedup,
        "op6_html_extract": op6_html_extract,
        "op7_ann": op7_ann,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_toxicity": op11_toxicity,
        "op12_sort_means": op12_sort_means,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op3_decontaminate": OP3_SQL, "op12_sort_means": OP12_SQL, "op13_prefix_trie": OP13_SQL}
