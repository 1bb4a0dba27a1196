"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from termloom.llm import chat, codes, decontaminate, extract, jaccard, langid, lines, packing, periods, prefixes, rules, substrings, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        langid.op1_crf_language_id,
        lines.op2_winnow_line_dedup,
        packing.op3_bin_completion_packing,
        extract.op4_wrapper_induction,
        toxicity.op5_counterfactual_toxicity,
        rules.op6_rule_ledger,
        substrings.op7_fingerprint_index_dedup,
        decontaminate.op8_aho_corasick_decontamination,
        chat.op9_event_sourced_chat,
        jaccard.op10_jaccard_metric_join,
        codes.op11_vector_codes,
        prefixes.op12_prefix_token_counts,
        periods.op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    lines.op2_winnow_line_dedup.__name__: lines.OP2_SQL,
    rules.op6_rule_ledger.__name__: rules.OP6_SQL,
    codes.op11_vector_codes.__name__: codes.op11_sql(),
    periods.op13_periodic_runs.__name__: periods.OP13_SQL,
}
