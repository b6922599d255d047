"""The operators' queries by name, and their DuckDB SQL where SQL can express them."""

from dialogscope.llm import (bpe_automaton, decontaminate, hard_negatives, id_planes, langid, line_dedup, maxscore, simhash, token_counts,
                             toxicity, url_filter, warc, whitening)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_bpe_automaton": bpe_automaton.op3_bpe_automaton,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": langid.op8_language_id,
    "op9_maxscore": maxscore.op9_maxscore,
    "op10_simhash": simhash.op10_simhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_id_planes": id_planes.op12_id_planes,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_maxscore": maxscore.OP9_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
