"""The queries of this subpackage and, where SQL can express them, their SQL."""

from corpusgraph.llm import bestfit, decontam, hardneg, jaccard, langid, linededup, merkle, packing, pii, sharding, tokenfile, topk, urls

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_packing": packing.op3_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_language_id": langid.op5_language_id,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_url_filter": urls.op7_url_filter,
    "op8_token_files": tokenfile.op8_token_files,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
    "op11_best_fit_packing": bestfit.op11_best_fit_packing,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_hard_negatives": hardneg.OP13_SQL,
}
