"""The registered queries of this subpackage, and the SQL that answers them where SQL can."""

from tessera.llm import centroids, decontamination, forest, html_text, ngram_join, packing, personal_data, phrases, quality_classifier, quality_rules, substring_dedup, tool_calls, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_packing": packing.op2_packing,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_warc": warc.op5_warc,
    "op6_tool_calls": tool_calls.op6_tool_calls,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_personal_data": personal_data.op9_personal_data,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_minhash_forest": forest.op11_minhash_forest,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
    "quality_ablation": quality_rules.quality_ablation,
}
SQL = {
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_tool_calls": tool_calls.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
    "op8_suffix_dedup": substring_dedup.OP8_SQL,
    "op11_minhash_forest": forest.OP11_SQL,
    "op12_centroid_clusters": centroids.OP12_SQL,
    "op13_phrase_collocations": phrases.OP13_SQL,
}
