"""The queries of this subpackage, and the SQL of those that SQL can express."""

from seedloom.llm import decontaminate, divergence, html_text, lexical_search, licenses, packing, pii, quality_model, quality_rules, secrets, sharding, signature_tree, simhash

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_html_text": html_text.op2_html_text,
    "op3_pii": pii.op3_pii,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_licenses": licenses.op6_licenses,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_jaccard_join": signature_tree.op11_jaccard_join,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op4_sharding": sharding.OP4_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_jaccard_join": signature_tree.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
