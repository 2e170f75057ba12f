"""The corpus queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import alignment, decontaminate, fingerprints, language, licences, lines, near_dups, phrases, pieces, secret_scan, token_files, toxicity, urls

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_pieces": pieces.op5_pieces,
    "op6_token_files": token_files.op6_token_files,
    "op7_url_filter": urls.op7_url_filter,
    "op8_licences": licences.op8_licences,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_near_dups": near_dups.op10_near_dups,
    "op11_alignment": alignment.op11_alignment,
    "op12_secrets": secret_scan.op12_secrets,
    "op13_collocations": phrases.op13_collocations,
}

ORACLE = {
    "op1_line_dedup": lines.ORACLE,
    "op7_url_filter": urls.ORACLE,
    "op12_secrets": secret_scan.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
