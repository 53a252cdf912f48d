"""The registered queries of this subpackage, and their SQL where there is any."""

from . import decontaminate, license_scan, line_dedup, manifest, packing, pitman_yor, quality_model, quality_rules, simhash, spelling, suffix_dedup, token_count, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_pitman_yor": pitman_yor.query,
    "op3_decontaminate": decontaminate.query,
    "op4_license_scan": license_scan.query,
    "op5_best_fit_packing": packing.query,
    "op6_token_count": token_count.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality_model": quality_model.query,
    "op10_quality_rules": quality_rules.query,
    "op11_spelling_variants": spelling.query,
    "op12_warc_archive": warc.query,
    "op13_merkle_manifest": manifest.query,
}

ORACLES = {
    "op3_decontaminate": decontaminate.SQL,
    "op4_license_scan": license_scan.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_warc_archive": warc.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
