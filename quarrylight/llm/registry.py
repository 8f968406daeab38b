"""The queries of this package and, where SQL can express one, the SQL for its rows."""

from quarrylight.llm import exact_dedup, language, media, overlap, packing, pieces, quality, runs, sharding, simhash, spelling, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op4_language": language.op4_language,
    "op5_media": media.op5_media,
    "op6_pieces": pieces.op6_pieces,
    "op7_sharding": sharding.op7_sharding,
    "op10_packing": packing.op10_packing,
    "op3_quality": quality.op3_quality,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op11_runs": runs.op11_runs,
    "op12_ngram_join": overlap.op12_ngram_join,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE: dict[str, str] = {**exact_dedup.ORACLE}
