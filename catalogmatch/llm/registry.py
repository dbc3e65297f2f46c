"""Queries and SQL of the training-data operators."""

from catalogmatch.llm import bpe, decontaminate, exact, licenses, lm, minhash, pieces, quality, ranking, secrets, sharding, toxicity, variants

QUERIES: dict = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_near_dedup": minhash.op2_near_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_ranked_search": ranking.op11_ranked_search,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLES: dict = {"op2_near_dedup": minhash.OP2_SQL, "op5_exact_dedup": exact.OP5_SQL, "op11_ranked_search": ranking.OP11_SQL}
