"""The opN_ queries and the SQL twins of those that SQL can express."""

from . import bpe, conversations, decontamination, exact_dedup, fingerprints, licenses, lm, minhash, mixing, repeats, resampling, secrets, toxicity

QUERIES = {
    "op1_minhash_dedup": minhash.query,
    "op2_license_scan": licenses.query,
    "op3_secret_scan": secrets.query,
    "op4_bpe": bpe.query,
    "op5_mix_sources": mixing.query,
    "op6_lm_score": lm.query,
    "op7_repeated_strings": repeats.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_fingerprints": fingerprints.query,
    "op11_importance_resampling": resampling.query,
    "op12_decontamination": decontamination.query,
    "op13_conversation_repair": conversations.query,
}
ORACLES = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_decontamination": decontamination.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
