"""Queries of the training-data operators, and SQL for those that it can express."""

from . import bpe, fingerprint, licenses, neardup, packing, pii, quality, toxicity, unigram, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_warc": warc.query,
    "op3_bpe": bpe.query,
    "op4_quality": quality.query,
    "op5_neardup": neardup.query,
    "op6_token_counts": unigram.query,
    "op7_licenses": licenses.query,
    "op8_fingerprints": fingerprint.query,
    "op9_pii": pii.query,
    "op10_packing": packing.query,
}

ORACLE_SQL = {"op2_warc": warc.ORACLE}
