"""SimHash with pivot distance tables as a step of the pipeline's near-dedup stage."""

import random

import numpy as np
import corpus_pipeline
from quernspark.llm import neardup

from test_neardup import frame, shingles


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Fingerprints alone find copies with few changes; what they propose counts by whole sets only."""
    rng, rows = random.Random(6), []
    for i in range(30):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(1500)]
        edit = list(words)
        edit[700] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(edit))]
    sets = [neardup.shingle_set(t, 5) for _, t in rows]
    bits = np.frombuffer(b"".join(neardup.fingerprint(s) for s in sets), dtype=">u8").astype(np.uint64)
    near = {i // 2 for i in range(0, 60, 2) if np.bitwise_count(bits[i] ^ bits[i + 1]) <= neardup.BITS}
    assert len(near) > 20
    monkeypatch.setattr(neardup, "ROUNDS", -1)  # no MinHash rounds after it
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect()}
    assert kept == {i for i, _ in rows if i - 100 not in near}
