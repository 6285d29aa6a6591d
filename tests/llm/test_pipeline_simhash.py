"""The near-duplicate stage links what SimHash links as well as what shingles link."""

import random

import corpus_pipeline as pipeline
from netprism.llm import shingles, simhash


def test_fingerprints_link_texts_that_shingles_part(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(41)]
    # repeats count for a fingerprint but not for a set: the second text has a long tail of its own that the repeats outweigh
    one = base * 60
    two = base * 60 + [f"x{i}" for i in range(15)]
    apart = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(t) for t in (one, two, apart)]
    a, b, c = (simhash.fingerprint(t.encode()) for t in texts)
    assert (a ^ b).bit_count() <= simhash.RADIUS < (a ^ c).bit_count()
    sets = [set(shingles.hashes(t.encode()).tolist()) for t in texts[:2]]
    assert 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1])
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    plain = shingles.one_each(docs)
    assert sorted(r["doc_id"] for r in plain.collect()) == [0, 1, 2]
