"""The pipeline's near copies against brute force over five-word shingles."""

import random

import corpus_pipeline


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stage_finds_all_copies_at_similarity(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3_000)]
    docs = []
    for size in (6, 30, 100, 150, 170, 300, 1000):
        for _ in range(12):
            base = rnd.choices(vocabulary, k=size)
            docs.append(" ".join(base))
            for share in (0.004, 0.01, 0.02, 0.024, 0.04):
                docs.append(" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base))
    docs += ["", None, "one two", "One  two", "one two three"]
    rnd.shuffle(docs)
    sets, label = [shingles(t) for t in docs], list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = [(i, j) for j in range(len(docs)) for i in range(j) if (not sets[i] and not sets[j]) or (both := len(sets[i] & sets[j])) and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    for i, j in pairs:
        low, high = sorted((root(i), root(j)))
        label[high] = low
    want = {i for i in range(len(docs)) if label[i] == i}
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(docs)], "doc_id bigint, text string, n_chars bigint").repartition(5)
    got = corpus_pipeline.simhash_dedup(spark, table, "").collect()
    assert len(pairs) > 150 and sorted(r.doc_id for r in got) == sorted(want)
