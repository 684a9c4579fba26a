"""The whole pipeline against a plain version of each stage."""

import hashlib
import math
import random

import numpy as np
import sentencepiece as library

import corpus_pipeline
from nudgeframe.llm import mixing, sentencepiece, substring_dedup, toxicity
from tests.conftest import SMALL_DIR
from tests.llm.test_documents import fingerprint_of, size_of
from tests.llm.test_repeats import brute_kept


def one_of_each_group(rows):
    """Smallest doc_id of each component of fingerprints at 4 or fewer bits."""
    prints, group = [fingerprint_of(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r for r in rows if r[0] in set(least.values())]


def mixed(rows):
    """Rows as often as the mix takes them, by the definition."""
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size_of(r[1])
    names = sorted(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        own = [r for r in rows if r[2] == s]
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = target[s] - epochs * sizes[s]

        def key(r):
            # Ids are distinct at this stage: every row is the first of its id and text.
            name = f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()[:16]}:1"
            digest = hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13]
            mean = len(r[1]) / max(size_of(r[1]), 1)
            return -math.log((int(digest, 16) + 0.5) / 2**52) * (1 + abs(mean - 6))

        upto = 0
        for r in sorted(own, key=key):
            size = size_of(r[1])
            upto += size
            taken = epochs + (rest > 0 and upto - size / 2 <= rest and size > 0)
            out += [r] * int(taken)
    return out


def test_pipeline_matches_plain_stages(spark, make_docs):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(rng.randint(30, 120))), rng.choice("abc")) for i in range(60)]
    rows += [(100 + i, f"{word()} {word()} {passage} {word()}", "b") for i in range(8)]
    rows += [(200 + i, rows[i][1], "c") for i in range(6)]
    long = [word() for _ in range(400)]
    for i in range(5):
        long[rng.randrange(400)] = word()
        rows.append((300 + i, " ".join(long), "a"))
    rows += [(400 + i, f"you idiot {' '.join(word() for _ in range(60))} worthless scum", "a") for i in range(6)]
    docs = make_docs(rows, extra=False)
    labels = corpus_pipeline.read(spark, SMALL_DIR, "labels")
    labels = labels.select("doc_id", "toxic").filter("doc_id < 0").unionByName(
        spark.createDataFrame([(r[0], int(r[0] >= 400)) for r in rows], "doc_id long, toxic int")
    )
    scorer = toxicity.train(docs, labels)
    keep = scorer.scores([r[1] for r in rows]) < toxicity.THRESHOLD
    plain = [r for r, k in zip(rows, keep) if k]
    assert 0 < sum(~keep) and all(r[0] < 400 for r in plain)
    got = toxicity.drop_toxic(docs, labels)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in plain)
    plain = one_of_each_group(plain)
    kept = brute_kept(plain, substring_dedup.WINDOW)
    plain = mixed([(r[0], kept[r[0]], r[2]) for r in plain])
    model = sentencepiece.read_model()
    encoder = library.SentencePieceProcessor(model_proto=model)
    want = sorted((r[0], tuple(encoder.encode(r[1]))) for r in plain)
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, got, SMALL_DIR).cache()
    assert sorted((r["doc_id"], tuple(r["piece_ids"])) for r in got.collect()) == want
    assert len(np.unique([r[0] for r in plain])) < len(rows)
