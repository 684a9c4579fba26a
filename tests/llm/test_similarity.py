"""The n-gram join and the spelling variants against all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from nudgeframe.llm import ngram_join, spelling
from nudgeframe.llm.common import LAST_ID

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=3):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    """By row: smallest id reachable over links of all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    ids = [LAST_ID if r[0] is None else r[0] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), LAST_ID), ids[i])
    found = [least[find(i)] if sets[i] else ids[i] for i in range(len(rows))]
    return [(len(s), None if c == LAST_ID else c) for s, c in zip(sets, found)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new"], [words[at], "Extra"]])
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(hostile):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(hostile)
    for base in range(8):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 30, 80, 200]))]
        rows += [(1000 + 50 * base + i, edited(rng, words, rng.randint(0, max(1, len(words) // 30))), "a") for i in range(25)]
    # A chain: neighbours link, its ends do not.
    words = [f"c{i}" for i in range(60)]
    for i in range(12):
        words[5 * i] = f"d{i}"
        rows.append((2000 + i, " ".join(words), "a"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [None, "4"])
def test_jaccard_components_equal_all_pairs(spark, make_docs, copies, block):
    if block:
        spark.conf.set("spark.nudgeframe.bucketRows", block)
    try:
        got = ngram_join.jaccard_components(make_docs(copies).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.nudgeframe.bucketRows")
    want = [(r[0], *c) for r, c in zip(copies, plain_components(copies))]
    assert sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(repr, want))
    assert ngram_join.jaccard_components(make_docs([])).count() == 0


def test_linked_sets_share_a_signature():
    rng = random.Random(3)
    links = 0
    for _ in range(1500):
        n = rng.choice([9, 10, 11, 19, 20, 21, 30, 57, 100, 300, 2000])
        base = [rng.getrandbits(64) for _ in range(n)]
        x, y = set(base), set(base)
        for _ in range(rng.randint(0, max(1, n // 9))):
            turn = rng.random()
            if turn < 0.4:
                y.discard(rng.choice(base))
            else:
                (x if turn > 0.8 else y).add(rng.getrandbits(64))
        if x == y or 100 * len(x & y) < 90 * len(x | y):
            continue
        links += 1
        signed = []
        for z in (x, y):
            other = [rng.getrandbits(64) for _ in range(rng.randint(1, 400))]
            flat = np.array([*sorted(z), *sorted(set(other))], np.uint64)
            sigs, owners = ngram_join.signatures(flat, np.array([len(z), len(set(other))]), 90)
            signed.append(set(sigs[owners == 0].tolist()))
        assert signed[0] & signed[1]
    assert links > 300


def test_dense_groups_give_forests_not_all_pairs(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, words, 2), "a") for i in range(300)]
    docs = make_docs(rows)
    pairs = ngram_join.pivot_pairs(ngram_join.with_signatures(docs))
    assert pairs.count() < 300 * 20
    assert {r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {c for _, c in plain_components(rows)}


def test_hashes_tell_words_apart():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))).encode() for _ in range(500)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, row = ngram_join.word_hashes(data, offsets)
    words = [w for t in texts for w in t.split()]
    assert row.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert len({*zip(h.tolist(), words)}) == len(set(words)) == len(set(h.tolist()))
    shingles, sizes = ngram_join.shingle_sets(data, offsets, 3)
    assert sizes.tolist() == [len(shingle_set(t.decode())) for t in texts] and len(shingles) == sum(sizes)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    out = []
    forms = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        out.append([w, forms[w], w, n, len(close), counts[forms[w]] if forms[w] else None])
    for row in out:
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out), key=repr)


def test_groups_of_random_words_equal_all_pairs(spark):
    rng = random.Random(7)
    counts = Counter()
    for letters in ("ab", "aé", "abcdefgh", "xyÿz"):
        for _ in range(40):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 11)))
            counts[word] = rng.choice([1000, 300, 20])
            for _ in range(6):
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", rng.choice(letters), word[at] + rng.choice(letters)]) + word[at + 1 :]
                if len(word) >= 7:
                    counts[word] = rng.choice([2, 3, 20, 200])
    counts["a" * 5000], counts["a" * 5001] = 2, 20
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(counts)


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(9)
    for _ in range(300):
        places = rng.sample(range(12), rng.randint(3, 6))
        grams = [(rng.randint(0, 40), p) for p in places]
        got = spelling.pivots_of(grams)
        pairs = [(a[0] + b[0]) for a in grams for b in grams if a[1] + 2 <= b[1]]
        assert abs(got[0][1] - got[1][1]) >= 2 and sum(r for r, _ in got) == min(pairs)


def test_query_on_a_written_hostile_table(spark, make_docs, hostile, tmp_path):
    rng = random.Random(10)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(9)) for _ in range(30)]
    rows = hostile + [(3000 + i, ", ".join(rng.choice(stems).title() for _ in range(60)), "a") for i in range(60)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "").translate(LOWER) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    counts = Counter({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = spelling.op11_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(counts) and any(r["form"] for r in got)
    make_docs([]).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert spelling.op11_spelling_variants(spark, f"{tmp_path}/empty").count() == 0
