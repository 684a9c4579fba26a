"""Both substring operators against brute force, with and without cut anchors."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nudgeframe.llm import repeats, substring_dedup, suffix_dedup
from nudgeframe.llm.common import LAST_ID


def brute(rows, window, tokens, join):
    """(doc order) -> digest of what stays, by the definition."""
    order = lambda r: (LAST_ID if r[0] is None else r[0], r[2])
    seen, out = {}, {}
    for doc in sorted({(r[0], r[1] or "", version(r[1])) for r in rows}, key=order):
        words = tokens(doc[1].encode())
        gone = np.zeros(len(words), bool)
        for at in range(len(words) - window + 1):
            part = tuple(words[at : at + window])
            if seen.setdefault(part, (order(doc), at)) != (order(doc), at):
                gone[at : at + window] = True
        kept = [w for w, g in zip(words, gone) if not g]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc[0], doc[1]] = (len(words), int(gone.sum()), spans, hashlib.sha256(join(kept)).hexdigest())
    return out


def version(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h & 0x7FFF


def words(raw):
    return raw.split()


def marked(docs, spec, solve):
    return repeats.with_removed(docs.select("doc_id", "text"), spec, solve).collect()


def check(rows, docs, window, spec, solve, tokens, join):
    want = brute(rows, window, tokens, join)
    got = marked(docs, spec, solve)
    assert len(got) == len(rows)
    for row in got:
        parts = tokens((row["text"] or "").encode())
        spans = repeats.merged(row["__runs"], window, len(parts))
        kept, at = [], 0
        for a, b in spans:
            kept += list(parts[at:a])
            at = b
        kept += list(parts[at:])
        found = (len(parts), sum(b - a for a, b in spans), len(spans), hashlib.sha256(join(kept)).hexdigest())
        assert found == want[row["doc_id"], row["text"] or ""], row["doc_id"]


BOTH = [
    pytest.param(20, substring_dedup.WORDS, substring_dedup.equal_windows, words, b" ".join, id="words"),
    pytest.param(100, suffix_dedup.BYTES, suffix_dedup.equal_windows, bytes, bytes, id="bytes"),
]


@pytest.mark.parametrize("window,spec,solve,tokens,join", BOTH)
def test_hostile_rows(make_docs, hostile, window, spec, solve, tokens, join):
    rows = [r for r in hostile if r[0] != 203]
    check(rows, make_docs(rows), window, spec, solve, tokens, join)


@pytest.mark.parametrize("window,spec,solve,tokens,join", BOTH)
def test_texts_of_one_id_are_told_apart(make_docs, monkeypatch, window, spec, solve, tokens, join):
    # The brute force tells texts apart by their whole hash; the low 15 bits still come first.
    turned = lambda text: ((h := xxhash.xxh64_intdigest((text or "").encode(), 42)) & 0x7FFF, h >> 15)
    monkeypatch.setattr(f"{__name__}.version", turned)
    rng = random.Random(7)
    passages = [" ".join(f"p{rng.randint(0, 99999)}" for _ in range(30)) for _ in range(40)]
    rows = []
    for i in range(3000):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 40))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own)), rng.choice(passages))
        rows.append((None if i % 10 else 77, " ".join(own)))
    assert len({r[1] for r in rows if r[0] is None}) > len({version(r[1])[0] for r in rows if r[0] is None})
    check(rows, make_docs(rows, extra=False), window, spec, solve, tokens, join)


@pytest.mark.parametrize("window,spec,solve,tokens,join", BOTH)
def test_frequent_anchors_are_cut_without_loss(spark, make_docs, window, spec, solve, tokens, join):
    rng = random.Random(5)
    line = " ".join(f"w{i}" for i in range(45))
    rows = [(i, f"{rng.random()} {line} {rng.random()}" if i % 3 else f"{line[: rng.randint(120, 170)]} {i}") for i in range(2500)]
    spark.conf.set("spark.nudgeframe.repeatRows", "60")
    try:
        docs = make_docs(rows, extra=False)
        keyed = repeats.with_key(docs.select("doc_id", "text"))
        assert repeats.frequent_anchors(keyed, spec).count() > 0
        assert repeats.repeated_regions(keyed, spec).filter(F.col("group").bitwiseAND(F.lit(1)) == 1).count() > 0
        check(rows, docs, window, spec, solve, tokens, join)
    finally:
        spark.conf.unset("spark.nudgeframe.repeatRows")


@pytest.mark.parametrize("window,spec,solve,tokens,join", BOTH)
def test_empty_table(make_docs, window, spec, solve, tokens, join):
    assert marked(make_docs([]), spec, solve) == []


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = bytes(rng.integers(97, 97 + rng.integers(1, 4), int(rng.integers(1, 200))).astype(np.uint8))
        wanted = rng.random(len(text)) < 0.5
        order = suffix_dedup.suffix_array(text, wanted, 300)
        order = order[wanted[order]]
        assert order.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])
        shared = suffix_dedup.common_prefixes(text, order, 40)
        for k in range(1, len(order)):
            a, b = text[order[k] :], text[order[k - 1] :]
            assert shared[k] == next((n for n in range(40) if a[n : n + 1] != b[n : n + 1] or not a[n : n + 1]), 40)


def test_deduplicate_keeps_columns(make_docs, hostile):
    docs = make_docs(hostile)
    out = substring_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(hostile)
    assert all(r["n_chars"] == len(r["text"]) for r in out.select("text", "n_chars").collect() if r["text"] is not None)


def brute_kept(rows, window):
    """Text of each document after the removal, unchanged where nothing goes."""
    seen, out = {}, {}
    for doc_id, text, *_ in sorted(rows):
        parts = text.split()
        gone = np.zeros(len(parts), bool)
        for at in range(len(parts) - window + 1):
            if seen.setdefault(tuple(parts[at : at + window]), (doc_id, at)) != (doc_id, at):
                gone[at : at + window] = True
        out[doc_id] = " ".join(w for w, g in zip(parts, gone) if not g) if gone.any() else text
    return out
