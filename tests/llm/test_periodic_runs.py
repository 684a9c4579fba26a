"""Periodic runs against every lag of every document."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from nudgeframe.llm import periodic_runs


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            s = w[a : i + q]
            smallest = all(any(s[x] != s[x + p] for x in range(len(s) - p)) for p in range(1, q))
            if len(s) >= max(6, 4 * q) and smallest:
                out.append((a, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 20))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += (unit * 9)[: rng.randint(1, 5 * len(unit))]
            docs.append(w)
        flat = np.array([x for d in docs for x in d], np.int64)
        got = periodic_runs.find_runs(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert got == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d)]


def test_each_diagonal_is_extended_once(monkeypatch):
    calls = []
    plain = periodic_runs._matching
    monkeypatch.setattr(periodic_runs, "_matching", lambda *a: calls.append(a) or plain(*a))
    flat = np.zeros(100_000, np.int64)
    assert periodic_runs.find_runs(flat, np.zeros(len(flat), np.int64)) == [(0, 0, 100_000, 1)]
    assert len(calls) == 2


def test_rows_keep_their_columns_and_hostile_texts(make_docs, hostile):
    docs = make_docs(hostile)
    out = periodic_runs.with_runs(docs)
    assert out.columns == [*docs.columns, "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(hostile)
    want = sorted(((r[0] is None, r[0] or 0, r[1] or ""), plain_runs((r[1] or "").encode().split()[:400])) for r in hostile if r[0] != 204)
    for (_, _, text), runs in want:
        words = text.encode().split()
        row = next(r for r in rows if (r["text"] or "") == text)
        assert row["n_words"] == len(words)
        if len(words) <= 400:
            assert [tuple(x) for x in row["runs"]] == runs
            assert row["collapsed"] == collapsed([w.decode() for w in words], runs)
    long = next(r for r in rows if r["doc_id"] == 204)
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "na"
    assert periodic_runs.with_runs(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs.withColumnRenamed("word", "Runs"))


def test_query_on_a_written_hostile_table(spark, make_docs, hostile, tmp_path):
    rng = random.Random(2)
    rows = hostile + [(1000 + i, " ".join(rng.choice("ab cde fg".split()) for _ in range(rng.randint(1, 90))), "a") for i in range(150)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect() if r["doc_id"] not in (None, 203, 204))
    want = []
    for doc_id, text, *_ in rows:
        if doc_id in (None, 203, 204):
            continue
        w = (text or "").encode().decode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(w, runs))]
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests))
    assert got == sorted(want)
