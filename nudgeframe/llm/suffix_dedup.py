"""Suffix-array dedup on bytes: two-stage sorting.

Documents are UTF-8 bytes and a window is 100 of them. Candidate windows come together
in groups (``repeats``); a block of groups is one text whose suffix array is built in
two stages:

1. suffixes smaller than their successor are sorted directly, by their first 100 bytes;
2. the others are induced: scanning the buckets of first bytes in order, each suffix
   met puts the one before it into its bucket, if that one is larger than its successor.
   Within a bucket the induced come before the directly sorted.

Only suffixes that begin a window are needed, with those up to the next directly sorted
one behind a region. Adjacent common prefixes are then computed up to 100 bytes, and
neighbours with all 100 in common are equal windows.

Bytes covered by any removed window go, judged on the input.

Defined cases: null and empty texts have no bytes; texts under 100 bytes keep all; rows
that repeat a doc_id with the same text are one document and get equal results, with
another text they are ordered by hash of text; null doc_ids come last; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import read, utf8
from nudgeframe.llm.repeats import Tokens, merged, with_removed

WINDOW, GRAM = 100, 24


def _read(data, offsets):
    return data.astype(np.uint64) + np.uint64(1), offsets


def _bodies(data, offsets, row, start, size):
    raw = data.tobytes()
    begins = (offsets[row] + start).tolist()
    return [raw[a : a + n] for a, n in zip(begins, size.tolist())]


BYTES = Tokens(WINDOW, GRAM, _read, _bodies)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a byte later; the last is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = text[change] < text[change + 1]
    # Equal neighbours compare as the next unequal pair does; without one, the end decides.
    at = np.searchsorted(change, np.arange(n), "left")
    return np.append(rising, False)[at]


def suffix_array(text: bytes, wanted: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes marked in ``wanted``, and those that induce them, in order of their first ``depth`` bytes."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    small = smaller_than_next(data)
    # A larger suffix is induced by its successor: want all up to the next small one.
    stops = np.append(np.flatnonzero(small), n)
    ahead = stops[np.searchsorted(stops, np.flatnonzero(wanted), "left")]
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, np.flatnonzero(wanted), 1)
    np.add.at(mark, ahead + 1, -1)
    needed = np.cumsum(mark)[:n] > 0
    # Stage one.
    direct = np.flatnonzero(needed & small)
    keys = [text[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    bucket_ends = np.cumsum(np.bincount(data[direct], minlength=256)) if len(direct) else np.zeros(256, np.int64)
    # Stage two.
    pending: list[list] = [[] for _ in range(256)]
    if n and needed[n - 1] and not small[n - 1]:
        pending[data[n - 1]].append(np.array([n - 1]))
    out = []

    def pass_on(found, byte):
        before = found[found > 0] - 1
        before = before[needed[before] & (data[before] > byte)]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            begins = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for part in np.split(before, begins[1:]):
                pending[data[part[0]]].append(part)

    for byte in range(256):
        begin = int(bucket_ends[byte - 1]) if byte else 0
        own = direct[begin : int(bucket_ends[byte])]
        if not pending[byte] and not len(own):
            continue
        induced = []
        front = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        while len(front):  # runs of one byte lead into their own bucket
            induced.append(front)
            before = front[front > 0] - 1
            front = before[needed[before] & (data[before] == byte)]
        found = np.concatenate([*induced, own])
        pass_on(found, byte)
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: bytes, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, up to ``most``."""
    data = np.frombuffer(text + b"\0" * (most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(data, (len(text) + most, 8), (1, 1))
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    while len(live):
        a, b = order[live] + shared[live], order[live - 1] + shared[live]
        left = np.ascontiguousarray(words[a]).view(">u8").reshape(-1)
        right = np.ascontiguousarray(words[b]).view(">u8").reshape(-1)
        differ = (left ^ right).astype(np.uint64)
        whole = differ == 0
        # Leading equal bytes of the first unequal eight.
        lead = np.zeros(len(live), np.int64)
        for k in range(1, 8):
            lead += (differ >> np.uint64(64 - 8 * k)) == 0
        shared[live] += np.where(whole, 8, lead)
        live = live[whole & (shared[live] < most)]
    limit = np.minimum(len(text) - order, most)
    limit[1:] = np.minimum(limit[1:], limit[:-1]) if len(order) > 1 else limit[1:]
    return np.minimum(shared, limit)


def equal_windows(bodies: list[bytes], sizes: np.ndarray):
    """See ``repeats.removed_windows``: classes are runs of the suffix array with full common prefixes."""
    text = b"".join(bodies)
    sizes = np.asarray(sizes, np.int64)
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = np.zeros(len(text), bool)
    place = begins[owner] + offset
    wanted[place] = True
    order = suffix_array(text, wanted)
    order = order[wanted[order]]
    cls_of = np.zeros(len(text), np.int64)
    cls_of[order] = np.cumsum(common_prefixes(text, order) < WINDOW)

    def digest(owners, offsets):
        at = (begins[owners] + offsets).tolist()
        raw = b"".join(hashlib.blake2b(text[i : i + WINDOW], digest_size=16).digest() for i in at)
        halves = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]

    return owner, offset, cls_of[place], digest


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                spans = merged(runs, WINDOW, len(text))
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
            if rows:
                columns = [batch.column(0), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_removed(docs, BYTES, equal_windows).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
