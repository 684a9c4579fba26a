"""Substring dedup on words: prefix-partitioned suffix trees.

A window is 20 consecutive words; what starts at it is a suffix. Suffixes are dealt by
variable-length prefixes: the prefix of a suffix runs to the end of the rarest-hashed
gram of its window, so suffixes with equal windows share their prefix and group, and
groups of too frequent prefixes are cut further (``repeats``). In a memory-sized group
the subtree is built from the top: a node's suffixes are split by their next word,
leaves are dropped at once, and a node reached at a depth of 20 words is a deep internal
node: its suffixes are a maximal repeat, its earliest suffix stays.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Words covered by
any removed window go, judged on the input.

Defined cases: null and empty texts have no words; texts under 20 words keep all;
rows that repeat a doc_id with the same text are one document and get equal results,
with another text they are ordered by hash of text; null doc_ids come last; an empty
table gives no rows; extra columns are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import mix64, read
from nudgeframe.llm.repeats import MULTIPLIER, Tokens, merged, with_removed

WINDOW, GRAM = 20, 7
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INVERSE = pow(MULTIPLIER, -1, 2**64)
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", MULTIPLIER), ("down", _INVERSE)):
            out = np.ones(size, np.uint64)
            have, power = 1, base
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(power)
                have, power = 2 * have, power * power % 2**64
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, row offsets in words) of the words of consecutive rows."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False  # a row's first word begins at its first byte
    begins = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets, "left")


def _read(data: np.ndarray, offsets: np.ndarray):
    begins, ends, rows = word_bounds(data, offsets)
    if not len(begins):
        return np.zeros(0, np.uint64), rows
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)), rows


def _bodies(data, offsets, row, start, size):
    """Words from ``start``, joined by one space."""
    begins, ends, rows = word_bounds(data, offsets)
    raw = data.tobytes()
    a, b = begins[rows[row] + start].tolist(), ends[rows[row] + start + size - 1].tolist()
    return [b" ".join(raw[i:j].split()) for i, j in zip(a, b)]


WORDS = Tokens(WINDOW, GRAM, _read, _bodies)


def deep_nodes(ids: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Node at ``depth`` of each suffix, -1 where it left the tree as a leaf earlier.

    The tree is built level by level from the root; a level splits every open node by
    the next word of its suffixes.
    """
    node = np.full(len(suffixes), -1, np.int64)
    live, group = np.arange(len(suffixes)), np.zeros(len(suffixes), np.int64)
    words = int(ids.max(initial=0)) + 1
    for level in range(depth):
        key = group * words + ids[suffixes[live] + level]
        order = np.argsort(key, kind="stable")
        key, live = key[order], live[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.cumsum(new) - 1
        size = np.bincount(number, minlength=1)[number] if len(number) else number
        inner = size > 1
        live, group = live[inner], number[inner]
        if not len(live):
            return node
        # Close up the numbers so that keys stay small.
        group = np.cumsum(np.append(0, np.diff(group) != 0))
    node[live] = group
    return node


def equal_windows(bodies: list[bytes], sizes: np.ndarray):
    """See ``repeats.removed_windows``: classes are the deep nodes; leaves are classes of their own."""
    known: dict = {}
    split = [b.split(b" ") for b in bodies]
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64)
    begins = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    sizes = np.asarray(sizes, np.int64)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    node = deep_nodes(ids, begins[owner] + offset, WINDOW)
    leaf = node < 0
    node[leaf] = int(node.max(initial=-1)) + 1 + np.arange(int(leaf.sum()))

    def digest(owners, offsets):
        raw = b"".join(
            hashlib.blake2b(b" ".join(split[o][i : i + WINDOW]), digest_size=16).digest() for o, i in zip(owners.tolist(), offsets.tolist())
        )
        halves = np.frombuffer(raw, np.int64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]

    return owner, offset, node, digest


def _kept(text: str, runs) -> tuple[int, int, list[bytes]]:
    words = (text or "").encode().split()
    spans = merged(runs, WINDOW, len(words))
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return len(words), sum(b - a for a, b in spans), kept + words[at:]


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as text (and n_chars, if there is one, to match)."""
    marked = with_removed(docs, WORDS, equal_windows)
    at, last, names = marked.columns.index("text"), len(marked.columns) - 1, docs.columns

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = []
                for text, runs in zip(part.column(at).to_pylist(), part.column(last).to_pylist()):
                    texts.append(b" ".join(_kept(text, runs)[2]).decode() if runs else text)
                columns = [pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(last)]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words, removed, kept = _kept(text, runs)
                    rows.append((words, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
                columns = [part.column(0), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_removed(docs, WORDS, equal_windows).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
