"""Document fingerprints: digests of improbable features in chained Bloom filters.

1. Every 64-byte window has the Shannon entropy of its bytes, cut into 1,001 classes.
   A first pass counts the classes over the whole corpus; rarer classes rank first
   (the table has 1,001 rows, whatever the corpus). Windows of nearly constant bytes
   are never features.
2. Among each 64 consecutive windows the best rank wins, leftmost in a tie. Windows
   that win at least 16 times are the document's features.
3. Features enter Bloom filters of 256 bytes with five bits each, 160 features to a
   filter; the filters chained, as hex, are the fingerprint. A text under 64 bytes is
   one feature; a text whose windows all fall short keeps its best one.
4. Likeness of two filters is their bit overlap between what chance gives (plus a
   margin) and the most it could be, scaled to 0..1; of two fingerprints it is the
   mean over the filters of the shorter one of their best partner.

Neighbours: documents are dealt into ranges of descending doc_id by cut points, one
range is read in order, and each range also gets the head of the following one, so
texts are shuffled once and no window spans the table.

Defined cases: null and empty texts have the fingerprint '' (alike 1.0 to each other,
0.0 to all else); null doc_ids come last; rows of one doc_id are ordered by hash of
text; the next of an only row is itself; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import mix64, order_id, partitions_of, read, slices, utf8

FEATURE, NEIGHBOURS, POPULAR = 64, 64, 16
FILTER_BYTES, BITS_EACH, PER_FILTER = 256, 5, 160
CLASSES, LEAST_CLASS = 1001, 100
CHUNK = 1 << 21
BLOCK = 1 << 17
_COUNTS = np.arange(FEATURE + 1, dtype=float)
#: c log2 c in millionths of a bit, and what one more of c equal bytes adds.
_LOGS = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 1e6).astype(np.int64)
_GAIN = np.append(np.diff(_LOGS), 0)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of the 64-byte window at each byte of ``data`` that has one.

    ``left`` and ``right`` count equal bytes among the 63 before and after each byte.
    Moving the window by one byte takes ``_GAIN[right]`` of the leaving byte off the sum
    of c log2 c and adds ``_GAIN[left]`` of the entering one.
    """
    windows = len(data) - FEATURE + 1
    if windows <= 0:
        return np.zeros(0, np.int16)
    left, right = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for begin in range(0, len(data), BLOCK):
        part = data[begin : begin + BLOCK + FEATURE - 1]
        into, out = left[begin : begin + len(part)], right[begin : begin + BLOCK]
        for d in range(1, min(FEATURE, len(part))):
            same = (part[d:] == part[:-d]).view(np.uint8)
            # Pairs that begin in this block count here, so none counts twice.
            owned = same[: len(out)]
            out[: len(owned)] += owned
            into[d : d + len(owned)] += owned
    steps = _GAIN[left[FEATURE:]] - _GAIN[right[: windows - 1]]
    first = _LOGS[np.bincount(data[:FEATURE], minlength=256)].sum()
    total = first + np.concatenate([[0], np.cumsum(steps)])
    bits = 6.0 - total / (FEATURE * 1e6)
    return np.clip((bits / 6.0 * (CLASSES - 1) + 1e-9).astype(np.int16), 0, CLASSES - 1)


def inside_rows(offsets: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of the first ``size`` starts have ``width`` places within their row."""
    ok = np.ones(max(size, 0), bool)
    for end in offsets[1:-1]:
        ok[max(0, end - width + 1) : end] = False
    return ok


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    classes = entropy_classes(data)
    return np.bincount(classes[inside_rows(offsets, FEATURE, len(classes))], minlength=CLASSES)


def rarity(counts) -> np.ndarray:
    """Rank of each class, rarest first; low classes rank never."""
    counts = np.asarray(counts, np.int64)
    ranks = np.empty(CLASSES, np.uint64)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    ranks[:LEAST_CLASS] = CLASSES
    return ranks


def _features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions, row of each) of the features of all rows of 64 bytes or more."""
    classes = entropy_classes(data)
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ranks[classes] << np.uint64(32) | np.arange(len(classes), dtype=np.uint64)
    key[~inside_rows(offsets, FEATURE, len(classes))] = np.uint64(2**63)
    best = key
    for step in (1, 2, 4, 8, 16, 32):
        if len(best) > step:
            best = np.minimum(best[:-step], best[step:])
    rows = np.arange(len(offsets) - 1)
    sizes = np.diff(offsets) - FEATURE + 1
    spans = np.minimum(np.maximum(sizes, 0), len(classes))
    # Rows with enough windows for a full neighbourhood.
    if len(classes) >= NEIGHBOURS:
        valid = inside_rows(offsets, FEATURE + NEIGHBOURS - 1, len(best))
        won = best[valid]
    else:
        won = np.zeros(0, np.uint64)
    place = (won & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.diff(place, prepend=-1) != 0)
    times = np.diff(np.append(change, len(place)))
    popular = (times >= POPULAR) & ((won[change] >> np.uint64(32)) < CLASSES)
    chosen = place[change][popular]
    row = np.searchsorted(offsets, chosen, "right") - 1
    # Rows left without a feature keep their best window.
    bare = rows[(spans > 0) & ~np.isin(rows, row)]
    if len(bare):
        extra = np.array([np.argmin(key[offsets[r] : offsets[r] + spans[r]]) + offsets[r] for r in bare])
        chosen, row = np.concatenate([chosen, extra]), np.concatenate([row, bare])
        order = np.argsort(chosen, kind="stable")
        chosen, row = chosen[order], row[order]
    return chosen, row


def _filters(words: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """Chained filters (n, 256) of each row; ``words`` are features as eight 64-bit words."""
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = mix64(h + words[:, j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
    counts = np.bincount(row, minlength=rows)
    starts = np.concatenate([[0], np.cumsum(counts)])
    number = (np.arange(len(row)) - starts[row]) // PER_FILTER
    per_row = -(-counts // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(per_row)])
    bits = np.zeros(int(base[-1]) * FILTER_BYTES * 8, bool)
    at = (base[row] + number) * (FILTER_BYTES * 8)
    for j in range(BITS_EACH):
        bits[at + ((h >> np.uint64(11 * j)) & np.uint64(2047)).astype(np.int64)] = True
    packed = np.packbits(bits).reshape(-1, FILTER_BYTES)
    return [packed[base[r] : base[r + 1]] for r in range(rows)]


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Fingerprint of each text as an array (filters, 256)."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out: list = [None] * len(texts)
    joined = np.frombuffer(b"".join(texts) + b"\0" * FEATURE, np.uint8)
    for i, j in slices(offsets, CHUNK):
        data, own = joined[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        place, row = _features(data, own, ranks)
        short = [r for r in range(j - i) if 0 < own[r + 1] - own[r] < FEATURE]
        windows = np.lib.stride_tricks.sliding_window_view(joined[offsets[i] : offsets[j] + FEATURE], FEATURE)[place].copy()
        if short:
            padded = np.array([list(texts[i + r].ljust(FEATURE, b"\0")) for r in short], np.uint8)
            windows, row = np.concatenate([windows, padded]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            windows, row = windows[order], row[order]
        out[i:j] = _filters(np.ascontiguousarray(windows).view(np.uint64), row, j - i)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two chains of filters."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    ones = np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for own in a:
        n = int(np.bitwise_count(own).sum())
        shared = np.bitwise_count(own & b).sum(1, dtype=np.int64)
        chance, most = n * ones / (FILTER_BYTES * 8), np.minimum(n, ones)
        floor = chance + 0.3 * (most - chance)
        total += float(np.max(np.where(most > floor, np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1), shared >= most)))
    return total / len(a)


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Rarity of the classes over every window of every document."""

    def count(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, CHUNK):
                total += class_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["c", "n"])

    rows = docs.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for row in rows:  # one row a class
        counts[row["c"]] = row["n"]
    return rarity(counts)


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, tail in ranges of descending order; a row with tail ends each range.

    The tail row repeats the head of the following range (of the first one after the last).
    """
    ranges = 4 * partitions_of(docs)
    keyed = docs.select("doc_id", "text", order_id().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    ids = keyed.select(F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(F.col("k")).alias("k"), "h")
    cuts = ids.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect()
    bounds = np.array(sorted({r["k"] for r in cuts})[1:], np.int64)  # a row a range

    @F.pandas_udf("long")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, k.to_numpy(np.int64), "right"))

    # Null ids are last in descending order.
    k = F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(F.col("k"))
    keyed = keyed.withColumn("k", k)
    heads = (
        ids.withColumn("p", range_of("k")).groupBy("p").agg(F.min(F.struct(F.bitwise_not("k").alias("nk"), "k", "h")).alias("m")).collect()
    )
    heads = sorted((r["p"], r["m"]["k"], r["m"]["h"]) for r in heads)
    follow = [(p, *heads[(i + 1) % len(heads)][1:]) for i, (p, _, _) in enumerate(heads)]
    tails = docs.sparkSession.createDataFrame(follow, "p long, k long, h long")
    tail_rows = keyed.join(F.broadcast(tails), ["k", "h"]).select("doc_id", "text", "k", "h", "p", F.lit(1).alias("tail"))
    own = keyed.withColumn("p", range_of("k")).withColumn("tail", F.lit(0))
    every = own.unionByName(tail_rows)
    return every.repartition(partitions_of(docs), "p").sortWithinPartitions("p", "tail", F.desc("k"), "h").select("doc_id", "text", "tail")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """The columns of ``op5``: fingerprints of each text, its edited text, and likenesses."""
    ranks = corpus_ranks(docs)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def flush(rows):
        """``rows`` holds one more row than it emits."""
        texts = [t.encode() for _, t, _ in rows]
        edited, emit = [], []
        for i, ((doc_id, text, tail), (_, following, _)) in enumerate(zip(rows, rows[1:])):
            if not tail:
                k = len(text) // 3
                edited.append((text[: len(text) - k] + following[:k]).encode())
                emit.append(i)
        prints, edits = digests(texts, ranks), digests(edited, ranks)
        out = []
        for i, text, new in zip(emit, edited, edits):
            out.append(
                (rows[i][0], len(rows[i][1]), hashlib.sha256(text).hexdigest(), prints[i].tobytes().hex(), new.tobytes().hex(),
                 likeness(prints[i], new), likeness(prints[i], prints[i + 1]))
            )
        if out:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc_id, text, tail in zip(*(part.column(c).to_pylist() for c in range(3))):
                    rows.append((doc_id, text or "", tail))
                    held += len(rows[-1][1])
                    if held > CHUNK:
                        yield from flush(rows)
                        rows, held = rows[-1:], 0
        if len(rows) > 1:
            yield from flush(rows)

    return in_descending_ranges(docs).mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fingerprint_neighbours(docs)
