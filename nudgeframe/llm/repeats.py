"""Exact repeated windows over a corpus: what the two substring operators share.

A window is a run of ``window`` tokens of one document. It is removed when an equal
window starts earlier, by (document, start). Only candidates travel:

1. The smallest hash among a window's grams is its anchor. Equal windows have equal
   anchors, and consecutive windows mostly share one, so a document is a list of
   regions (anchor, first window, number of windows).
2. An anchor that occurs once cannot repeat. Regions are dealt by anchor and sorted;
   runs of one row end there, unless the region holds its anchor more than once. Anchors that a sample of documents shows to be frequent (at
   most ``1 / HOT_SHARE`` of them can be, so their list is broadcast) are salted by
   document first and kept, and runs longer than ``RUN`` rows are cut into parts.
3. Surviving regions fetch their text from the documents, which are dealt by id once;
   the same exchange serves the anchors before and the result after.
4. Regions meet in groups of one anchor (or one part of a frequent one), where
   ``solve`` finds equal windows. A group of a cut anchor also returns one row for
   each distinct window, the earliest of the group; their minimum over the parts
   settles the rest.

Documents equal to an earlier one in their whole text are settled before all this: each
of their windows starts earlier, so all of a copy goes, or nothing if it has no window.

Nothing is dropped or capped: sampling and sizes decide where rows go only. Hashes
choose candidates; equality is decided on texts, and between parts of a cut anchor on
128-bit digests.

Documents are told apart by (order of doc_id, 64-bit hash of their text), a column each
beside every place: rows that repeat a doc_id with the same text are one document, with
other texts they are ordered by that hash. Null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.llm.common import cut, mix64, order_id, partitions_of, slices, utf8

#: Rows of one anchor in a group; regions are of at most REGION windows.
RUN, REGION = 4096, 1024
#: One document in SAMPLE is looked at for anchors above HOT_SHARE of all regions.
SAMPLE, HOT_SHARE, HOT_ROWS = 64, 1 / 2000, 16
CHUNK = 1 << 20
BLOCK_BYTES = 1 << 21
#: Stands for all windows of a document.
COPY = -1
MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Tokens:
    """How a text falls into tokens.

    ``read(data, offsets)`` gives (hash of every token, offsets of rows in tokens);
    ``bodies(data, offsets, row, start, size)`` the bytes that stand for ``size``
    tokens from ``start`` of a row, for arrays of regions.
    """

    window: int
    gram: int
    read: Callable
    bodies: Callable


def gram_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens at each place, by doubling."""
    done, have, power, out, covered = tokens, 1, MULTIPLIER, None, 0
    mask, rest = 2**64 - 1, size
    while rest:
        if rest & 1:
            if out is None:
                out, covered = done, have
            else:
                n = len(tokens) - covered - have + 1
                out, covered = out[:n] * np.uint64(power) + done[covered : covered + n], covered + have
        rest >>= 1
        if rest:
            n = len(done) - have
            done = done[:n] * np.uint64(power) + done[have : have + n]
            have, power = 2 * have, power * power & mask
    return mix64(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def regions_of(tokens: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(row, start, windows, anchor) of the regions of consecutive rows."""
    n = len(tokens) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    grams = gram_hashes(tokens, gram)
    anchor = sliding_min(grams, window - gram + 1)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - window + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchor[at[1:]] != anchor[at[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    long = size > REGION
    if long.any():  # cut into equal regions of at most REGION windows
        cuts = -(-size // REGION)
        k = np.repeat(np.arange(len(first)), cuts)
        j = np.arange(len(k)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        size = np.minimum(size[k] - j * REGION, REGION)
        first = first[k] + j * REGION
    start = at[first]
    several = _several(anchor, grams, start, size, window - gram + 1)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], size | several << 15, anchor[start].view(np.int64)


def _several(anchor, grams, start, size, width):
    """1 for regions in which the anchor gram stands at more than one place."""
    # A gram that is the smallest of some window equals the largest of its windows' minima.
    edge = np.zeros(width - 1, np.uint64)
    leads = np.flatnonzero(~sliding_min(~np.concatenate([edge, anchor, edge]), width) == grams)
    low, high = np.searchsorted(leads, start), np.searchsorted(leads, start + size - 1 + width)
    counts = high - low
    region = np.repeat(np.arange(len(start)), counts)
    at = leads[np.arange(len(region)) - np.repeat(np.cumsum(counts) - counts, counts) + low[region]]
    same = grams[at] == anchor[start[region]]
    return (np.bincount(region[same], minlength=len(start)) > 1).astype(np.int64)


def _all_regions(spec: Tokens, data, offsets):
    """Regions of a batch; long rows are read in overlapping pieces."""
    out = []
    for i, j in slices(offsets, CHUNK):
        tokens, own = spec.read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if j - i > 1 or len(tokens) <= 2 * CHUNK:
            found = regions_of(tokens, own, spec.window, spec.gram)
            out.append((found[0] + i, *found[1:]))
        else:
            for a in range(0, len(tokens) - spec.window + 1, CHUNK):
                piece = tokens[a : a + CHUNK + spec.window - 1]
                found = regions_of(piece, np.array([0, len(piece)]), spec.window, spec.gram)
                out.append((found[0] + i, found[1] + a, *found[2:]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def pack(start, size):
    """Places in one number; bit 15 of ``size`` marks regions that hold their anchor more than once."""
    return start << np.int64(16) | size


def unpack(at):
    return at >> 16, at & 0x7FFF


def with_key(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, then doc (ordered id) and version (the text's hash, its lowest 15 bits foremost)."""
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    turned = F.shiftleft(h, 49).bitwiseOR(F.shiftrightunsigned(h, 15))
    # The sign bit is flipped so that signed order is that of the turned bits.
    return docs.select(*docs.columns, order_id().alias("__doc"), turned.bitwiseXOR(F.lit(-(2**63))).alias("__v"))


def first_texts(keyed: DataFrame) -> DataFrame:
    """(__doc, __v) of the earliest document of each text; minima are taken before the shuffle."""
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)
    least = keyed.groupBy(digest.alias("digest")).agg(F.min(F.struct("__doc", "__v")).alias("least"))
    return least.select("least.*").distinct()


def occurrences(keyed: DataFrame, spec: Tokens) -> DataFrame:
    """(h, doc, v, at) of every region of every document."""
    places = [keyed.columns.index(c) for c in ("text", "__doc", "__v")]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(places[0]))
            doc, version = (batch.column(c).to_numpy(zero_copy_only=False) for c in places[1:])
            row, start, size, anchor = _all_regions(spec, data, offsets)
            at = pack(start, size)
            own = (doc[row], version[row]) if len(row) else (at, at)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, *own, at)], ["h", "doc", "v", "at"])

    # All columns go in, so that the exchange below is the same as for the result.
    return keyed.mapInArrow(run, "h long, doc long, v long, at long")


def frequent_anchors(keyed: DataFrame, spec: Tokens) -> DataFrame:
    """(hot, salts): fewer than 1 / HOT_SHARE anchors, from one document in SAMPLE."""
    sampled = keyed.filter(F.pmod(F.xxhash64("__doc", "__v"), F.lit(SAMPLE)) == 0)
    counts = cut(occurrences(sampled.select("text", "__doc", "__v"), spec).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, total * HOT_SHARE)
    return counts.filter(F.col("n") >= least).select(F.col("h").alias("hot"), F.ceil(F.col("n") * SAMPLE / run_rows(keyed)).cast("int").alias("salts"))


def run_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.nudgeframe.repeatRows", str(RUN)))


def _repeated(batches, most: int):
    """Drops runs of one row of (h, salt); numbers parts of ``most`` rows; the lowest bit of group marks cut anchors."""
    names = ["doc", "v", "at", "group"]
    carry, opened, seen = None, None, 0

    def emit(rows, begins, known_open):
        h, doc, version, at, salt = rows
        sizes = np.diff(np.append(begins, len(h)))
        index = np.arange(len(h)) - np.repeat(begins, sizes)
        size = np.repeat(sizes, sizes)
        if known_open and len(begins):
            index[: sizes[0]] += seen
        is_cut = (size > most) | (salt >= 0)
        if known_open and len(begins):
            is_cut[: sizes[0]] = True
        keep = (size > 1) | is_cut | (at >> 15 & 1 == 1)
        part = (index // most).astype(np.uint64)
        group = mix64(h.view(np.uint64) + np.uint64(MULTIPLIER) * (part + np.uint64(1)) + mix64((salt + 2).astype(np.uint64)))
        group = (group & ~np.uint64(1) | is_cut.astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, version, at, group)], names)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        if carry is not None:
            rows = [np.concatenate(p) for p in zip(carry, rows)]
        h, *_, salt = rows
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        begins = np.flatnonzero(new)
        known = opened == (int(h[0]), int(salt[0]))
        last = int(begins[-1])
        if len(h) - last > most or known and last == 0:
            yield emit(rows, begins, known)
            seen = (seen if known and last == 0 else 0) + len(h) - last
            opened, carry = (int(h[-1]), int(salt[-1])), None
        else:
            if last:
                yield emit([c[:last] for c in rows], begins[:-1], known)
                opened, seen = None, 0
            carry = [c[last:] for c in rows]
    if carry is not None and len(carry[0]):
        yield emit(carry, np.zeros(1, np.int64), opened == (int(carry[0][0]), int(carry[4][0])))


def repeated_regions(keyed: DataFrame, spec: Tokens, unique: DataFrame | None = None) -> DataFrame:
    """(doc, v, at, group) of regions whose anchor occurs more than once among ``unique`` documents."""
    hot = frequent_anchors(keyed, spec)
    found = occurrences(keyed if unique is None else unique, spec).join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc", "v"), F.col("salts"))).cast("long")
    dealt = found.select("h", "doc", "v", "at", salt.alias("salt")).repartition(partitions_of(keyed), "h", "salt")
    most = run_rows(keyed)
    return dealt.sortWithinPartitions("h", "salt").mapInArrow(lambda it: _repeated(it, most), "doc long, v long, at long, group long")


def region_bodies(texts: DataFrame, regions: DataFrame, spec: Tokens) -> DataFrame:
    """(group, doc, v, at, body): the text of each region."""
    lists = regions.groupBy(F.col("doc").alias("__doc"), F.col("v").alias("__v")).agg(
        F.collect_list(F.struct("at", "group")).alias("__regions")
    )
    joined = texts.join(lists, ["__doc", "__v"])
    at_text, at_doc, at_version, at_list = (joined.columns.index(c) for c in ("text", "__doc", "__v", "__regions"))

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                data, offsets = utf8(part.column(at_text))
                lists = part.column(at_list)
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                at, group = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                row = np.repeat(np.arange(len(counts)), counts)
                start, size = unpack(at)
                bodies = spec.bodies(data, offsets, row, start, size + spec.window - 1)
                doc, version = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in (at_doc, at_version))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (group, doc, version, at)), pa.array(bodies, pa.binary())], ["group", "doc", "v", "at", "body"]
                )

    return joined.mapInArrow(run, "group long, doc long, v long, at long, body binary")


def _blocks(batches):
    """Arrays (group, doc, version, at, bodies) of whole groups, about BLOCK_BYTES each."""
    held, size = [], 0

    def take(parts):
        joined = [np.concatenate([p[c] for p in parts]) for c in range(4)]
        return (*joined, [b for p in parts for b in p[4]])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in range(4)) + (part.column(4).to_pylist(),))
            size += part.column(4).nbytes
            if size >= BLOCK_BYTES:
                group, doc, version, where, bodies = take(held)
                edge = len(group) - int(np.argmax(group[::-1] != group[-1]))
                if group[0] != group[-1]:
                    yield group[:edge], doc[:edge], version[:edge], where[:edge], bodies[:edge]
                    held, size = [(group[edge:], doc[edge:], version[edge:], where[edge:], bodies[edge:])], sum(map(len, bodies[edge:]))
                else:
                    held = [(group, doc, version, where, bodies)]
    if held:
        yield take(held)


def _solve_block(block, window: int, equal_windows):
    """Removed regions and, for cut anchors, the earliest place of each distinct window."""
    group, doc, version, at, bodies = block
    start, size = unpack(at)
    order = np.lexsort((start, version, doc))
    # Regions of equal text collapse to their earliest; the others go as a whole.
    first: dict = {}
    removed_doc, removed_version, removed_at, kept = [], [], [], []
    for i in order.tolist():
        j = first.setdefault(bodies[i], i)
        if j == i:
            kept.append(i)
        elif (doc[j], version[j], at[j]) != (doc[i], version[i], at[i]):
            removed_doc.append(doc[i])
            removed_version.append(version[i])
            removed_at.append(at[i])
    kept = np.array(kept, np.int64)  # in order of (doc, version, start)
    owner, offset, cls, digest = equal_windows([bodies[i] for i in kept], size[kept])
    rank = owner.astype(np.int64) << 32 | offset  # owner numbers follow the order of places
    by = np.lexsort((rank, cls))
    owner, offset, cls = owner[by], offset[by], cls[by]
    new = np.ones(len(cls), bool)
    new[1:] = cls[1:] != cls[:-1]
    later = ~new
    place = np.sort((owner[later].astype(np.int64) << 32) | offset[later])
    if len(place):
        breaks = np.flatnonzero(np.append(True, np.diff(place) != 1))
        runs = np.diff(np.append(breaks, len(place)))
        own, off = place[breaks] >> 32, place[breaks] & 0xFFFFFFFF
        removed_doc.extend(doc[kept[own]])
        removed_version.extend(version[kept[own]])
        removed_at.extend(pack(start[kept[own]] + off, runs))
    n = len(removed_doc)
    settled = [np.array(c, np.int64) for c in (removed_doc, removed_version, removed_at)]
    out = [*settled, settled[0] ^ settled[1], settled[2], np.ones(n, bool)]
    cut_owner = (group[kept] & 1).astype(bool) if len(kept) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    lead = lead[cut_owner[owner[lead]]] if len(lead) else lead
    if len(lead):
        d = digest(owner[lead], offset[lead])
        o = kept[owner[lead]]
        extra = [doc[o], version[o], pack(start[o] + offset[lead], np.ones(len(lead), np.int64)), d[0], d[1], np.zeros(len(lead), bool)]
        out = [np.concatenate(p) for p in zip(out, extra)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["doc", "v", "at", "d1", "d2", "removed"])


def removed_windows(keyed: DataFrame, texts: DataFrame, firsts: DataFrame, spec: Tokens, equal_windows) -> DataFrame:
    """(doc, v, at): runs of windows to remove from the earliest documents of each text.

    ``equal_windows(bodies, sizes)`` gives (owner, offset, class) of every window of the
    given regions, equal windows having equal classes, and a function from (owner,
    offset) to two 64-bit halves of a digest of the window.
    """
    # An inner join: a semi join would move below the exchange and make another of it.
    unique = texts.join(firsts, ["__doc", "__v"])
    bodies = region_bodies(texts, repeated_regions(keyed, spec, unique), spec)

    def run(batches):
        for block in _blocks(batches):
            yield _solve_block(block, spec.window, equal_windows)

    dealt = bodies.repartition(partitions_of(keyed), "group").sortWithinPartitions("group")
    solved = dealt.mapInArrow(run, "doc long, v long, at long, d1 long, d2 long, removed boolean")
    # Parts of a cut anchor: a window's earliest place stays, one row a part and window.
    # Rows already settled pass through the same window, spread by place, so that the
    # whole plan is one query and the texts' exchange serves both of its ends.
    place = F.struct("doc", "v", F.shiftright("at", 16).alias("s"))
    later = F.dense_rank().over(Window.partitionBy("d1", "d2").orderBy(place)) > 1
    return solved.withColumn("later", later).filter("removed or later").select("doc", "v", "at")


def with_removed(docs: DataFrame, spec: Tokens, equal_windows) -> DataFrame:
    """All columns of ``docs`` and ``__runs``, a list of packed window runs (or null); [-1] for a whole copy."""
    keyed = with_key(docs)
    # Dealt once: the exchange is read for anchors, for the regions' texts and for the result.
    texts = keyed.repartition(partitions_of(docs), "__doc", "__v")
    firsts = first_texts(keyed)
    removed = removed_windows(keyed, texts, firsts, spec, equal_windows)
    lists = removed.groupBy(F.col("doc").alias("__doc"), F.col("v").alias("__v")).agg(F.collect_list("at").alias("__runs"))
    out = texts.join(lists, ["__doc", "__v"], "left").join(firsts.withColumn("__first", F.lit(True)), ["__doc", "__v"], "left")
    runs = F.when(F.col("__first"), F.col("__runs")).otherwise(F.array(F.lit(COPY).cast("long")))
    return out.select(*[F.col(c) for c in docs.columns], runs.alias("__runs"))


def merged(runs: list[int] | None, window: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed token ranges [a, b) of a document of ``size`` tokens."""
    if runs and runs[0] == COPY:
        return [(0, size)] if size >= window else []
    out: list = []
    for at in sorted(runs or (), key=lambda x: x >> 16):
        a, b = at >> 16, (at >> 16) + (at & 0x7FFF) - 1 + window
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
