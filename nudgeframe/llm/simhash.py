"""SimHash near-duplicates: pigeonring filtering before the full Hamming check.

Fingerprints: words are lower-cased (A-Z), shingled by four and hashed by XXH64; a
bit is set when over half of a document's shingles set it. Only distinct fingerprints
go on, with the smallest doc_id of each.

Candidates: 64 bits are a ring of 8 segments of 8 bits. For two fingerprints at 4 or
fewer bits, some rotation has, for every length l, at most l/2 differing bits in its
first l segments. The segments of such a chain that do not differ at all number four
or more, so the pair shares at least one of the 70 choices of four segments: those are
the bucket keys. In a bucket, the chain condition is tested on every pair still of
interest, and only pairs with a viable rotation reach the Hamming check.

Work in a bucket: members are visited breadth first, each against the members not
yet reached, so a dense group costs little more than its size and gives links of a
spanning forest, never all pairs. Buckets found hot in a sample of the keys are cut
into blocks, and every pair of blocks is a task of its own; the sample decides where
to cut only, nothing is left out.

Links are joined to components by repeated star steps (``components``).

Defined cases: null and empty texts have fingerprint zero and link like others; fewer
than four words are one shingle; repeated rows share a component; null doc_id counts
as the largest id, and a component of such rows alone has a null id, so component ids
need not be unique (``root`` is); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nudgeframe.llm.common import LAST_ID, cut, order_id, partitions_of, read, slices, utf8
from nudgeframe.llm.components import connected_components

SHINGLE, SEED, BITS, SEGMENTS = 4, 42, 4, 8
#: Members of a bucket that one task compares; larger buckets are cut into blocks.
BLOCK = 50_000
#: One fingerprint in so many is looked at for hot buckets.
SAMPLE = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
KEYS = [sum(255 << (8 * s) for s in kept) for kept in combinations(range(SEGMENTS), SEGMENTS - BITS)]


def shingle_hashes(text: bytes) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return [digest(view[a:b], SEED) for a, b in zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text as int64 bits."""
    hashes = [shingle_hashes(t) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out.view(np.int64)
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    for bit in range(64):
        ones = np.add.reduceat((flat >> np.uint64(bit)) & np.uint64(1), starts)
        out[some] |= (2 * ones > counts[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            fps = []
            for i, j in slices(offsets, 1 << 21):
                fps.append(fingerprints([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)]))
            fp = np.concatenate(fps) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def viable(xor: np.ndarray) -> np.ndarray:
    """Pairs with a rotation whose every prefix of l segments has at most l * BITS / SEGMENTS bits."""
    d = np.bitwise_count(xor.reshape(-1, 1).view(np.uint8)).reshape(-1, SEGMENTS)
    sums, good = np.zeros_like(d), np.ones(d.shape, bool)
    for length in range(1, SEGMENTS + 1):
        sums = sums + np.roll(d, 1 - length, axis=1)
        good &= sums <= length * BITS // SEGMENTS
    return good.any(axis=1)


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of ``members`` (uint64, distinct): (member, smallest of its tree)."""
    left, a, b = members.copy(), [], []
    while len(left) > 1:
        queue, left, tree = [left[0]], left[1:], [left[0]]
        while queue and len(left):
            xor = left ^ queue.pop()
            near = viable(xor)
            near[near] = np.bitwise_count(xor[near]) <= BITS
            if near.any():
                found = left[near]
                queue.extend(found)
                tree.extend(found)
                left = left[~near]
        if len(tree) > 1:
            root = min(tree)
            tree.remove(root)
            a.extend(tree)
            b.extend([root] * len(tree))
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _linked(batches):
    """Links within runs of equal ``key`` of the sorted rows (key, part, fp)."""
    held_key, held = None, []

    def close():
        members = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        return forest(members) if len(members) > 1 else None

    def table(links):
        links = [x for x in links if x is not None and len(x[0])]
        sides = [np.concatenate([x[i] for x in links]).view(np.int64) if links else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        fps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        begins = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(fps)]])
        links = []
        first_end = int(begins[1])
        if held_key is not None and tuple(keys[0]) != held_key:
            links.append(close())
            held = []
        # Whole runs inside the batch with more than one row; the ends may go on elsewhere.
        held.append(fps[:first_end])
        held_key = tuple(keys[0])
        if len(begins) > 2:
            links.append(close())
            sizes = np.diff(begins)
            for k in np.flatnonzero(sizes[1:-1] > 1) + 1:
                links.append(forest(np.unique(fps[begins[k] : begins[k + 1]])))
            held, held_key = [fps[begins[-2] :]], tuple(keys[begins[-2]])
        yield table(links)
    yield table([close()])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprints that connect the same sets as all pairs at 4 or fewer bits."""
    masks = F.array(*[F.lit(np.int64(np.uint64(m).view(np.int64)).item()) for m in KEYS])
    # The key is the masked fingerprint, told apart by the number of its mask.
    key = lambda fp: F.posexplode(F.transform(masks, lambda m: fp.bitwiseAND(m)))

    def keyed(rows):
        return rows.select("fp", key(F.col("fp")).alias("mask", "bits")).select("fp", F.xxhash64("mask", "bits").alias("key"))

    block = int(distinct.sparkSession.conf.get("spark.nudgeframe.bucketRows", str(BLOCK)))
    sampled = keyed(distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0))
    hot = cut(
        sampled.groupBy("key").agg((F.count(F.lit(1)) * SAMPLE).alias("rows")).filter(F.col("rows") > block)
        .select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    )
    rows = keyed(distinct)
    # Rows per block, not which rows: a hot key costs balance only.
    if hot.count():
        own = F.pmod(F.hash("fp"), F.col("blocks"))
        pair = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
        parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), pair)
        )
        rows = rows.join(hot, "key", "left").select("key", F.explode(parts).alias("part"), "fp").withColumn("part", F.col("part").cast("long"))
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("part"), "fp")
    dealt = rows.repartition(partitions_of(distinct), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_hash, component_id (smallest doc_id reachable), root; one row per row of ``docs``.

    ``root`` is the component's smallest fingerprint: unlike ``component_id`` it is unique
    to the component when doc_ids repeat or are null.
    """
    prints = cut(with_fingerprint(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min(order_id()).alias("first_id")))
    parts = connected_components(links(distinct.select("fp")))
    roots = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(roots.join(least, "root").select(F.col("fp").alias("own"), "component_id", "root"))
    out = prints.join(named, F.col("fp") == F.col("own"))
    return out.select("doc_id", "fp", "text_hash", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: its smallest doc_id, by smallest text hash if that repeats."""
    rows = near_duplicates(docs)
    chosen = rows.groupBy("root").agg(F.min(F.struct(order_id().alias("o"), "text_hash")).alias("m"))
    chosen = cut(chosen.select(F.col("m.o").alias("kept"), F.col("m.text_hash").alias("kept_hash")))
    keyed = docs.withColumns({"__order": order_id(), "__hash": text_hash()})
    kept = keyed.join(chosen, (F.col("__order") == F.col("kept")) & (F.col("__hash") == F.col("kept_hash")), "left_semi")
    # Rows that repeat both id and text are numbered; the join has already put them together.
    one = F.row_number().over(Window.partitionBy("__order", "__hash").orderBy("__order"))
    return kept.withColumn("__n", one).filter("__n = 1").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
