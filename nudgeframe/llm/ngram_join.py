"""Jaccard join of documents on word n-grams by PartEnum signatures.

A document's set holds its distinct n-word shingles (A-Z lower-cased); with fewer words
the whole sequence is the only one. Sets link when their intersection is at least
``percent`` hundredths of their union. Equal sets are one set from the start: only
distinct sets go on, told apart by 64-bit sums of shingle hashes.

Signatures: sizes fall into bands whose bounds grow by 100 / percent, so a link joins
sets of one band or of neighbours. A set takes part in its own band and in the next;
under a band the sets that link differ in at most k shingles, k growing with the band.
The shingles' domain is cut into ceil((k + 1) / 2) parts, of which one holds at most one
difference of the two; that part is cut into PIECES, and a signature covers all pieces
but one: sets that link share at least one signature.

Verification: members of a signature are paired with its smallest set, the pivot, only.
For every pair with a pivot the shingles in one of the two sets alone are found exactly.
They settle links to the pivot. Two members x, y of one signature have a pivot z in
common, and what tells x from y is what tells x from z but not y from z, and the reverse;
so where a pivot has members that are not linked to it, its members are searched breadth
first by these short lists. That gives a spanning forest of all links between different
sets, never all pairs; a pivot with many members is cut into blocks, and every pair of
blocks is a task of its own.

Texts travel once, and only those of sets that share a signature.

Defined cases: null, empty and blank texts have an empty set, which links with nothing;
repeated rows have equal sets; a null doc_id counts as the largest id and a component of
such rows alone has a null id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nudgeframe.llm.common import LAST_ID, cut, mix64, order_id, partitions_of, read, slices, utf8
from nudgeframe.llm.components import connected_components

WORDS, PERCENT = 3, 90
#: Pieces of a part; a signature leaves one out.
PIECES = 3
#: Members of a pivot, and differing shingles of them, that one task searches.
BLOCK, BLOCK_SHINGLES = 2_000, 2_000_000
SLICE = 1 << 21
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix64(x + _STEP)


#: Weights of bytes in a word's hash: A-Z weigh as a-z, blanks nothing.
_WEIGHTS = np.array([xxhash.xxh64_intdigest(bytes([b]).translate(LOWER), 7) for b in range(256)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WEIGHTS[_BLANK] = 0
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the rows that ``offsets`` cut from ``data``.

    The hash is a polynomial of random byte weights over the word, from running sums.
    """
    blank = _BLANK[data]
    begins, ends = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    begins[1:-1] = blank[:-1]
    ends[1:-1] = blank[1:]
    begins[offsets] = ends[offsets] = True
    first = np.flatnonzero(begins[:-1] & ~blank)
    last = np.flatnonzero(ends[1:] & ~blank)
    bits = max(16, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHTS[data] * _powers(_BASE, bits)[: len(data)], out=sums[1:])
    h = (sums[last + 1] - sums[first]) * _powers(_INVERSE, bits)[first]
    return _mixed(h), np.searchsorted(offsets, first, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sizes): distinct shingle hashes of every row, sorted within the row."""
    word, row = word_hashes(data, offsets)
    sizes = np.bincount(row, minlength=len(offsets) - 1)
    end = np.cumsum(sizes)[row]
    at = np.arange(len(word))
    # Shorter sequences are one shingle, told apart from others by their length.
    length = np.minimum(sizes, words)[row]
    first = at[(at + words <= end) | ((length < words) & (at == end - length))]
    h = _mixed(length[first].astype(np.uint64))
    for k in range(words):
        has = k < length[first]
        h[has] = _mixed(h[has] ^ word[first[has] + k])
    row = row[first]
    cuts = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
    for i, j in zip(cuts, cuts[1:]):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(sizes))


def set_ids(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; zero for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        begins = (np.cumsum(sizes) - sizes)[some]
        out[some] = _mixed(np.add.reduceat(_mixed(shingles), begins) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of every band, up to the one after ``largest``."""
    low, high = [1], [100 // percent]
    while low[-1] <= largest:
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // percent)
    return np.array(low), np.array(high)


def signatures(shingles: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of sets under their own band and the next."""
    low, high = bands(int(sizes.max(initial=0)), percent)
    own = np.searchsorted(low, sizes, "right") - 1
    sigs, owners = [], []
    for band in (own, own + 1):
        most = 2 * high[band] * (100 - percent) // (100 + percent)
        parts = np.where((most > 0) & (sizes > 0), (most + 2) // 2, 0)
        cells = parts * PIECES
        base = np.cumsum(cells) - cells
        taking = np.repeat(parts > 0, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[taking]
        mixed = _mixed(shingles[taking])
        cell = base[owner] + (mix64(mixed ^ _STEP) % np.maximum(cells, 1).astype(np.uint64)[owner]).astype(np.int64)
        sums = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(sums, cell, mixed)
        if not len(sums):
            continue
        table = sums.reshape(-1, PIECES)
        rest = (table.sum(axis=1, keepdims=True, dtype=np.uint64) - table).ravel()
        holder = np.repeat(np.arange(len(sizes)), cells)
        place = (np.arange(len(sums)) - base[holder]).astype(np.uint64)
        # The band and the place of the pieces are part of a signature.
        sigs.append(_mixed(_mixed(rest) ^ _mixed((band[holder].astype(np.uint64) << np.uint64(40)) + place)))
        owners.append(holder)
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(owners)


def _sets_of(batch, column: int, words: int):
    """(first row, shingles, sizes) of slices of a batch's texts."""
    data, offsets = utf8(batch.column(column))
    for i, j in slices(offsets, SLICE):
        yield i, *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_set(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (null for an empty set); one row per row of ``docs``."""

    def run(batches):
        for batch in batches:
            ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, shingles, sizes in _sets_of(batch, 2, words):
                ids.append(set_ids(shingles, sizes))
                counts.append(sizes)
            count = np.concatenate(counts)
            own = pa.array(np.concatenate(ids), mask=count == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), own], ["doc_id", "text_hash", "n_shingles", "set_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id long")


def with_signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(sig, set_id); a set that several documents of a task have is signed once there."""

    def run(batches):
        seen = set()
        for batch in batches:
            for _, shingles, sizes in _sets_of(batch, 0, words):
                ids = set_ids(shingles, sizes)
                fresh = np.zeros(len(ids), bool)
                for r, name in enumerate(ids.tolist()):
                    if sizes[r] and name not in seen:
                        seen.add(name)
                        fresh[r] = True
                sigs, owners = signatures(shingles[np.repeat(fresh, sizes)], sizes[fresh], percent)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(ids[fresh][owners])], ["sig", "set_id"])

    return docs.select("text").mapInArrow(run, "sig long, set_id long")


def _starred(batches):
    """(member, pivot) of runs of equal ``sig`` in rows sorted by (sig, set_id)."""
    last_sig = last_pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, own = (batch.column(c).to_numpy() for c in (0, 1))
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
        pivot = own[first]
        if last_sig is not None and sig[0] == last_sig:
            pivot[first == 0] = last_pivot
        last_sig, last_pivot = sig[-1], pivot[-1]
        other = own != pivot
        pairs = np.unique(np.column_stack([own[other], pivot[other]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["member", "pivot"])


def pivot_pairs(signed: DataFrame) -> DataFrame:
    """Distinct (member, pivot): every member of a signature with its smallest set."""
    dealt = signed.repartition(partitions_of(signed), "sig").sortWithinPartitions("sig", "set_id")
    return dealt.mapInArrow(_starred, "member long, pivot long").distinct()


def _shingles_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the wanted sets, each from its first document."""
    first = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct(order_id().alias("o"), "text_hash")).alias("m"))
    first = first.select("set_id", F.col("m.o").alias("o"), F.col("m.text_hash").alias("h"))
    texts = docs.select(order_id().alias("o"), text_hash().alias("h"), "text").join(first, ["o", "h"])
    # Rows that repeat both id and text are numbered; the join has already put them together.
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("o", "h").orderBy("o"))).filter("n = 1")

    def run(batches):
        for batch in batches:
            for i, shingles, sizes in _sets_of(batch, 1, words):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sizes)), lists], ["set_id", "shingles"])

    return texts.select("set_id", "text").mapInArrow(run, "set_id long, shingles array<long>")


def differences(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(member, pivot, n_member, n_pivot, apart): ``apart`` lists the shingles of one set alone."""
    of = lambda side: shingles.select(F.col("set_id").alias(side), F.col("shingles").alias(f"of_{side}"))
    both = pairs.join(of("member"), "member").join(of("pivot"), "pivot")
    apart = F.concat(F.array_except("of_member", "of_pivot"), F.array_except("of_pivot", "of_member"))
    sizes = [F.size(f"of_{side}").cast("long").alias(f"n_{side}") for side in ("member", "pivot")]
    return both.select("member", "pivot", *sizes, apart.alias("apart"))


def _similar(a, b, apart, percent: int):
    """100 * intersection >= percent * union, for sets of a and b shingles that differ in ``apart``."""
    return 100 * (a + b - apart) >= percent * (a + b + apart)


def forest(ids: np.ndarray, sizes: np.ndarray, linked: np.ndarray, lists: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links among the members of a pivot that reach those not linked to it, breadth first."""
    counts = np.array([len(x) for x in lists], np.int64)
    owner = np.repeat(np.arange(len(ids)), counts)
    _, value, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    # A shingle on one list alone is shared by no two members.
    shared = often[value] > 1
    owner, value = owner[shared], value[shared]
    own_begin = np.searchsorted(owner, np.arange(len(ids) + 1))
    left = np.flatnonzero(~linked)
    alive = ~linked
    order = np.argsort(value, kind="stable")
    order = order[alive[owner[order]]]
    holder, begin = owner[order], np.searchsorted(value[order], np.arange(len(often) + 1))
    queue, a, b = np.flatnonzero(linked).tolist(), [], []
    while len(left):
        if not queue:
            queue = [int(left[0])]
            alive[left[0]] = False
            left = left[1:]
        p = queue.pop()
        mine = value[own_begin[p] : own_begin[p + 1]]
        starts, lengths = begin[mine], begin[mine + 1] - begin[mine]
        spots = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        common = np.bincount(holder[spots], minlength=len(ids))[left]
        near = _similar(sizes[p], sizes[left], counts[p] + counts[left] - 2 * common, percent)
        if near.any():
            found = left[near]
            queue.extend(found.tolist())
            alive[found] = False
            left = left[~near]
            a.extend(ids[found].tolist())
            b.extend([int(ids[p])] * len(found))
    return a, b


def _searched(batches, percent: int):
    """Forests of runs of equal (pivot, part) in sorted rows (pivot, part, member, n_member, linked, apart)."""
    held, key = [], None

    def close():
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, sizes = rows.column("member").to_numpy(), rows.column("n_member").to_numpy()
        linked = rows.column("linked").to_numpy(zero_copy_only=False).astype(bool)
        apart = rows.column("apart").chunk(0)
        flat, cuts = apart.flatten().to_numpy(), apart.offsets.to_numpy()
        lists = np.split(flat, cuts[1:-1] - cuts[0])
        return forest(ids, sizes, linked, lists, percent)

    def links(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in (0, 1)])
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if key is not None and tuple(keys[i]) != key:
                yield links(close())
                held = []
            key = tuple(keys[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield links(close())


def searched_links(apart: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) links between members of pivots that are not all linked to their pivot."""
    conf = apart.sparkSession.conf
    block = int(conf.get("spark.nudgeframe.bucketRows", str(BLOCK)))
    rows = apart.withColumn("linked", _similar(F.col("n_member"), F.col("n_pivot"), F.size("apart"), percent))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.size("apart")) / BLOCK_SHINGLES)).cast("int")
    open_pivots = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("unlinked"), blocks.alias("blocks"))
    open_pivots = open_pivots.filter("members > 1 and unlinked > 0").select("pivot", "blocks")
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    pair = lambda other: (F.least(own, other) * F.col("blocks") + F.greatest(own, other)).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    rows = rows.join(open_pivots, "pivot").select("pivot", F.explode(parts).alias("part"), "member", "n_member", "linked", "apart")
    dealt = rows.repartition(partitions_of(apart), "pivot", "part").sortWithinPartitions("pivot", "part")
    return dealt.mapInArrow(lambda b: _searched(b, percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, component_id (smallest doc_id reachable by links)."""
    sets = cut(with_set(docs, words))
    pairs = cut(pivot_pairs(with_signatures(docs, words, percent)))
    wanted = pairs.select(F.col("member").alias("set_id")).union(pairs.select("pivot")).distinct()
    apart = cut(differences(pairs, cut(_shingles_of(docs, sets, wanted, words))))
    direct = apart.filter(_similar(F.col("n_member"), F.col("n_pivot"), F.size("apart"), percent))
    links = direct.select(F.col("member").alias("a"), F.col("pivot").alias("b")).union(searched_links(apart, percent))
    parts = connected_components(links)
    first = sets.filter("set_id is not null").groupBy("set_id").agg(F.min(order_id()).alias("first_id"))
    rooted = first.join(parts, first["set_id"] == parts["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "first_id")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(least, "root").select(F.col("set_id").alias("own"), "component_id"))
    out = sets.join(named, F.col("set_id") == F.col("own"), "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(LAST_ID)))
    return out.select("doc_id", "text_hash", "n_shingles", "set_id", component.alias("component_id"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
    with recursive words as (
      select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
    flat as (select doc_id, len(w) as n, unnest(range(0, len(w))) as i, unnest(w) as a from words),
    grams as (
      select doc_id, n, i, a, lead(a, 1) over o as b, lead(a, 2) over o as c from flat window o as (partition by doc_id order by i)),
    shingles as (select distinct doc_id, concat_ws(' ', a, b, c) as s from grams where c is not null or (n < 3 and i = 0)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    common as (select s, count(*) as df from shingles group by s),
    ordered as (
      select doc_id, s, n, row_number() over (partition by doc_id order by df, s) as pos from shingles join common using (s) join sizes using (doc_id)),
    prefixes as (select * from ordered where pos <= n - (9 * n + 9) // 10 + 1),
    candidates as (
      select distinct x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb from prefixes x join prefixes y on x.s = y.s and x.doc_id < y.doc_id
      where 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)),
    shared as (
      select a, b, na, nb, count(*) as common from candidates join shingles x on x.doc_id = a join shingles y on y.doc_id = b and y.s = x.s group by all),
    links as (select a, b from shared where 100 * common >= 90 * (na + nb - common)),
    edges as (select a, b from links union all select b, a from links),
    reach(doc_id, other) as (
      select a, b from edges union select r.doc_id, l.b from reach r join edges l on l.a = r.other),
    least as (select doc_id, min(other) as m from reach group by doc_id)
    select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
    from documents d left join sizes z using (doc_id) left join least using (doc_id)"""
