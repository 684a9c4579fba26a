"""Exact top-k by inner product: three-phase uniform threshold.

Components are cut into ``NODES`` groups of dimensions; a node's list for a query is
the partial inner product of its group with every candidate, and a score is the sum
over nodes. Candidates and queries are dealt into blocks; a task holds one block of
each, so every query meets all rows and no task holds a whole side.

1. Each node gathers its k best partial products in the block; the candidates named
   are scored in full, and the k best scores over all blocks give the query's cutoff:
   k candidates reach it, so none below it can matter.
2. The cutoff goes back to every block. A score that reaches it has at least one
   partial product of cutoff / NODES or more, so each node collects its entries from
   that uniform threshold up.
3. The remaining parts of the collected entries are looked up, those whose exact sum
   reaches the cutoff are kept, at most k a block and query, and the best k win.

Defined cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows with null vec_id; a vector of another length than most meets only
its own length; ties go to the smaller vec_id; rows that repeat a vec_id
with the same vector count once, those with other vectors are candidates (and queries) of
their own under that id; fewer candidates than k give all; scores are exact
(sums of products that may pass 2^53 are taken in Python integers), and one beyond the
range of a long ends the job; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nudgeframe.llm.common import cut, read

K, NODES, SCALE, QUERY_EVERY = 20, 4, 64, 20
CANDIDATE_BLOCK, QUERY_BLOCK, TILE = 32_768, 8_192, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (floor of 64 times each component), dims."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    scaled = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double"))
    # Rows equal in id and vector are merged, no others.
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("embedding")).distinct()
    return rows.select("vec_id", scaled.alias("x"), F.size("embedding").alias("dims"))


def _blocks(rows: DataFrame, is_query) -> DataFrame:
    """Each pair of blocks (dims, cb, qb) with its candidates and queries."""
    sizes = {r["dims"]: (r["n"], r["q"]) for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q")).collect()}
    count = lambda i, size: F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, max(1, -(-n[i] // size)))])[F.col("dims")]
    if not sizes:
        sizes[0] = (1, 1)
    cbs, qbs = count(0, CANDIDATE_BLOCK), count(1, QUERY_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    rows = rows.withColumn("cbs", cbs).withColumn("qbs", qbs)
    candidates = rows.select("dims", own(F.col("cbs")).alias("cb"), each(F.col("qbs")).alias("qb"), F.lit(0).alias("side"), "vec_id", "x")
    queries = rows.filter(is_query).select("dims", each(F.col("cbs")).alias("cb"), own(F.col("qbs")).alias("qb"), F.lit(1).alias("side"), "vec_id", "x")
    return candidates.unionByName(queries)


def _sides(table):
    """(ids, matrix) of candidates and of queries, in order of id."""
    out = []
    for side in (0, 1):
        rows = table.filter(pa.compute.equal(table["side"], side))
        ids = rows["vec_id"].to_numpy()
        flat = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0)
        order = np.argsort(ids, kind="stable")
        out += [ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else flat.reshape(0, 0)]
    return out


def _groups(width: int):
    bounds = np.linspace(0, width, min(NODES, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(bounds, bounds[1:])] or [slice(0, 0)]


def _partials(q: np.ndarray, c: np.ndarray):
    """Partial products by node, exact; and a type that holds their sums."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2**24:
        q, c = q.astype(np.float32), c.astype(np.float32)
    elif bound >= 2**53:
        q, c = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(c)
    return [q[:, g] @ c[:, g].T for g in _groups(q.shape[1])]


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, unordered."""
    if values.shape[1] <= k:
        return np.broadcast_to(np.arange(values.shape[1]), values.shape)
    return np.argpartition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k :]


def _tiles(q_ids, q):
    for at in range(0, len(q_ids), TILE):
        yield q_ids[at : at + TILE], q[at : at + TILE]


def _as_table(rows):
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


def _phase_one(k):
    def run(table):
        c_ids, c, q_ids, q = _sides(table)
        rows = []
        if len(c_ids):
            for ids, part in _tiles(q_ids, q):
                lists = _partials(part, c)
                total = sum(lists[1:], lists[0])
                named = np.concatenate([_best(p, k) for p in lists], axis=1)
                for i, query in enumerate(ids):
                    seen = np.unique(named[i])
                    seen = seen[c_ids[seen] != query]
                    scores = total[i, seen]
                    for j in np.lexsort((c_ids[seen], -scores))[:k]:
                        rows.append((int(query), int(c_ids[seen[j]]), int(scores[j])))
        return _as_table(rows)

    return run


def _phase_two(k):
    def run(table):
        cutoffs = table.filter(pa.compute.equal(table["side"], 2))
        known = dict(zip(cutoffs["vec_id"].to_pylist(), cutoffs["cutoff"].to_pylist()))
        c_ids, c, q_ids, q = _sides(table)
        rows = []
        if len(c_ids):
            for ids, part in _tiles(q_ids, q):
                lists = _partials(part, c)
                for i, query in enumerate(ids):
                    cutoff = known.get(int(query))
                    if cutoff is None:  # fewer than k candidates anywhere: all matter
                        entries = np.arange(len(c_ids))
                    else:
                        reach = lists[0][i] * len(lists) >= cutoff
                        for p in lists[1:]:
                            reach |= p[i] * len(lists) >= cutoff
                        entries = np.flatnonzero(reach)
                    entries = entries[c_ids[entries] != query]
                    scores = sum((p[i, entries] for p in lists[1:]), lists[0][i, entries])
                    if cutoff is not None:
                        entries, scores = entries[scores >= cutoff], scores[scores >= cutoff]
                    for j in np.lexsort((c_ids[entries], -scores))[:k]:
                        rows.append((int(query), int(c_ids[entries[j]]), int(scores[j])))
        return _as_table(rows)

    return run


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row."""
    rows = cut(usable(vectors))
    blocks = _blocks(rows, is_query)
    schema = "query_id long, vec_id long, score long"
    lists = blocks.groupBy("dims", "cb", "qb").applyInArrow(_phase_one(k), schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = cut(
        lists.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k)
        .groupBy("query_id").agg(F.max(F.when(F.col("n") == k, F.col("score"))).alias("cutoff")).filter("cutoff is not null")
    )
    # The cutoff travels with its query to every block.
    asked = blocks.filter("side = 1").select("dims", "cb", "qb", "vec_id").join(cutoffs, F.col("vec_id") == F.col("query_id"))
    told = asked.select("dims", "cb", "qb", F.lit(2).alias("side"), "vec_id", F.lit(None).cast("array<double>").alias("x"), "cutoff")
    every = blocks.withColumn("cutoff", F.lit(None).cast("long")).unionByName(told)
    found = every.groupBy("dims", "cb", "qb").applyInArrow(_phase_two(k), schema)
    best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x)
  where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id::bigint as query_id, rank::integer as rank, vec_id::bigint as vec_id, score from ranked where rank <= 20
"""
