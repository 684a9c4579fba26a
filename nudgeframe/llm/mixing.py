"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Every document gets the key ``-ln(u) / weight``: ``u`` is a uniform number hashed
from its id, ``weight`` its quality. Sorting a source by that key is a weighted
sample without replacement of any size. A source whose target is ``e`` times its
size and a rest takes every document ``e`` times (complete epochs), then the
documents of the smallest keys up to the rest.

The running sum over keys never sorts a whole source in one task: keys map to
65,536 ordered buckets, bucket sums (added up before the shuffle) find the bucket
in which the budget ends, and only that bucket's rows are sorted. What remains is
one cut per source, so documents themselves are never shuffled.

Defined cases: null text has size 0; a null, non-finite or non-positive weight
sorts after all others; sources of size 0 have target 0; rows that share an id, or have
none, are told apart by their text, and rows equal in both are numbered, so each has a
key of its own; an empty table gives no rows. Extra columns are kept by ``materialise``
(names beginning with ``__mix_`` are refused) and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nudgeframe.llm.common import cut, join_lookup, read

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 65_536
MOST_EPOCHS = 3
WEIGHT_CYCLE = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: falls as the mean length of a word with its space leaves six."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)))


def numbered(docs: DataFrame) -> DataFrame:
    """Adds __mix_id, which tells rows apart by id, text and number among equal ones.

    Only rows that repeat another's id and text are shuffled to be numbered.
    """
    text = F.substring(F.md5(F.coalesce(F.col("text"), F.lit(""))), 1, 16)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    named = docs.withColumn("__mix_id", name)
    repeated = cut(named.groupBy(F.col("__mix_id").alias("__mix_name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__mix_name"))
    number = F.lit(1)
    if repeated.head(1):
        named = join_lookup(named, repeated, F.col("__mix_id") == F.col("__mix_name"), "left")
        single = named.filter("__mix_name is null").withColumn("__mix_number", number)
        order = Window.partitionBy("__mix_name").orderBy("__mix_id")
        several = named.filter("__mix_name is not null").withColumn("__mix_number", F.row_number().over(order))
        named, number = single.unionByName(several), F.col("__mix_number")
    return named.select(*[F.col(c) for c in docs.columns], F.concat_ws(":", "__mix_id", number.cast("string")).alias("__mix_id"))


def sampling_key(name: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), name))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    usable = (weight > 0) & (weight < F.lit(float("inf")))
    return F.when(usable, -F.log(uniform) / weight).otherwise(F.lit(float("inf")))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also target, epochs, rest: weights 1, 2, 3 in source order.

    Resharing the excess of capped sources by weight ends at ``min(3 size, level *
    weight)`` with one level for all. With sources sorted by ``3 size / weight`` the
    level is the first ``(total - capped so far) / (weight left)`` not above its row.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    most = F.lit(MOST_EPOCHS) * F.col("source_size")
    rows = sizes.select("source", "source_size", ((number - 1) % WEIGHT_CYCLE + 1).alias("weight"))
    before = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, whole = before.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select(
        "*",
        F.row_number().over(before).alias("n"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(earlier), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weights"),
    ).withColumn("level", F.col("left") / F.col("weights"))
    fits = F.col("level") <= most / F.col("weight")
    level = F.min_by("level", F.when(fits, F.col("n"))).over(whole)
    rows = rows.withColumn("target", F.least(most.cast("double"), level * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return rows.select(
        "source",
        "source_size",
        "target",
        epochs.cast("long").alias("epochs"),
        (F.col("target") - epochs * F.col("source_size")).alias("rest"),
    )


def _bucket(key: Column) -> Column:
    """A bucket that never falls as the key grows."""
    place = F.when(key < F.lit(1e15), key / (F.lit(1.0) + key)).otherwise(F.lit(1.0))
    return F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def plan_mix(docs: DataFrame, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized, cuts): per row id, source, size and key; per source target and cut.

    ``weight`` is a quality column of ``docs``; by default it comes from the text.
    """
    size = word_count(F.col("text"))
    chosen = quality_weight(F.col("text"), size) if weight is None else weight
    # Narrow before rows are numbered: only equal ones, without their text, are shuffled.
    rows = docs.select("doc_id", "text", "source", size.alias("size"), chosen.cast("double").alias("w"))
    sized = cut(numbered(rows).select("doc_id", "source", "size", sampling_key(F.col("__mix_id"), F.col("w")).alias("key")))
    sized = sized.withColumn("bucket", _bucket(F.col("key")))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    # At most 65,536 rows a source, whatever the number of documents.
    ordered = Window.partitionBy("source").orderBy("bucket")
    sums = per_bucket.withColumn("before", F.sum("bucket_size").over(ordered) - F.col("bucket_size"))
    same = targets.select(F.col("source").alias("s"), "rest")
    edge = (
        sums.join(same, F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("before") <= F.col("rest"))
        .groupBy("s")
        .agg(F.max(F.struct("bucket", "before", "rest")).alias("edge"))
        .select("s", "edge.*")
    )
    edge = cut(edge.withColumnRenamed("bucket", "edge_bucket"))
    inside = join_lookup(
        sized.filter("size > 0"), edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge_bucket")), "inner"
    )
    by_key = inside.groupBy("s", "key").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    running = F.sum("size").over(Window.partitionBy("s").orderBy("key"))
    # A document is in when at least half of it fits.
    last = (
        by_key.withColumn("upto", F.col("before") + running)
        .filter(F.col("upto") - F.col("size") / 2.0 <= F.col("rest"))
        .groupBy("s")
        .agg(F.max("key").alias("cut_key"))
    )
    cuts = (
        targets.join(edge.select(F.col("s").alias("es"), "edge_bucket"), F.col("source").eqNullSafe(F.col("es")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "rest", "edge_bucket", "cut_key")
    )
    return sized, cut(cuts)


def copies(key: Column, cuts: str = "") -> Column:
    """Times the mix takes a row, given the columns of ``cuts`` under the prefix named."""
    of = lambda name: F.col(f"{cuts}{name}")
    inside = (_bucket(key) < of("edge_bucket")) | (key <= of("cut_key"))
    return of("epochs") + F.when((of("rest") > 0) & inside, F.lit(1)).otherwise(F.lit(0))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies; one row per row of ``docs``."""
    sized, cuts = plan_mix(docs, weight)
    out = join_lookup(sized, cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    times = copies(F.col("key"))
    return out.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("copies"))


def materialise(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    clash = [c for c in docs.columns if c.lower().startswith("__mix_")]
    if clash:
        raise ValueError(f"documents already have the columns {clash}")
    _, cuts = plan_mix(docs.select("doc_id", "text", "source"))
    cuts = cuts.select(F.struct("*").alias("__mix_cut"))
    key = sampling_key(F.col("__mix_id"), quality_weight(F.col("text"), word_count(F.col("text"))))
    rows = numbered(docs).withColumn("__mix_key", key)
    out = join_lookup(rows, cuts, F.col("source").eqNullSafe(F.col("__mix_cut.cut_source")), "inner")
    times = copies(F.col("__mix_key"), "__mix_cut.")
    out = out.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return out.select(*[F.col(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
with named as (
  select *, coalesce(doc_id::varchar, 'null') || ':' || substr(md5(coalesce(text, '')), 1, 16) as name from documents
), told_apart as (
  select *, name || ':' || row_number() over (partition by name) as full_name from named
), sized as (
  select doc_id, source, full_name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    coalesce(length(text), 0) as n,
    (('0x' || substr(md5('mix:' || full_name), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from told_apart
), keyed as (
  select doc_id, source, size, full_name, -ln(u) / (1.0 / (1.0 + abs(n / greatest(size, 1) - 6.0))) as k from sized
), sources as (
  select source, source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w
  from (select source, sum(size)::bigint as source_size from keyed group by source)
), ranked as (
  select *, row_number() over o as n, 3 * source_size / w as cap,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
      / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from sources window o as (order by 3 * source_size / w, source nulls last)
), targets as (
  select source, source_size, least((3 * source_size)::double,
    (select level from ranked where level <= cap order by n limit 1) * w) as target
  from ranked
), budget as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets
), running as (
  select doc_id, size, source_size, target, epochs, target - epochs * source_size as rest,
    sum(size) over (partition by k.source order by k.k, full_name rows between unbounded preceding and current row) as upto
  from keyed k join budget b on k.source is not distinct from b.source
)
select doc_id, size::bigint as size, source_size, target,
  (epochs * size + case when rest > 0 and upto - size / 2.0 <= rest then size else 0 end)::bigint as taken
from running
"""
