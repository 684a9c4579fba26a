"""Periodic runs of words: seeds on diagonals, extended once each.

A run is a maximal stretch of words with smallest period q and at least
max(LEAST, POWER * q) words. On the diagonal of lag q it is a stretch of equal words
q apart, max(LEAST - q, (POWER - 1) * q) long at least: the guaranteed overlap.

Seeds: lags are taken in bands [2^j, 2^(j+1)); the band's gram length k is the smallest
guaranteed overlap of its lags, which is no shorter than any of its lags. Grams of k
words are named by doubling (names of shorter grams are paired), and only grams that
occur twice in a document go on to the next band. Each occurrence is paired with the
next one of the same gram in the same document, and is a seed where their distance
falls in the band. That loses no run: within a run of smallest period q, a gram of q
or more words comes again after q words and no earlier, since an earlier one would
give the run a smaller period. For the same reason the run found has no smaller period.

Extension: seeds are taken by position; a table of the furthest word covered on each
lag passes over those inside a stretch already extended. The work is about the length
of the text times the logarithm of its longest lag.

A document is one row of one task; texts are read in slices of a few megabytes and
nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows
each get their own result; an empty table gives no rows; other columns are passed on,
except one named like a result, which is refused.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nudgeframe.llm.common import read, slices, utf8

LEAST, POWER = 6, 4
#: Bytes of text whose words are indexed together.
SLICE = 1 << 22
RUNS = "array<struct<start: long, length: long, period: long>>"
ADDED = ("n_words", "runs", "collapsed")
#: Words are what lies between these.
BLANKS = r"[\x20\x09-\x0D]+"


def overlap(lag: int) -> int:
    """Words that a run of this period repeats on its diagonal, at least."""
    return max(LEAST - lag, (POWER - 1) * lag)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    _, names = np.unique(left * (np.int64(right.max()) + 1) + right, return_inverse=True)
    return names.astype(np.int64)


class _Grams:
    """Names of grams of any length, from names of powers of two.

    A position whose gram occurs once is left out (-1): it begins no longer repeated gram either.
    """

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.names = [words]

    def _power(self, j: int) -> np.ndarray:
        """Name of the 2^j-gram at every position; -1 where it runs out or occurs once."""
        while len(self.names) <= j:
            half, step = self.names[-1], 1 << (len(self.names) - 1)
            out = np.full(self.size, -1, np.int64)
            at = np.flatnonzero(half[: self.size - step] >= 0)
            at = at[half[at + step] >= 0]
            if len(at):
                out[at] = self._repeated(_paired(half[at], half[at + step]))
            self.names.append(out)
        return self.names[j]

    @staticmethod
    def _repeated(names: np.ndarray) -> np.ndarray:
        return np.where(np.bincount(names)[names] > 1, names, -1)

    def of(self, k: int) -> np.ndarray:
        """Name of the k-gram at every position; -1 where it runs out or occurs once."""
        j = k.bit_length() - 1
        whole, shift = self._power(j), k - (1 << j)
        if not shift:
            return whole
        out = np.full(self.size, -1, np.int64)
        at = np.flatnonzero(whole[: self.size - shift] >= 0)
        at = at[whole[at + shift] >= 0]
        if len(at):
            out[at] = self._repeated(_paired(whole[at], whole[at + shift]))
        return out


def _seeds(words: np.ndarray, doc: np.ndarray, ends: np.ndarray):
    """(position, lag) of occurrences whose next one lies a lag of the band away, by band."""
    grams, longest, j = _Grams(words), np.bincount(doc).max() if len(doc) else 0, 0
    while max(LEAST, POWER << j) <= longest:
        lags = range(1 << j, 2 << j)
        k = min(overlap(lags[0]), overlap(lags[-1]))
        names = grams.of(k)
        at = np.flatnonzero(names >= 0)
        at = at[at + k <= ends[at]]
        if not len(at):
            return
        at = at[np.argsort(names[at], kind="stable")]
        here, there = at[:-1], at[1:]
        lag = there - here
        good = (names[here] == names[there]) & (doc[here] == doc[there]) & (lag >= lags[0]) & (lag <= lags[-1])
        yield here[good], lag[good]
        j += 1


def _matching(words: np.ndarray, i: int, lag: int, step: int, stop: int) -> int:
    """Where the diagonal of ``lag`` through word i ends: equal pairs from i on, by ``step``, before ``stop``."""
    chunk = 16
    while i != stop:
        n = min(chunk, abs(stop - i))
        a = words[i : i + n] if step > 0 else words[i - n + 1 : i + 1][::-1]
        b = words[i + lag : i + lag + n] if step > 0 else words[i + lag - n + 1 : i + lag + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return i + step * int(differ[0])
        i, chunk = i + step * n, 2 * chunk
    return i


def find_runs(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, by document, start, period.

    ``words`` holds names of the words of all documents in a row, ``doc`` the document of each.
    """
    found, begins, ends = [], np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    for at, lags in _seeds(words, doc, ends):
        covered: dict[int, int] = {}
        order = np.argsort(at, kind="stable")
        for i, lag in zip(at[order].tolist(), lags[order].tolist()):
            # Positions run on over documents, so an entry of an earlier document covers none here.
            if i < covered.get(lag, -1):
                continue
            right = _matching(words, i, lag, 1, int(ends[i]) - lag)
            left = _matching(words, i, lag, -1, int(begins[i]) - 1) + 1
            covered[lag] = right
            length = right - left + lag
            if length >= max(LEAST, POWER * lag):
                found.append((int(doc[i]), left - int(begins[i]), length, lag))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def _analysed(batches, n_columns: int):
    """Adds n_words, runs and collapsed to the rows; the text is the first column."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        counts, runs, texts = [], [], []
        for i, j in slices(offsets, SLICE):
            rows = [data[offsets[r] : offsets[r + 1]].tobytes().split() for r in range(i, j)]
            sizes = np.array([len(r) for r in rows], np.int64)
            name = defaultdict(count().__next__)
            words = np.fromiter((name[w] for r in rows for w in r), np.int64, int(sizes.sum()))
            own = [[] for _ in rows]
            for d, start, length, period in find_runs(words, np.repeat(np.arange(len(rows)), sizes)):
                own[d].append({"start": start, "length": length, "period": period})
            for row, spans in zip(rows, own):
                kept = np.ones(len(row), bool)
                for s in spans:
                    kept[s["start"] + s["period"] : s["start"] + s["length"]] = False
                texts.append(b" ".join(row[k] for k in np.flatnonzero(kept)) if spans else b" ".join(row))
            counts.append(sizes)
            runs.extend(own)
        struct = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        added = [
            pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)),
            pa.array(runs, pa.list_(struct)),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ]
        passed = [batch.column(c) for c in range(1, n_columns)]
        names = [batch.schema.field(c).name for c in range(1, n_columns)]
        yield pa.RecordBatch.from_arrays([*passed, *added], [*names, *ADDED])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, runs (start, length, period; by start, then period) and
    collapsed (the words outside every run's repetitions, joined by one space)."""
    clash = set(ADDED) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"documents already have the columns {sorted(clash)}")
    n_columns = len(docs.columns) + 1
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string").fields])
    return docs.select(F.col(text).alias("__text"), "*").mapInArrow(lambda b: _analysed(b, n_columns), schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its words to the end.

    Fixed by the query's contract: h is the checksum of the id, g = h / 10 rounded down.
    Documents without an id keep their text.
    """
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.transform("w", lambda w, i: F.get("w", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_runs(planted(read(spark, sf_dir, "documents")))
    # Longest first, ties by smallest start and period: the largest of (length, -start, -period).
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    rows = rows.withColumn("best", best)
    length, period = F.col("best.l"), -F.col("best.p")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = """
    with parsed as (
      select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w,
        list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint) as bytes from documents),
    hashed as (
      select doc_id, w, len(w) as n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(bytes, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384::bigint * (xor(a, x) & 1))), 4294967295::bigint) as h from parsed),
    placed as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from hashed),
    periods as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from placed),
    docs as (
      select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from periods),
    words as (select doc_id, n, unnest(range(0, n)) as i, unnest(w) as word from docs),
    grams as (
      select doc_id, n, i, word, hash(word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as five,
        hash(word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o) as six
      from words window o as (partition by doc_id order by i)),
    equal as (
      select doc_id, i, 1 as q, 5 as k from (select *, lead(five) over (partition by doc_id order by i) as later from grams where i + 5 <= n) where five = later
      union all
      select x.doc_id, x.i, y.i - x.i as q, 6 as k from grams x join grams y on x.doc_id = y.doc_id and x.six = y.six and y.i >= x.i + 2
        and 4 * (y.i - x.i) <= x.n and y.i + 6 <= y.n),
    stretches as (
      select doc_id, q, min(i) as start, max(i) + max(k) - min(i) + q as length
      from (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal) group by doc_id, q, island),
    long as (select * from stretches where length >= greatest(6, 4 * q)),
    runs as (select * from long l where not exists (
      select 1 from long s where s.doc_id = l.doc_id and s.q < l.q and s.start <= l.start and s.start + s.length >= l.start + l.length)),
    lists as (
      select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as text,
        first({'s': start, 'l': length, 'q': q} order by length desc, start, q) as best from runs group by doc_id),
    dropped as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs),
    kept as (select doc_id, string_agg(word, ' ' order by i) as text from words anti join dropped using (doc_id, i) group by doc_id)
    select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period, 1000 * best.l // best.q as exponent_milli,
      sha256(coalesce(l.text, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
    from documents d left join lists l using (doc_id) left join kept k using (doc_id)"""
