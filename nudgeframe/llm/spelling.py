"""Spelling variants by pivotal grams.

Words one edit apart (a code point inserted, deleted or replaced) are found by their
bigrams. Bigrams are ranked by how many words hold them, rarest first. A word's prefix
is its three rarest bigrams (of one bigram, the first in the word); its pivots are
two bigrams that share no letter position, chosen from the prefix by dynamic programming
so that their ranks add up to the least. One edit touches at most one of two disjoint
bigrams. Of two near words, take the one whose prefix ends no later in the ranking: the
pivot that survives lies in the other's prefix, or one place behind an equal last gram.
So every near pair meets where a pivot of one equals such a gram of the other.

Position limits: a replaced code point moves nothing; an inserted one moves the grams
behind it by one. Where the edit stands behind a pivot, the text before the pivot is
equal, and the reverse. The join's key therefore is a hash of (gram, length, position, one
side's text), and a pivot looks at six places: text before it, in words of the three
lengths at its own position; text behind it, at the position moved by the difference in
length. A gram near an end of its word has a short text on one side; there the key also
has the letters of the other side that stay equal, which are its first three or those
behind them. Candidates are verified inside the join's condition, first by their sets of
letters, so only near pairs leave it.

The ranking has at most the square of the number of letters in rows (8,100), whatever the
input, and goes to every task. Keys that hold many words are split by Spark's skewed-join handling.

Corrections: a word's form is its near word of largest count (ties: smallest in
code-point order) if that count is at least ``ratio`` times its own. Forms are followed to the last
by doubling: counts grow ``ratio``-fold at each step, so a few rounds reach the end.

Defined cases: null texts have no words; the counts of repeated rows add up; an empty
table, or one without words of ``least`` code points, gives no rows; extra columns are
ignored. A null doc_id takes part in ``dropped_letters`` as an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import cut, read, utf8

#: A letter in UTF-8: a-z, or U+00C0 to U+00FF.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
#: Letters after lower-casing A-Z; the ranking has no more rows than their square.
ALPHABET = 26 + 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: One run in so many of a document loses a letter, by its checksum.
DROP = 31
#: Letters beside a gram that make a key; words have at least SIDE + 4.
SIDE = 3
#: Words that a task counts before it passes its counts on.
HELD = 500_000


def dropped_letter(prefix: int, run: bytes) -> bytes:
    """The run, or the run without one code point where the checksum says so.

    Fixed by the query's contract; ``prefix`` is the checksum of "<doc_id>:".
    """
    h = zlib.crc32(run, prefix)
    if h % DROP:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, change=None, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the letter runs of all texts, A-Z lower-cased, that have ``least`` code points.

    ``change`` is applied to each run of a document as change(checksum of "<doc_id>:", run);
    it makes no run longer.
    """
    long_enough = re.compile(LETTER + b"{%d,}" % least)

    def run(batches):
        counts = Counter()

        def table():
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            rows = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for r, doc_id in enumerate(batch.column(0).to_pylist()):
                own = Counter(long_enough.findall(data[offsets[r] : offsets[r + 1]].tobytes().translate(LOWER)))
                if change is None:
                    counts.update(own)
                else:
                    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                    for word, n in own.items():
                        counts[change(prefix, word)] += n
                if len(counts) >= HELD:
                    yield table()
        yield table()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    kept = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return kept.filter((F.char_length("word") >= least) & (F.col("n") >= occurrences))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of every bigram when ordered by the words that hold it: at most ALPHABET squared."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    held = words.filter(F.char_length("word") > 1).select(F.explode(F.array_distinct(grams)).alias("gram"))
    counted = held.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    return {r["gram"]: place for place, r in enumerate(counted.orderBy("words", "gram").collect())}


def prefix_of(word: str, ranks: dict[str, int], edits: int = 1) -> tuple[list, list]:
    """(prefix, indexed): the rarest 2 * edits + 1 bigrams as (rank, position), and those that a
    near word's pivot can meet, which may tie with the last and stand ``edits`` behind it."""
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    prefix = grams[: 2 * edits + 1]
    rank, place = prefix[-1]
    return prefix, [g for g in grams if g <= (rank, place + edits)]


def pivots_of(prefix: list, edits: int = 1) -> list:
    """edits + 1 grams of the prefix that share no letter position, of the least sum of ranks.

    best[k] holds, over the grams up to some position, the least (sum, grams) of k disjoint
    grams; a gram at p extends choices that end at p - 2 or before.
    """
    grams = sorted((place, rank) for rank, place in prefix)
    best = [[(0, [])] + [None] * (edits + 1)]
    for j, (place, rank) in enumerate(grams):
        before = best[next(i for i in range(j, -1, -1) if i == 0 or grams[i - 1][0] <= place - 2)]
        row = list(best[-1])
        for k in range(1, edits + 2):
            if before[k - 1] is not None:
                taken = (before[k - 1][0] + rank, [*before[k - 1][1], (rank, place)])
                row[k] = taken if row[k] is None else min(row[k], taken)
        best.append(row)
    return best[-1][edits + 1][1]


def letters_of(word: str) -> int:
    """The letters of a word as bits; one edit changes two of them at most."""
    bits = 0
    for letter in word:
        bits |= 1 << (ord(letter) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def place(name: str) -> int:
    """A join key."""
    key = xxhash.xxh64_intdigest(name)
    return key - (1 << 64) if key >> 63 else key


def places(word: str, rank: int, position: int, lengths, moved: bool):
    """Join keys of a gram under which the word meets words of the ``lengths``.

    ``moved``: the word is the one that looks, and the other's place of the gram counts. For
    every side of the gram (0 before it, 1 behind it) that may be free of the edit the key has
    the side's text. Where that is shorter than SIDE the other side adds what is equal
    there: its first SIDE letters, or all behind them of the shorter word.
    """
    n = len(word)
    for side, (same, edited) in enumerate(((word[:position], word[position + 2 :]), (word[position + 2 :], word[:position]))):
        short = len(same) < SIDE
        for other in lengths:
            # Names of the pair: the indexed word's length, and the place of the gram in it.
            length = other if moved else n
            at = position + (other - n if moved and side else 0)
            name = f"{rank},{length},{at},{side},{same}"
            if not short:
                yield place(name)
            else:
                yield place(f"{name},{edited[:SIDE]}")
                less = min(n, other)
                yield place(f"{name},{less},{edited[SIDE + n - less :]}")


def _entries(words: DataFrame, name: str, entries) -> DataFrame:
    """(key, word, n, letters): a row per key of entries(word)."""

    def run(batches):
        for batch in batches:
            keys, rows, letters = [], [], []
            for r, word in enumerate(batch.column(0).to_pylist()):
                own = list(entries(word))
                keys += own
                rows += [r] * len(own)
                letters += [letters_of(word)] * len(own)
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *taken.columns, pa.array(letters, pa.int64())], ["key", name, f"n_{name}", f"letters_{name}"]
            )

    return words.select("word", "n").mapInArrow(run, f"key long, {name} string, n_{name} long, letters_{name} long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_word, near, n_near) of words one edit apart, both ways; words have LEAST code points or more."""
    ranks = gram_ranks(words)

    def indexed(word):
        # Keys that name no other length are equal for all of them.
        return {key for rank, p in prefix_of(word, ranks)[1] for key in places(word, rank, p, (len(word) - 1, len(word)), False)}

    def probing(word):
        n = len(word)
        return {key for rank, p in pivots_of(prefix_of(word, ranks)[0]) for key in places(word, rank, p, (n - 1, n, n + 1), True)}

    index, probe = _entries(words, "word", indexed), _entries(words, "near", probing)
    alike = F.bit_count(F.col("letters_word").bitwiseXOR(F.col("letters_near"))) <= 2
    met = index.join(probe, [index["key"] == probe["key"], alike, F.levenshtein("word", "near", 1) == 1])
    # A pair is met up to a dozen times, from both words: one order, then distinct, then both ways.
    ends = [F.struct(F.col(w).alias("w"), F.col(f"n_{w}").alias("n")) for w in ("word", "near")]
    pairs = met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select(F.col("p.a.w").alias("word"), F.col("p.a.n").alias("n_word"), F.col("p.b.w").alias("near"), F.col("p.b.n").alias("n_near"))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, root) rows that name the next word: doubled until nothing moves."""
    now = cut(forms)
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        step = cut(now.join(ahead, now["root"] == ahead["at"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = step.drop("moved")
        if not step.filter("moved").head(1):
            return now


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct words and their counts."""
    words = cut(words)
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), "near")).alias("m"))
    near = near.select(F.col("word").alias("of"), "n_near", F.col("m.near").alias("candidate"), (-F.col("m.less")).alias("candidate_n"))
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    corrected = F.col("candidate_n") >= ratio * F.col("n")
    rows = cut(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(corrected, F.col("candidate")).alias("form"), F.when(corrected, F.col("candidate_n")).alias("form_n"),
        )
    )
    roots = _followed(rows.filter("form is not null").select("word", F.col("form").alias("root")))
    roots = roots.select(F.col("word").alias("of"), F.col("root").alias("last"))
    return rows.join(roots, F.col("word") == F.col("of"), "left").select(*rows.columns, F.coalesce("last", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(read(spark, sf_dir, "documents"), dropped_letter)
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


SQL = """
    with recursive runs as (
      select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run
      from documents),
    counted as (select doc_id, run, count(*) as c from runs group by all),
    bytes as (
      select *, list_transform(range(1, len(doc_id || ':' || run) + 1), lambda i: ord((doc_id || ':' || run)[i])::bigint) as b from counted),
    hashed as (
      select run, c, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(b, lambda x: case when x < 128 then [x, 0, 0, 0, 0, 0, 0, 0]
          else [195, 0, 0, 0, 0, 0, 0, 0, x - 64, 0, 0, 0, 0, 0, 0, 0] end))),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384::bigint * (xor(a, x) & 1))), 4294967295::bigint) as h from bytes),
    changed as (select case when h % 31 = 0 then run[1:h % len(run)] || run[h % len(run) + 2:] else run end as word, c from hashed),
    words as (select word, sum(c)::bigint as n from changed where len(word) >= 7 group by word having sum(c) >= 2),
    less as (select word, n, unnest(range(1, len(word) + 1)) as i from words),
    variants as (select word, n, i, word[1:i - 1] || word[i + 1:] as v from less),
    near as (
      select x.word, y.word as near, y.n as near_n from variants x join variants y on x.v = y.v and x.i = y.i and len(x.word) = len(y.word) and x.word <> y.word
      union select x.word, y.word, y.n from variants x join words y on x.v = y.word
      union select y.word, x.word, x.n from variants x join words y on x.v = y.word),
    best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word),
    forms as (
      select words.word, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n
      from words left join best using (word)),
    chain as (
      select word, word as root, form as next from forms
      union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next)
    select f.word, form, root, n, n_near, form_n from forms f join (select word, root from chain where next is null) using (word)"""
