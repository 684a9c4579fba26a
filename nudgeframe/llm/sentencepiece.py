"""SentencePiece encoding and decoding as a weighted transducer.

The transducer for a text is the composition of three machines:

* normaliser: a dummy space in front, spaces become the meta symbol (the model's
  other normalisation is the identity, which ``Model`` checks);
* pieces: an arc for every piece that is a substring, weight 0, leading from state
  (position, last piece); an arc is kept at infinite weight, tropical zero, where the
  pair (last piece, piece) is not what merging their joined text gives;
* byte fallback: a character outside the piece alphabet leads on by its bytes, and
  nothing merges across it.

For a byte-pair model scores order the merges, they are not additive costs. A
segmentation is the one that merging gives exactly when each neighbouring pair is
(the merges of a pair never look further), so the composed machine has one path of
finite weight and the tropical shortest path is that path. It is found depth first,
longest piece first, backing out of states from which no finite arc leads on. Pair
weights are computed when first met and kept. Texts fall apart before each run of
meta symbols, and between a letter and those marks that follow a letter in no piece,
since no piece crosses such a point; equal parts are encoded once per worker while a
bounded table holds them. Parts with runs of spaces, whose merges tie, are merged
directly.

Decoding composes with the inverse: pieces to text, byte pieces to bytes (ill-formed
bytes become the replacement character), meta symbols to spaces, the dummy space off.

Defined cases: null and empty texts give no ids and decode to empty; unknown ids
raise; repeated rows give equal rows; extra columns are ignored or kept. The meta
symbol itself in a text decodes to a space, as in the original.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.llm.common import read, with_column

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
MARKS = ".,;:!?)]}\"'»”’\n"
MOST_KNOWN = 250_000
NORMAL, BYTE = 1, 6


def _fields(data: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, merge order and normaliser settings of a byte-pair model with byte fallback."""

    def __init__(self, serialised: bytes):
        self.text, self.ids, self.rank = [], {}, {}
        self.byte_ids, self.byte_of = {}, {}
        kind_of_model, rule, charsmap = 1, "", b""
        for number, value in _fields(serialised):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, at = piece[1].decode(), piece.get(3, NORMAL), len(self.text)
                score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
                self.text.append(text)
                if kind == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = at
                    self.byte_of[at] = int(text[3:5], 16)
                elif kind == NORMAL:
                    self.ids[text] = at
                    self.rank[text] = -score
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                rule, charsmap = spec.get(1, b"").decode(), spec.get(2, b"")
                self.dummy = bool(spec.get(3, 1))
                if spec.get(4, 1):
                    raise ValueError("models that collapse white space are not supported")
        if kind_of_model != 2 or charsmap or rule != "identity" or len(self.byte_ids) != 256:
            raise ValueError("needs a byte-pair model with byte fallback and identity normalisation")
        self.alphabet = {t for t in self.ids if len(t) == 1}
        #: Every beginning of a piece, with the piece's id or -1.
        self.begins = {t[:n]: -1 for t in self.ids for n in range(1, len(t))}
        self.begins |= self.ids
        joined = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        apart = "".join(m for m in MARKS if not any(b == m and a.isalpha() for a, b in joined))
        letters = f"{META}*[^\\W\\d_]+(?=[{re.escape(apart)}])|" if apart else ""
        if any(b == META and a != META for a, b in joined):
            raise ValueError("pieces must not run across words")
        self.part = re.compile(f"{letters}{META}*[^{META}]+|{META}+")
        self.pairs: dict = {}
        self.known: dict = {}
        self.earlier: dict = {}

    # Pieces

    def merge(self, chars: str) -> list[str]:
        """Merges of known characters by order, leftmost first among equals."""
        parts = list(chars)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = []

        def offer(i):
            j = after[i]
            if j >= 0 and (rank := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def finite(self, left: int, right: int) -> bool:
        """Whether the arc from piece ``left`` to piece ``right`` has finite weight."""
        if len(self.pairs) >= 4 * MOST_KNOWN:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        found = self.pairs[left << 32 | right] = self.merge(a + b) == [a, b]
        return found

    def shortest_path(self, chars: str) -> list[int]:
        """The only path of finite weight through the pieces of ``chars``, all of the alphabet."""
        begins, pairs, text = self.begins, self.pairs, self.text
        end, at, path, open_arcs, dead = len(chars), 0, [], [], set()
        while at < end:
            arcs = []
            for stop in range(at + 1, end + 1):
                piece = begins.get(chars[at:stop])
                if piece is None:
                    break
                if piece >= 0:
                    arcs.append(piece)
            while True:
                if arcs:
                    piece = arcs.pop()
                    if path:
                        fits = pairs.get(path[-1] << 32 | piece)
                        if fits is None:
                            fits = self.finite(path[-1], piece)
                        if not fits or dead and (at, piece) in dead:
                            continue
                    elif dead and (at, piece) in dead:
                        continue
                    path.append(piece)
                    open_arcs.append(arcs)
                    at += len(text[piece])
                    break
                piece, arcs = path.pop(), open_arcs.pop()
                at -= len(text[piece])
                dead.add((at, piece))
        return path

    def _encode_part(self, part: str) -> list[int]:
        if self.alphabet.issuperset(part) and META + META not in part:
            return self.shortest_path(part)
        ids, run = [], []

        def flush():
            if run:
                chars = "".join(run)
                ids.extend([self.ids[p] for p in self.merge(chars)] if META + META in chars else self.shortest_path(chars))
                run.clear()

        for char in part:
            if char in self.alphabet:
                run.append(char)
            else:
                flush()
                ids.extend([self.byte_ids[b] for b in char.encode()])
        flush()
        return ids

    # Text

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (META if self.dummy else "") + text.replace(" ", META)
        known, earlier, out = self.known, self.earlier, []
        for part in self.part.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = earlier.get(part)
                if ids is None:
                    ids = self._encode_part(part)
                if len(part) < 64:
                    if len(known) >= MOST_KNOWN:
                        self.earlier = earlier = known
                        self.known = known = {}
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        byte_of, text = self.byte_of, self.text
        if byte_of.keys().isdisjoint(ids):
            joined = "".join([text[i] for i in ids])
        else:
            joined = b"".join([bytes((byte_of[i],)) if i in byte_of else text[i].encode() for i in ids]).decode(errors="replace")
        joined = joined.replace(META, " ")
        return joined[1:] if self.dummy and joined.startswith(" ") else joined


_LOADED: dict = {}


def loaded(serialised: bytes) -> Model:
    """The model, built once in each worker."""
    if not _LOADED:
        _LOADED[0] = (None, None)
    if _LOADED[0][0] != serialised:
        _LOADED[0] = (serialised, Model(serialised))
    return _LOADED[0][1]


def read_model(path: str = MODEL_FILE) -> bytes:
    """The model file, read by the driver and sent with each task (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """All columns of ``docs`` and ``piece_ids``."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_column(docs, "piece_ids", "array<int>")

    def run(batches):
        sp = loaded(shared.value)
        for batch in batches:
            for part in _parts(batch):
                ids = [sp.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "piece_ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, from ``piece_ids``."""
    at = rows.columns.index("piece_ids")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = with_column(rows, "decoded", "string")

    def run(batches):
        sp = loaded(shared.value)
        for batch in batches:
            texts = [sp.decode(i or []) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def _parts(batch, rows: int = 500):
    return [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)]


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (little-endian int32), decoded_sha256, exact (decoding gives the text).

    Encodes and decodes within one pass, so ids need not leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sp = loaded(shared.value)
        for batch in batches:
            for part in _parts(batch):
                out = []
                for text in part.column(1).to_pylist():
                    ids = sp.encode(text or "")
                    back = sp.decode(ids)
                    out.append(
                        (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or ""))
                    )
                columns = [part.column(0), *(pa.array(c) for c in zip(*out))] if out else None
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean"
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, read_model())
