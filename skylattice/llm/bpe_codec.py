"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.common import grouped_by_size, small_batches
from skylattice.llm.pretokenize import pieces, pieces_of_long
from skylattice.llm.vocabulary import Vocabulary, vocabulary

#: Characters that go through the splitter at once, and distinct pieces whose ids a worker keeps.
BATCH, KEPT = 1 << 20, 300_000


def merge_piece(data: bytes, v: Vocabulary) -> list[int]:
    """Ids of one piece. The heap holds (rank, position of the left symbol, left id, right id); an entry is stale when
    its symbols have changed since, and is skipped. Equal ranks merge from left to right."""
    n = len(data)
    single = v.single
    if n == 1:
        return [single[data[0]]]
    merges = v.merges
    ids = [single[b] for b in data]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    left = ids[0]
    for i in range(1, n):
        right = ids[i]
        if (m := merges.get((left, right))) is not None:
            heap.append((m[0], i - 1, left, right, m[1]))
        left = right
    heapify(heap)
    while heap:
        _, i, left, right, made = heappop(heap)
        if ids[i] != left or (j := after[i]) < 0 or ids[j] != right:
            continue
        ids[i], ids[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (m := merges.get((made, ids[k]))) is not None:
                heappush(heap, (m[0], i, made, ids[k], m[1]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))) is not None:
            heappush(heap, (m[0], h, ids[h], made, m[1]))
    return [x for x in ids if x >= 0]


class Codec:
    """Encodes texts as the tokenizers library does without added special tokens, and decodes ids."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def _known(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the pieces, as little-endian 32-bit integers; each distinct piece is merged once while it is kept."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        v = self.v
        for p in set(found).difference(known):
            known[p] = np.array(merge_piece(p, v), "<u4").tobytes()
        return known

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        """Texts without special strings, all of them short."""
        data, a, b, owner = pieces(texts)
        found = [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        known = self._known(found)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        out = list(map(known.__getitem__, found))
        return [b"".join(out[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode_long(self, text: str) -> bytes:
        out = []
        for found in pieces_of_long(text, BATCH):
            out.append(b"".join(map(self._known(found).__getitem__, found)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.v.split_specials(t) for t in texts]
        plain = [(i, p) for i, x in enumerate(parts) for p in x if isinstance(p, str)]
        coded: list[bytes] = []
        for group in grouped_by_size(((len(p), p) for _, p in plain), BATCH):
            coded += [self.encode_long(group[0])] if len(group) == 1 and len(group[0]) > BATCH else self.encode_parts(group)
        it = iter(coded)
        return [b"".join(next(it) if isinstance(p, str) else np.array([p], "<u4").tobytes() for p in x) for x in parts]

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings one after the other; bytes that aren't UTF-8 become U+FFFD."""
        number = np.frombuffer(ids, "<u4").tolist()
        if len(number) < 2:
            return b"".join(self.v.token_bytes[i] for i in number).decode("utf-8", "replace")
        return b"".join(itemgetter(*number)(self.v.token_bytes)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(content: bytes) -> Codec:
    v = vocabulary(content)
    if id(v) not in _codecs:
        _codecs[id(v)] = Codec(v)
    return _codecs[id(v)]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))


def encode_documents(spark: SparkSession, df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id, text, ids (binary: little-endian unsigned 32-bit integers).

    A null text counts as empty and has no ids. Rows are kept one for one, repeated ids too. Other columns are not read.
    """
    content = spark.sparkContext.broadcast(open(vocabulary_path, "rb").read())  # of a fixed size, 1.6 MB
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c.encode(texts), pa.binary())], ["doc_id", "text", "ids"])

    kept = _texts(df, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string, ids binary")


def round_trip(spark: SparkSession, df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are made where ids and decoded text are, so neither leaves the worker. Null text counts as empty; an
    empty table gives an empty result.
    """
    content = spark.sparkContext.broadcast(open(vocabulary_path, "rb").read())
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for batch in batches:
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = _texts(df, id_col, text_col)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
