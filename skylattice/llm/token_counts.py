"""Token counts by a compiled finite-state tokenizer.

Two transducers are composed. The first (pretokenize.py) marks where pieces start; the state maps of its chunks compose
through a parallel prefix scan. The second reads the bytes of a piece. Its transitions are annotated with the number of
tokens they add to the count (which may be negative: a byte can complete a token that swallows others).

A state of the second transducer is what of a prefix can still matter: the longest suffix that begins some longer token,
and at every place within it where one can begin, the last token of the prefix that ends there and the count up to there. A token may follow another
when BPE leaves the pair as it is; a sequence is BPE's own if each neighbouring pair is, so the one last token that may
follow is found among the suffixes. States are made when first met, as in lazy determinisation, and many prefixes
share one; the table has a fixed size and is emptied when full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm.bpe_codec import merge_piece
from skylattice.llm.common import grouped_by_size, small_batches
from skylattice.llm.pretokenize import pieces, pieces_of_long
from skylattice.llm.vocabulary import Vocabulary, vocabulary

BATCH = 1 << 20
#: States in the table (a transition of 4 bytes for each byte value met so far), and the offset that keeps annotations positive.
STATES, OFFSET, BITS = 250_000, 32, 6
MISSING = -1


class CountingTransducer:
    def __init__(self, v: Vocabulary, states: int = STATES):
        self.v, self.most = v, states
        #: What some longer token begins with.
        self.begins = {t[:i] for t in v.ids for i in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """The table holds next state and annotation in one number; row 0 is the start of a piece."""
        self.table = np.full((1024, 128), MISSING, np.int32)
        self.column, self.bytes_met = np.full(256, MISSING, np.int64), []
        self.kept: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._state((b"", (-1,), (0,)))

    def _state(self, key: tuple) -> int:
        if (i := self.number.get(key)) is None:
            i = self.number[key] = len(self.kept)
            self.kept.append(key)
            if i >= len(self.table):
                self._grow(2, 1)
        return i

    def _grow(self, rows: int, columns: int) -> None:
        n, m = self.table.shape
        grown = np.full((rows * n, columns * m), MISSING, np.int32)
        grown[:n, :m] = self.table
        self.table = grown

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column of each byte; byte values get columns when first met."""
        for x in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            if len(self.bytes_met) == self.table.shape[1]:
                self._grow(1, 2)
            self.column[x] = len(self.bytes_met)
            self.bytes_met.append(x)
        return self.column.take(data)

    def _follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are."""
        if left < 0:
            return True
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            t = self.v.token_bytes
            known = self.pairs[(left, right)] = merge_piece(t[left] + t[right], self.v) == [left, right]
        return known

    def compile(self, state: int, byte: int) -> None:
        """Make one transition. A key is (suffix, last token at each of its places, count at each place less the last)."""
        suffix, last, count = self.kept[state]
        grown = suffix + bytes((byte,))
        ids = self.v.ids
        for j in range(len(grown)):
            t = ids.get(grown[j:])
            if t is not None and last[j] is not None and self._follows(last[j], t):
                break
        else:
            raise AssertionError("no token ends here")
        added = count[j] + 1
        begins, n, cut = self.begins, len(grown), 0
        while cut < n and grown[cut:] not in begins:
            cut += 1
        # a place within the suffix matters only if some longer token begins there
        open_ = [j for j in range(cut, n) if j == cut or grown[j:] in begins]
        key_last, key_count = [None] * (n - cut), [0] * (n - cut)
        for j in open_:
            if last[j] is not None:
                key_last[j - cut], key_count[j - cut] = last[j], count[j] - added
        to = self._state((grown[cut:], (*key_last, t), (*key_count, 0)))
        self.table[state, self.column[byte]] = to << BITS | added + OFFSET

    def counts(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[a:b]. All pieces take a step at a time; those that have ended drop out."""
        if len(self.kept) > self.most:
            self.reset()
        order = np.argsort(a - b, kind="stable")
        at, length = a[order], (b - a)[order]
        total, state = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), side="right")
        columns = self._columns(data)
        width = self.table.shape[1]
        for step, n in enumerate(live.tolist()):
            place = state[:n] * width + columns.take(at[:n] + step)
            got = self.table.ravel().take(place)
            if (lost := got < 0).any():
                for p in np.unique(place[lost]).tolist():
                    self.compile(p // width, self.bytes_met[p % width])
                got = self.table.ravel().take(place)
            state[:n] = got >> BITS
            total[:n] += (got & ((1 << BITS) - 1)) - OFFSET
        out = np.empty(len(a), np.int64)
        out[order] = total
        return out


_made: dict[int, CountingTransducer] = {}


def transducer(content: bytes) -> CountingTransducer:
    v = vocabulary(content)
    if id(v) not in _made:
        _made[id(v)] = CountingTransducer(v)
    return _made[id(v)]


def count_tokens(t: CountingTransducer, texts: list[str]) -> list[int]:
    """Tokens of each text; special strings in a text count one each."""
    parts = [t.v.split_specials(x) for x in texts]
    out = np.array([sum(not isinstance(p, str) for p in x) for x in parts], np.int64)
    plain = ((len(p), (i, p)) for i, x in enumerate(parts) for p in x if isinstance(p, str))
    for group in grouped_by_size(plain, BATCH):
        if len(group) == 1 and len(group[0][1]) > BATCH:
            for found in pieces_of_long(group[0][1], BATCH):
                ends = np.cumsum([len(p) for p in found])
                starts = np.concatenate([[0], ends[:-1]])
                out[group[0][0]] += t.counts(np.frombuffer(b"".join(found), np.uint8), starts, ends).sum()
        else:
            data, a, b, owner = pieces([p for _, p in group])
            n = t.counts(np.frombuffer(data, np.uint8), a, b)
            np.add.at(out, np.array([i for i, _ in group]), np.bincount(owner, n, len(group)).astype(np.int64))
    return out.tolist()


def token_counts(spark: SparkSession, df: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Null text counts as empty. Rows are kept one for one; an empty table gives an empty result; other columns aren't read.
    """
    content = spark.sparkContext.broadcast(open(vocabulary_path, "rb").read())  # of a fixed size, 1.6 MB
    small_batches(spark)
    kept = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(content.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = count_tokens(t, texts)
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
