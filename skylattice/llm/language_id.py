"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads all bytes of a document, white space too, from both ends, gives every position a distribution over
the languages, and pools them: a document's distribution is the mean over its positions. Both directions run together
over windows of WINDOW bytes. A window starts CONTEXT bytes early (late, for the other direction), so its state is the
one that the bytes before have left; what lies further back has faded. Only the ends of the document start afresh. The
weights are learned in numpy by backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import doc_crc, small_batches

HIDDEN, WINDOW, CONTEXT, STEPS, BATCH, RATE = 8, 512, 64, 300, 160, 0.02
#: The documented bound of what is learned from: documents of all languages together, at most PER_LANG of each (one at
#: least), and CHUNKS pieces of CHUNK bytes of each document, taken at even distances over its whole text.
SAMPLE_DOCS, PER_LANG, CHUNKS, CHUNK = 2400, 400, 8, 64
#: Positions times languages that are in memory at once, and the window of texts that fit into it.
AT_ONCE, SHORT = 1 << 21, 64
#: The symbol of no byte. It shuts the update gate, so that a state of zeros stays what it is.
NONE, SHUT = 256, 1e9
WORD_CHARACTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.pmod(doc_crc(doc_id), F.lit(3)) == 1


def has_letter(text: str | None) -> bool:
    """Whether a character is of the general category L; the first word character nearly always is one."""
    m = WORD_CHARACTER.search(text or "")
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text[m.start() :])))


class Network:
    """e: byte -> input of reset, update and candidate of each direction; u: recurrent; b: its bias; v, c: labels.
    The last axis of all arrays is that of the rows that are read side by side, or of the inputs of a weight."""

    names = ("e", "u", "b", "v", "c")

    def __init__(self, languages: list[str], rng: np.random.Generator | None = None, h: int = HIDDEN):
        self.languages = languages
        if rng is not None:
            self.e = rng.normal(0, 0.5, (2, 3 * h, NONE + 1)).astype(np.float32)
            self.u = (rng.normal(0, 1, (2, 3 * h, h)) / np.sqrt(h)).astype(np.float32)
            self.b = np.zeros((2, 3 * h, 1), np.float32)
            self.v = rng.normal(0, 0.1, (2, len(languages), h)).astype(np.float32)
            self.c = np.zeros((len(languages), 1), np.float32)
            self.e[:, :, NONE] = 0
            self.e[:, h : 2 * h, NONE] = SHUT

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: (2, steps, rows), the second direction in its own order. States after each step: (2, steps, h, rows)."""
        _, steps, n = x.shape
        h, kind = self.u.shape[2], self.u.dtype
        s, out, past = np.zeros((2, h, n), kind), np.empty((2, steps, h, n), kind), []
        g, gx, size = (np.empty((2, 3 * h, n), kind) for _ in range(3))
        rz, c, gc = gx[:, : 2 * h], gx[:, 2 * h :], g[:, 2 * h :]
        for t in range(steps):
            for d in (0, 1):
                np.take(self.e[d], x[d, t], axis=1, out=gx[d], mode="clip")
            np.matmul(self.u, s, out=g)
            g += self.b
            rz += g[:, : 2 * h]
            if keep:
                before = rz.copy()
            m = np.abs(rz, out=size[:, : 2 * h])
            m += 1
            rz /= m
            rz += 1
            rz *= 0.5
            c += np.multiply(rz[:, :h], gc, out=size[:, 2 * h :])
            if keep:
                raw = c.copy()
            m = np.abs(c, out=size[:, 2 * h :])
            m += 1
            c /= m
            if keep:
                past.append((before, raw, rz.copy(), c.copy(), gc.copy(), s.copy()))
            s -= c
            s *= rz[:, h:]
            s += c
            out[:, t] = s
        return out, past

    def labels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distributions (steps, languages, rows) of positions from the states of both directions there."""
        p = np.matmul(self.v[0], a)
        p += np.matmul(self.v[1], b)
        p += self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions inside (steps, rows), and its gradients by backpropagation through
        time; y is the language of each row. The second direction of x is the first one reversed."""
        out, past = self.states(x, True)
        h = self.u.shape[2]
        a, b = out[0], out[1][::-1]
        p = self.labels(a, b)
        weight, rows = inside / inside.sum(), np.arange(len(y))
        loss = -float((np.log(np.maximum(p[:, y, rows], 1e-30)) * weight).sum())
        p[:, y, rows] -= 1
        p *= weight[:, None, :].astype(p.dtype)
        g = {"v": np.stack([np.einsum("tkn,thn->kh", p, s) for s in (a, b)]), "c": p.sum((0, 2))[:, None]}
        d_out = np.stack([np.matmul(self.v[0].T, p), np.matmul(self.v[1].T, p)[::-1]])
        g["e"], g["u"], g["b"] = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(self.b)
        d_state = np.zeros_like(d_out[:, 0])
        moves = np.empty((2, 3 * h, len(past), len(y)), p.dtype)
        for t in range(len(past) - 1, -1, -1):
            before, raw, rz, c, gh, old = past[t]
            r, z = rz[:, :h], rz[:, h:]
            d = d_state + d_out[:, t]
            dc = d * (1 - z) / (1 + np.abs(raw)) ** 2
            slope = 0.5 / (1 + np.abs(before)) ** 2
            dr, dz = dc * gh * slope[:, :h], d * (old - c) * slope[:, h:]
            moves[:, :, t] = np.concatenate([dr, dz, dc], axis=1)
            back = np.concatenate([dr, dz, dc * r], axis=1)
            g["u"] += np.matmul(back, old.transpose(0, 2, 1))
            g["b"] += back.sum(2, keepdims=True)
            d_state = d * z + np.matmul(self.u.transpose(0, 2, 1), back)
        for d in (0, 1):
            for j in range(3 * h):
                g["e"][d, j] = np.bincount(x[d].ravel(), moves[d, j].ravel(), NONE + 1)
        g["e"][:, :, NONE] = 0
        return loss, g

    def learn(self, chunks: list[bytes], language: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over batches that hold each language equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(language == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        second = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(own, -(-BATCH // len(by))) for own in by])
            x = np.full((len(chosen), CHUNK), NONE, np.intp)
            for row, i in enumerate(chosen.tolist()):
                own = np.frombuffer(chunks[i][:CHUNK], np.uint8)
                x[row, : len(own)] = own
            x = x.T
            _, grads = self.gradients(np.stack([x, x[::-1]]), x != NONE, language[chosen])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                getattr(self, k)[...] -= move.astype(np.float32)

    def documents(self, data: list[bytes]) -> np.ndarray:
        """Mean distribution over the positions of each document; zeros for an empty one."""
        k = len(self.languages)
        sums, sizes = np.zeros((len(data), k)), np.array([len(d) for d in data], np.int64)
        for window, own in ((SHORT, sizes <= SHORT), (WINDOW, sizes > SHORT)):
            group = max(64, min(1024, AT_ONCE // (window * max(k, 1))))
            pending: list[tuple[int, np.ndarray]] = []
            held = 0
            for i in np.flatnonzero(own & (sizes > 0)).tolist():
                bytes_ = np.frombuffer(data[i], np.uint8)
                # a long document goes in slices of whole windows, so what is in memory doesn't depend on its length
                for lo in range(0, len(bytes_), group * window):
                    hi = min(len(bytes_), lo + group * window)
                    n = -(-(hi - lo) // window)
                    flat = np.full(n * window + 2 * CONTEXT, NONE, np.intp)
                    a, b = max(0, lo - CONTEXT), min(len(bytes_), hi + CONTEXT)
                    flat[CONTEXT - (lo - a) : CONTEXT - (lo - a) + b - a] = bytes_[a:b]
                    pending.append((i, flat))
                    held += n
                    if held >= group:
                        self._pool(pending, sums, window)
                        pending, held = [], 0
            if pending:
                self._pool(pending, sums, window)
        return sums / np.maximum(sizes, 1)[:, None]

    def _pool(self, pending: list[tuple[int, np.ndarray]], sums: np.ndarray, window: int) -> None:
        """Add the distributions of all positions of some slices to the sums of their documents."""
        flat = np.concatenate([f for _, f in pending])
        windows = [(len(f) - 2 * CONTEXT) // window for _, f in pending]
        at = np.cumsum([0, *(len(f) for _, f in pending)])
        start = np.concatenate([a + window * np.arange(n) for a, n in zip(at.tolist(), windows, strict=False)])
        owner = np.repeat([i for i, _ in pending], windows)
        steps = np.arange(CONTEXT + window)
        x = np.stack([flat[start + steps[:, None]], flat[start + (2 * CONTEXT + window - 1 - steps)[:, None]]])
        out, _ = self.states(x)
        p = self.labels(out[0, CONTEXT:], out[1, CONTEXT:][::-1])
        p *= (x[0, CONTEXT:] != NONE)[:, None, :]
        pooled = p.sum(0)
        for k in range(len(pooled)):
            sums[:, k] += np.bincount(owner, pooled[k], len(sums))


def chunks_of(text: str) -> list[bytes]:
    """At most CHUNKS pieces of CHUNK bytes at even distances over a whole text."""
    b = text.encode("utf-8", "replace")
    n = min(CHUNKS, -(-len(b) // CHUNK))
    return [b[at : at + CHUNK] for at in (i * max(0, len(b) - CHUNK) // max(1, n - 1) for i in range(n))]


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Learn from a bounded sample of the documents with a language that aren't held out; ids only choose the sample.

    The rows with the smallest hashes of each language are taken. What reaches the driver is bounded by SAMPLE_DOCS (or
    one document of each language, if there are more) times CHUNKS * CHUNK bytes, however long texts are.
    """
    small_batches(spark)
    usable = docs.where(docs[lang_col].isNotNull() & docs[text_col].rlike(r"(?U)\p{L}") & ~held_out(docs[id_col]))
    keyed = usable.select(docs[id_col].cast("string").alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).withColumn("draw", F.xxhash64(F.lit(23), F.col("id"), F.col("text")))
    counts = keyed.groupBy("lang").agg(F.count("*").alias("n"))
    found = counts.count()
    if not found:
        return Network([], np.random.default_rng(11))
    each = min(PER_LANG, max(1, SAMPLE_DOCS // found))
    # four times what is needed of each language, by hash, so that few texts are ranked
    most = counts.select(F.col("lang").alias("l"), (F.least(F.lit(1.0), 4.0 * (each + 8) / F.col("n")) * (2.0**64) - 2.0**63).alias("most"))
    few = keyed.join(F.broadcast(most) if found <= SAMPLE_DOCS else most, F.col("lang") == F.col("l")).where(F.col("draw").cast("double") <= F.col("most"))
    first = Window.partitionBy("lang").orderBy("draw", "id", "text")
    chosen = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).select("lang", "draw", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [chunks_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.list_(pa.binary()))], ["lang", "draw", "pieces"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(cut, "lang string, draw long, pieces array<binary>").collect())
    languages = sorted({r[0] for r in rows})
    net = Network(languages, np.random.default_rng(11))
    place = {k: i for i, k in enumerate(languages)}
    pieces = [bytes(p) for r in rows for p in r[2]]
    net.learn(pieces, np.array([place[r[0]] for r in rows for _ in r[2]], np.int64))
    return net


def language_id(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and probabilities (language -> share of the pooled distribution).

    Null texts and texts without a letter (category L) are `und` with score 0. Without any labelled text with a letter
    everything is `und`. Rows are kept one for one, repeated ones too; an empty table gives an empty result; a text is
    read whole, in slices of bounded size.
    """
    net = net or train(spark, docs, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(net)  # of a fixed size, some 10,000 numbers and the languages
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            clear = [bool(net.languages) and has_letter(t) for t in texts]
            got = iter(net.documents([t.encode("utf-8", "replace") for t, c in zip(texts, clear, strict=True) if c]))
            pred, score, all_p = [], [], []
            for c in clear:
                p = next(got) if c else None
                pred.append("und" if p is None else net.languages[int(p.argmax())])
                score.append(0.0 if p is None else float(min(1.0, p.max())))
                all_p.append([] if p is None else list(zip(net.languages, p.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(all_p, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "probabilities"])

    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, probabilities map<string,double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "probabilities")
