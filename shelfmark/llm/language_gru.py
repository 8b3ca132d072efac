r"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read as the UTF-8 bytes of its letters (``\p{L}``) in lower case, with one separator for all that lies
between two runs of letters.  The stream is cut behind separators into segments of some ``SPAN`` bytes; within one
the network carries its state over word borders in both directions, and labels every position with a distribution
over languages.  A document's probabilities are the mean over all its letter bytes.  Training reads text in the
same way and is plain numpy: backpropagation through time with Adam on segments of a bounded sample of documents
outside the held-out quarter.  Language, source and id are no inputs.

The sample: of each language ``SAMPLE_DOCS`` documents at most, by a hash of id and text, and of each of these
documents ``SAMPLE_SEGMENTS`` segments at most, by a hash of the segment; so each language has its own bound, whatever
repeats.

Defined results: a text that is null or has no letter is ``und`` with score 0; if nothing can be learned, all are;
of equal probabilities (ties) the first language by name is taken; a very long text is read whole, in memory that
grows with it; each input row gives one output row, so repeated rows repeat their result; an empty table gives an
empty result; other columns are not read, whatever their names.  A run of letters longer than a segment is cut
between characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, frugal, held_out
from shelfmark.llm.pretokens import LETTER, code_point_classes

#: Documents of each language in the training sample, at most, and segments of each of them.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 1000, 8
HIDDEN, SPAN, STEPS, BATCH, RATE = 8, 64, 400, 128, 0.02
#: Segments that are read side by side, and characters of a block of texts.
LANES, BLOCK_CHARS = 1024, 1 << 20
SEPARATOR = 32
#: Languages are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_LANGUAGES = 10_000


# --- text -> segments -----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _lower_case() -> np.ndarray:
    """The lower-case letter of each code point, where that is one code point."""
    return np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, owner): the streams of all texts, and the segments with the text that each belongs to."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    letter = code_point_classes()[points] == LETTER
    after = np.zeros(points.size, bool)  # the first character behind a run of letters
    after[1:] = letter[:-1] & ~letter[1:] & (owner[1:] == owner[:-1])
    kept = np.flatnonzero(letter | after)
    folded = np.where(letter[kept], _lower_case()[points[kept]], np.uint32(SEPARATOR))
    owner = owner[kept]
    width = np.ones(kept.size, np.int64)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += folded > limit
    stop = np.cumsum(width)  # of each character
    data = np.frombuffer(folded.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    if not kept.size:
        none = np.empty(0, np.int64)
        return data, none, none, none
    first = np.diff(owner, prepend=-1) != 0
    ends_text = np.append(first[1:], True)
    begin = (stop - width)[first]
    length = np.diff(np.append(begin, data.size))
    # segments may end with a text, behind a separator, and where a run goes on past a multiple of SPAN bytes
    opens = first | np.append(True, folded[:-1] == SEPARATOR)
    run_begin = (stop - width)[opens][np.cumsum(opens) - 1]
    over = (stop - run_begin) // SPAN > (stop - width - run_begin) // SPAN
    may = stop[ends_text | (folded == SEPARATOR) | over]
    many = (length - 1) // SPAN  # aims inside each text
    row = np.repeat(np.arange(begin.size), many)
    aims = begin[row] + SPAN * (np.arange(row.size) - np.repeat(np.cumsum(many) - many, many) + 1)
    end = np.unique(np.concatenate([stop[ends_text], may[np.searchsorted(may, aims)]]))
    start = np.concatenate([[0], end[:-1]])
    return data, start, end, owner[first][np.searchsorted(begin, start, side="right") - 1]


# --- the network ----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Byte tables, recurrent weights for both directions, and the output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.p = {f"{k}{d}": draw(*shape) for d in "fb" for k, shape in (("x", (256, 3 * hidden)), ("u", (hidden, 3 * hidden)))}
        self.p |= {"w": draw(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def scan(self, seq: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time x batch x hidden) of one direction over (time x batch) bytes."""
        x, u, n = self.p[f"x{d}"], self.p[f"u{d}"], self.hidden
        h = np.zeros((seq.shape[1], n), np.float32)
        out = np.empty((*seq.shape, n), np.float32)
        for t in range(len(seq)) if d == "f" else range(len(seq) - 1, -1, -1):
            a, g = x[seq[t]], h @ u
            gate = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = gate[:, :n], gate[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * n :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def positions(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities (time x batch x languages)."""
        logits = np.concatenate([self.scan(seq, d) for d in "fb"], axis=2) @ self.p["w"] + self.p["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True)

    def gradients(self, seq: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients by backpropagation through time."""
        n, saved = self.hidden, {"f": [], "b": []}
        states = np.concatenate([self.scan(seq, d, saved[d]) for d in "fb"], axis=2)
        logits = states @ self.p["w"] + self.p["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        batch = np.arange(seq.shape[1])
        loss = float(-np.log(p[:, batch, target] + 1e-9).mean())
        p[:, batch, target] -= 1
        p /= seq.size
        grads = {"w": np.einsum("tbh,tbl->hl", states, p), "c": p.sum(axis=(0, 1))}
        back = p @ self.p["w"].T
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            u = self.p[f"u{d}"]
            gu, dh = np.zeros_like(u), np.zeros((seq.shape[1], n), np.float32)
            entered = np.empty((*seq.shape, 3 * n), self.p["w"].dtype)
            for t, h, z, r, c, inner in reversed(saved[d]):
                dh = dh + part[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                entered[t] = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ dg
                dh = dh * z + dg @ u.T
            flat, of = entered.reshape(-1, 3 * n), seq.ravel()
            grads |= {f"x{d}": np.stack([np.bincount(of, flat[:, k], 256) for k in range(3 * n)], axis=1), f"u{d}": gu}
        return loss, grads

    def read(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities summed over the letter bytes of each segment (segments x languages)."""
        out = np.empty((start.size, len(self.languages)))
        order = np.argsort(start - end, kind="stable")  # longest first: at each time the first lanes are live
        for at in range(0, order.size, LANES):
            own = order[at : at + LANES]
            out[own] = self._lanes(data, start[own], end[own] - start[own]).T
        return out

    def _lanes(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same for segments side by side, in order of falling length; arrays are (unit x lane)."""
        n, steps = self.hidden, int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), side="left")
        seq = [data[start[:k] + t] for t, k in enumerate(live.tolist())]
        half = np.r_[np.full(2 * n, 0.5), np.ones(n)].astype(np.float32)  # of the gates' tanh
        weights = {d: (np.ascontiguousarray((self.p[f"x{d}"] * half).T), np.ascontiguousarray((self.p[f"u{d}"] * half).T)) for d in "fb"}
        w = np.ascontiguousarray(self.p["w"].T)

        def step(d: str, t: int, h: np.ndarray) -> np.ndarray:
            x, u = weights[d]
            a, g = np.take(x, seq[t], axis=1), u @ h
            gate = a[: 2 * n]
            gate += g[: 2 * n]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            c, inner = a[2 * n :], g[2 * n :]
            inner *= gate[n:]
            c += inner
            np.tanh(c, out=c)
            out = h - c
            out *= gate[:n]
            out += c
            return out

        h, states = np.zeros((n, start.size), np.float32), []
        for t in range(steps):
            h = step("f", t, h[:, : live[t]])
            states.append(h)
        total = np.zeros((len(self.languages), start.size))
        h = np.zeros((n, 0), np.float32)
        for t in range(steps - 1, -1, -1):
            k = int(live[t])
            h = step("b", t, np.concatenate([h, np.zeros((n, k - h.shape[1]), np.float32)], axis=1))
            logits = w[:, :n] @ states[t]
            logits += w[:, n:] @ h
            logits += self.p["c"][:, None]
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits *= (seq[t] != SEPARATOR) / logits.sum(axis=0)
            total[:, :k] += logits
        return total


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 0) -> Network | None:
    """Fit on (language, segment); languages weigh the same."""
    samples = sorted((lang, piece) for lang, piece in samples if piece)
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    target = np.searchsorted(languages, [lang for lang, _ in samples])
    size = np.array([len(piece) for _, piece in samples])
    weight = size / np.bincount(target, size)[target]
    groups = [np.flatnonzero(size == s) for s in np.unique(size)]
    share = np.array([weight[g].sum() for g in groups])
    matrices = [np.frombuffer(b"".join(samples[i][1] for i in g), np.uint8).reshape(len(g), -1) for g in groups]
    chance = [weight[g] / weight[g].sum() for g in groups]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        k = rng.choice(len(groups), p=share / share.sum())
        pick = rng.choice(len(groups[k]), BATCH, p=chance[k])
        _, grads = net.gradients(matrices[k][pick].T, target[groups[k][pick]])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))  # long chains of steps can throw out a gradient
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# --- DataFrames -----------------------------------------------------------------------------------


def _text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    texts, start, size = [t or "" for t in batch.column(column).to_pylist()], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, piece): some segments of each text, by a hash."""
    frugal()
    for batch in batches:
        for at, texts in _text_blocks(batch, 1):
            data, start, end, owner = segments(texts)
            whole = data.tobytes()
            mark = (start * 2654435761 + data[start]) % 4294967291 if start.size else start
            order = np.lexsort((mark, owner))
            place = np.arange(order.size) - np.searchsorted(owner[order], owner[order])
            chosen = order[place < SAMPLE_SEGMENTS]
            langs = batch.column(0).take(pa.array(at + owner[chosen]))
            yield pa.RecordBatch.from_arrays([langs, pa.array([whole[start[i] : end[i]] for i in chosen.tolist()], pa.binary())], names=["lang", "piece"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on segments of a bounded sample of the documents outside the held-out quarter."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # rows are chosen by their id and text, so that neither ids nor texts that repeat are chosen all at once
    known = known.withColumn("pick", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)))
    # the smallest picks of each language: only so many rows of one leave a task
    rank = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    least = known.select("lang", "pick").withColumn("rank", rank("pick")).where(F.col("rank") <= SAMPLE_DOCS)
    bound = cut(least.groupBy(F.col("lang").alias("of")).agg(F.max("pick").alias("bound")))
    most = bound.agg(F.max("bound")).first()[0] or 0
    bound = F.broadcast(bound) if bound.count() <= BROADCAST_LANGUAGES else bound
    likely = known.where(F.col("pick") <= most).join(bound, F.col("lang") == F.col("of")).where(F.col("pick") <= F.col("bound"))
    # rows that repeat have one pick, so they are ranked once more
    sample = likely.withColumn("rank", rank("pick", "id")).where(F.col("rank") <= SAMPLE_DOCS)
    found = sample.select("lang", "text").mapInArrow(_samples, "lang string, piece binary").toArrow()
    return train(list(zip(found["lang"].to_pylist(), found["piece"].to_pylist(), strict=True)))


def label(texts: list[str], net: Network) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    data, start, end, owner = segments(texts)
    sums = net.read(data, start, end)
    total = np.stack([np.bincount(owner, sums[:, k], len(texts)) for k in range(len(net.languages))], axis=1)
    letters = np.concatenate([[0], np.cumsum(data != SEPARATOR)])
    seen = np.bincount(owner, letters[end] - letters[start], len(texts))
    score = np.where(seen > 0, total.max(axis=1) / np.maximum(seen, 1), 0.0)
    return [net.languages[b] if s else "und" for b, s in zip(total.argmax(axis=1), seen, strict=True)], np.clip(score, 0, 1)


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``lang_pred`` and ``score`` of every row."""
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for at, texts in _text_blocks(batch, 1):
                langs, scores = label(texts, net) if net else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for every document, as the query returns them."""
    return predict(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
