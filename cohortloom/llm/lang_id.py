"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes. At each byte, two gated recurrent
layers (left to right, right to left) give a state, and a softmax over both
states labels that position. A document's probabilities are the mean over all
positions of its whole text. Training is backpropagation through time in numpy
on the driver, over a bounded sample of labelled windows (SAMPLE_DOCS documents a
language, WINDOWS_A_DOC windows each).

Gates and candidates use one odd rational function in place of the hyperbolic
tangent (see squash), in training and reading alike.

Besides the languages there is a last class, that of no language. It is learned
from the same windows with their letters exchanged for others (scrambled), so
the network can tell a text that is in none of the languages.

Rules: `und` with score 0 if the text is null or has no letter. Only text and
label are learned from; ties between languages go to the first in order. A text
counts once in the sample however often it occurs, and each label that has a
text is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, blocks, filled, tidy

WINDOW, HIDDEN = 64, 10
#: The bounded training sample: documents a language, and windows of each.
SAMPLE_DOCS, WINDOWS_A_DOC = 600, 4
STEPS, BATCH, RATE, SEED = 260, 96, 0.02, 7
#: The sample is drawn from so many times as many texts, so that a rough count of them is enough.
SPARE_DRAWS = 2
#: Windows that the network reads side by side.
LANES = 2048
#: Share of "no language" in a text's probabilities from which the text is rejected. Texts in the languages learned stay well below (see README), others above.
MOST_NONE = 0.95
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class Model:
    """labels, and per direction: input table (256, 3H), recurrent weights (H, 3H), candidate bias (H); output (2H, K + 1) and bias.

    Gates are ordered update, reset, candidate. The last output is "no language".
    """

    labels: list[str]
    table: np.ndarray  # (2, 256, 3H)
    recur: np.ndarray  # (2, H, 3H)
    inner: np.ndarray  # (2, H): bias of the candidate's recurrent part
    out: np.ndarray  # (2H, K + 1)
    bias: np.ndarray  # (K + 1,)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.inner, self.out, self.bias]


def new_model(labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    f, k = np.float32, len(labels) + 1
    return Model(labels, rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f), rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(f), np.zeros((2, hidden), f), rng.normal(0, hidden**-0.5, (2 * hidden, k)).astype(f), np.zeros(k, f))


def squash(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """In place: x (27 + x x) / (27 + 9 x x) for x cut to -3 .. 3, which goes smoothly from -1 to 1, much like a tangent."""
    spare = np.empty_like(x) if spare is None else spare
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=spare)
    spare += 3
    np.divide(np.float32(8 / 3), spare, out=spare)
    spare += np.float32(1 / 9)
    x *= spare
    return x


def slope(x: np.ndarray) -> np.ndarray:
    """The derivative of squash at x."""
    q = np.clip(x, -3, 3) ** 2
    return ((9 - q) / (9 + 3 * q)) ** 2


def states(model: Model, d: int, bytes_: np.ndarray, keep: bool = False):
    """States (T, B, H) of one direction over bytes_ (T, B); with keep also what backpropagation needs."""
    steps, lanes = bytes_.shape
    h_size = model.inner.shape[1]
    table, recur, inner = model.table[d], model.recur[d], model.inner[d]
    h = np.zeros((lanes, h_size), np.float32)
    out = np.empty((steps, lanes, h_size), np.float32)
    kept = []
    for t in range(steps) if d == 0 else reversed(range(steps)):
        x, r = table[bytes_[t]], h @ recur
        # a sigmoid is this function of half the input
        before = 0.5 * (x[:, : 2 * h_size] + r[:, : 2 * h_size])
        gate = 0.5 + 0.5 * squash(before.copy())
        z, reset = gate[:, :h_size], gate[:, h_size:]
        u = r[:, 2 * h_size :] + inner
        drive = x[:, 2 * h_size :] + reset * u
        c = squash(drive.copy())
        if keep:
            kept.append((t, h, z, reset, u, c, before, drive))
        h = c + z * (h - c)
        out[t] = h
    return (out, kept) if keep else out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(model: Model, bytes_: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions, and its gradients in the order of parts()."""
    steps, lanes = bytes_.shape
    size = model.inner.shape[1]
    (fwd, kept0), (bwd, kept1) = states(model, 0, bytes_, True), states(model, 1, bytes_, True)
    both = np.concatenate([fwd, bwd], axis=2)
    p = softmax(both @ model.out + model.bias)
    lane = np.arange(lanes)
    loss = -np.log(p[:, lane, target] + 1e-9).mean()
    p[:, lane, target] -= 1
    p /= steps * lanes
    grads = [np.zeros_like(x) for x in model.parts()]
    grads[3] = np.einsum("tbh,tbk->hk", both, p)
    grads[4] = p.sum(axis=(0, 1))
    above = p @ model.out.T
    for d, kept in ((0, kept0), (1, kept1)):
        recur = model.recur[d]
        dh = np.zeros((lanes, size), np.float32)
        for t, h, z, reset, u, c, before, drive in reversed(kept):
            dh = dh + above[t][:, d * size : (d + 1) * size]
            bend = 0.25 * slope(before)
            dz = dh * (h - c) * bend[:, :size]
            dc = dh * (1 - z) * slope(drive)
            dr = dc * u * bend[:, size:]
            du = dc * reset
            side = np.concatenate([dz, dr, du], axis=1)
            np.add.at(grads[0][d], bytes_[t], np.concatenate([dz, dr, dc], axis=1))
            grads[1][d] += h.T @ side
            grads[2][d] += du.sum(axis=0)
            dh = dh * z + side @ recur.T
    return float(loss), grads


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Model:
    """A model by Adam over batches with as many windows of each label; windows: (N, WINDOW) bytes, target: numbers of labels, or their count for no language."""
    model, rng = new_model(labels, hidden, seed), np.random.default_rng(seed)
    by = [own for own in (np.flatnonzero(target == k) for k in range(len(labels) + 1)) if len(own)]
    first, second = ([np.zeros_like(x) for x in model.parts()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, BATCH // len(by))) for own in by])
        _, grads = gradients(model, windows[pick].T, target[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(model.parts(), grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes in rows of window; the last row is filled up with zeros."""
    n = -(-len(raw) // window)
    return np.frombuffer(raw.ljust(n * window, b"\0"), np.uint8).reshape(n, window)


def label_positions(model: Model, windows: np.ndarray) -> np.ndarray:
    """Probabilities (N, WINDOW, K + 1) of each position of each window."""
    b = np.ascontiguousarray(windows.T)
    both = np.concatenate([states(model, 0, b), states(model, 1, b)], axis=2)
    return softmax(both @ model.out + model.bias).transpose(1, 0, 2)


class Reader:
    """Sums of position probabilities for windows. Update, reset and candidate are planes of their own, so that every step works on whole arrays."""

    def __init__(self, model: Model):
        size = self.size = model.inner.shape[1]
        # halves: for the sigmoids of update and reset, and of the reset's factor 0.5 (1 + squash) for the candidate
        self.table = np.ascontiguousarray(model.table.reshape(2, 256, 3, size).transpose(0, 2, 1, 3)) * np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        self.recur = np.ascontiguousarray(model.recur.reshape(2, size, 3, size).transpose(0, 2, 1, 3)) * np.float32(0.5)
        self.inner = model.inner * np.float32(0.5)
        self.out = np.ascontiguousarray(model.out.reshape(2, size, -1).transpose(0, 2, 1))
        self.bias = model.bias

    def logits(self, bytes_: np.ndarray, d: int, into: np.ndarray) -> None:
        """Adds what direction d says of bytes_ (T, L; as indices) to into (T, K + 1, L)."""
        size, (steps, lanes) = self.size, bytes_.shape
        table, recur, out = self.table[d].reshape(-1, size), self.recur[d], self.out[d]
        planes = 256 * np.arange(3)[:, None]
        inner = np.tile(self.inner[d], (lanes, 1))
        h = np.zeros((lanes, size), np.float32)
        x, r, spare = (np.empty((3, lanes, size), np.float32) for _ in range(3))
        said = np.empty(into.shape[1:], np.float32)
        gate, c = r[:2], r[2]
        for t in range(steps) if d == 0 else reversed(range(steps)):
            np.take(table, bytes_[t] + planes, axis=0, out=x, mode="clip")
            np.matmul(h, recur, out=r)
            gate += x[:2]
            squash(gate, spare[:2])
            gate += 1
            c += inner
            c *= gate[1]
            c += x[2]
            squash(c, spare[2])
            h -= c
            h *= gate[0]
            h *= 0.5
            h += c
            np.matmul(out, h.T, out=said)
            into[t] += said

    def pooled(self, windows: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """(N, K + 1): for each window the sum of its positions' probabilities, over counted[i] positions from its start."""
        total = np.empty((len(windows), len(self.bias)))
        for s in range(0, len(windows), LANES):
            b = np.ascontiguousarray(windows[s : s + LANES].T, dtype=np.intp)
            z = np.empty((len(b), len(self.bias), b.shape[1]), np.float32)
            z[:] = self.bias[:, None]
            self.logits(b, 0, z)
            self.logits(b, 1, z)
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
            n = counted[s : s + LANES]
            if (n < len(b)).any():
                z *= (np.arange(len(b))[:, None] < n)[:, None, :]
            total[s : s + LANES] = z.sum(axis=0).T
        return total


def probabilities(model: Model, raw: list[bytes], reader: Reader | None = None) -> np.ndarray:
    """(N, K + 1): the mean of all positions' probabilities of each text; zeros for an empty one. Equal texts are read once."""
    reader = reader or Reader(model)
    number = {t: i for i, t in enumerate(dict.fromkeys(raw))}
    windows = [windows_of(t) for t in number]
    count = np.array([len(w) for w in windows], np.int64)
    found = np.zeros((len(number), len(model.labels) + 1))
    if count.sum():
        owner = np.repeat(np.arange(len(windows)), count)
        last = np.cumsum(count) - 1
        counted = np.full(int(count.sum()), WINDOW)
        some = count > 0
        sizes = np.array([len(t) for t in number])
        counted[last[some]] = sizes[some] - (count[some] - 1) * WINDOW
        np.add.at(found, owner, reader.pooled(np.concatenate(windows), counted))
        found /= np.maximum(1, sizes)[:, None]
    return found[[number[t] for t in raw]]


def has_letter(text: str) -> bool:
    # the first letter ends the test, so long texts cost little here
    return any(map(str.isalpha, text))


def predict_texts(model: Model, texts: list[str], reader: Reader | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, its pooled probability, and that of no language, of each text."""
    found = probabilities(model, [t.encode() for t in texts], reader)
    best = found[:, :-1].argmax(axis=1)
    letters = np.array([has_letter(t) for t in texts], bool)
    labels = [model.labels[k] if has else "und" for k, has in zip(best, letters, strict=True)]
    return labels, np.where(letters, np.clip(found[np.arange(len(texts)), best], 0, 1), 0.0), found[:, -1]


def scrambled(windows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The windows with their bytes in another order or other letters in place of theirs, one rule a window, by turns."""
    rng = np.random.default_rng(seed)
    out = windows.copy()
    for i, w in enumerate(out):
        if i % 2:
            rng.shuffle(w)
        else:
            swap = np.arange(256, dtype=np.uint8)
            for low, high in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
                swap[low:high] = rng.permutation(swap[low:high])
            w[:] = swap[w]
    return out


def sample_windows(labelled: DataFrame, label: str, text: str, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded training sample: up to SAMPLE_DOCS distinct texts of each label, those with the least hashes, and WINDOWS_A_DOC windows at hashed places of each."""
    usable = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("y"), F.col(text).alias("t"), F.xxhash64(text, F.lit(seed)).alias("h"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    whole = 1_000_000
    share: Column = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("y") == k, F.lit(min(whole, 1 + whole * SPARE_DRAWS * SAMPLE_DOCS // max(1, n)))).otherwise(share)
    place = lambda i: F.substring("t", F.pmod(F.xxhash64("t", F.lit(seed + 1 + i)), F.greatest(F.lit(1), F.length("t") - WINDOW)).cast("int") + 1, F.lit(WINDOW))
    # copies of a text have equal hashes: all are drawn or none, and they become one row before the least are taken
    drawn = usable.where(F.pmod("h", F.lit(whole)) < share).select("y", "h", F.array(*map(place, range(WINDOWS_A_DOC))).alias("w")).distinct()
    least = drawn.withColumn("at", F.row_number().over(Window.partitionBy("y").orderBy("h", "w"))).where(F.col("at") <= SAMPLE_DOCS)
    rows = sorted(least.select("y", "w").collect(), key=lambda r: (r["y"], r["w"]))  # the sample is a set: order it, so that training is repeatable
    labels = sorted({r["y"] for r in rows})
    got = [(windows_of(w.encode()[:WINDOW])[0], labels.index(r["y"])) for r in rows for w in r["w"]]
    return np.stack([w for w, _ in got]), np.array([y for _, y in got]), labels


def fit(labelled: DataFrame, label: str = "lang", text: str = "text") -> Model:
    """A model from the rows' text and label; without any labelled text a model of the one label `und`, which rejects nothing."""
    windows, target, labels = sample_windows(labelled, label, text)
    if not labels:
        model = new_model(["und"])
        model.bias[-1] = -60
        return model
    strange = scrambled(windows[:: len(labels)])
    return train(np.concatenate([windows, strange]), np.concatenate([target, np.full(len(strange), len(labels))]), labels)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from its whole text alone. The model is a few kilobytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in blocks(batches, text, 2 << 20):
            labels, score, _ = predict_texts(model, filled(b.column(text)).to_pylist(), reader)
            yield as_batch(PREDICTED, b.column("doc_id").cast(pa.int64()), labels, score)

    return docs.select("doc_id", text).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, most_none: float = MOST_NONE, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter and is less than most_none "no language" to the network; columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in blocks(batches, text, 2 << 20):
            labels, _, none = predict_texts(model, filled(b.column(text)).to_pylist(), reader)
            yield b.filter(pa.array([x != "und" and p < most_none for x, p in zip(labels, none, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
