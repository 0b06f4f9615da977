"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read all bytes of a text, one from either end; at every byte a softmax over both states gives the probability
of each language, and a document's probabilities are the mean over all its bytes. So that texts of any length are read
side by side, a text is cut into chunks of CHUNK bytes; each is read with the WARM bytes on either side of it, whose
labels are not used, so a byte's label rests on WARM bytes or more of its surroundings. Outside the text stands a
symbol of its own. The network is trained in numpy, by backpropagation through time, on chunks of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm._shared import bounded_sample, settle, small_batches, text_of, tidy

HIDDEN, CHUNK, WARM = 12, 224, 16
OUTSIDE, SYMBOLS = 256, 257
#: Labelled documents that the network learns from at most.
FIT_ROWS = 3000
#: Steps of gradient descent, chunks of a step, bytes of a chunk that is learned from, the rate of learning.
STEPS, STEP, SPAN, RATE = 200, 160, 64, 0.02
#: Bytes of texts and chunks that are read side by side, about.
TOGETHER, ROWS = 2_000_000, 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class BiGru:
    """languages, and the weights, for either direction (f, b): of the symbols (SYMBOLS, H) and of the state (H, H), each
    for keeping (z), resetting (r) and the new state (n), and of the softmax (H, C); its bias (C)."""

    languages: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], seed: int = 1) -> BiGru:
        rng, h, c = np.random.default_rng(seed), HIDDEN, len(languages)
        w = {"bias": np.zeros(c)}
        for d in "fb":
            for gate in "zrn":
                w[f"x{gate}{d}"] = rng.standard_normal((SYMBOLS, h)) * 0.3 + (gate == "z")
                w[f"s{gate}{d}"] = rng.standard_normal((h, h)) / h**0.5
            w["o" + d] = rng.standard_normal((h, c)) / h**0.5
        return BiGru(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def read(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        """x: (T, B) symbols. States (T, B, H) in the order of x; keep gets what backpropagation needs."""
        w = self.w
        out = np.empty((*x.shape, HIDDEN), np.float32)
        state = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = sigmoid(w["xz" + d][x[t]] + state @ w["sz" + d])
            r = sigmoid(w["xr" + d][x[t]] + state @ w["sr" + d])
            u = state @ w["sn" + d]
            new = np.tanh(w["xn" + d][x[t]] + r * u)
            keep.append((t, state, z, r, u, new))
            state = out[t] = new + z * (state - new)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all symbols of x (T, B) with languages y (B) and weights (B), and its gradients."""
        w, kept = self.w, {"f": [], "b": []}
        states = {d: self.read(x, d, kept[d]) for d in "fb"}
        p = softmax(states["f"] @ w["of"] + states["b"] @ w["ob"] + w["bias"])
        share = (weight / (weight.sum() * len(x))).astype(np.float32)
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y, x.shape)[..., None], -1)[..., 0] + 1e-12) * share).sum())
        p[:, np.arange(len(y)), y] -= 1
        p *= share[:, None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"] = p.sum((0, 1))
        order = np.argsort(x, axis=None, kind="stable")
        symbols, first = np.unique(x.ravel()[order], return_index=True)
        for d in "fb":
            grad["o" + d] = states[d].reshape(-1, HIDDEN).T @ p.reshape(-1, p.shape[-1])
            back, carry = p @ w["o" + d].T, np.zeros((x.shape[1], HIDDEN), np.float32)
            given = {gate: np.empty((*x.shape, HIDDEN), np.float32) for gate in "zrn"}
            for t, state, z, r, u, new in reversed(kept[d]):
                g = back[t] + carry
                n = given["n"][t] = g * (1 - z) * (1 - new * new)
                to = {"z": g * (state - new) * z * (1 - z), "r": n * u * r * (1 - r), "n": n * r}
                given["z"][t], given["r"][t] = to["z"], to["r"]
                carry = g * z
                for gate, own in to.items():
                    grad[f"s{gate}{d}"] += state.T @ own
                    carry = carry + own @ w[f"s{gate}{d}"].T
            for gate, own in given.items():
                grad[f"x{gate}{d}"][symbols] = np.add.reduceat(own.reshape(-1, HIDDEN)[order], first)
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """Adam over chunks x (N, SPAN) with languages y (N), taken in a random order, again from the start if they are
        fewer than the steps need. Every language weighs the same."""
        rng = np.random.default_rng(seed)
        weight = 1.0 / np.bincount(y)[y]
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        queue = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            while len(queue) < min(STEP, len(x)):
                queue = np.append(queue, rng.permutation(len(x)))
            rows, queue = queue[:STEP], queue[STEP:]
            _, grad = self.gradients(np.ascontiguousarray(x[rows].T), y[rows], weight[rows])
            rate = RATE * (1 - (step - 1) / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, g in grad.items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                self.w[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, C) of each language at every symbol of x (T, B). The same sums as in read, with halved
        weights, as a sigmoid is a tangent of half its input, and in arrays that are used again."""
        w, size = self.w, (x.shape[1], HIDDEN)
        logits = np.empty((*x.shape, len(self.languages)), np.float32)
        logits[:] = w["bias"]
        half = np.float32(0.5)
        z, r, u, new, more = (np.empty(size, np.float32) for _ in range(5))
        for d in "fb":
            xz, xr, xn = w["xz" + d] * half, w["xr" + d] * half, w["xn" + d]
            sz, sr, sn = w["sz" + d] * half, w["sr" + d] * half, w["sn" + d] * half
            state = np.zeros(size, np.float32)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                for own, given, of_state in ((z, xz, sz), (r, xr, sr)):
                    np.take(given, x[t], 0, out=own, mode="clip")
                    np.dot(state, of_state, out=more)
                    np.add(own, more, out=own)
                    np.tanh(own, out=own)
                np.dot(state, sn, out=u)
                np.multiply(r, u, out=r)
                np.add(r, u, out=r)  # the reset state's share: (1 + tanh) / 2 of it
                np.take(xn, x[t], 0, out=new, mode="clip")
                np.add(new, r, out=new)
                np.tanh(new, out=new)
                np.subtract(state, new, out=state)
                np.multiply(state, half, out=state)
                np.multiply(z, state, out=z)
                np.add(new, state, out=new)
                np.add(new, z, out=state)
                logits[t] += state @ w["o" + d]
        return softmax(logits)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, C): the mean of the probabilities at all bytes of each text; 0 for empty ones."""
        lengths = np.array([len(t) for t in texts], np.int64)
        counts = -(-lengths // CHUNK)
        owner = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        # every text stands at a multiple of CHUNK behind WARM symbols of the outside, and so does the end
        buffer = np.full(int((counts + 1).sum()) * CHUNK + 2 * WARM, OUTSIDE, np.int16)
        begins = (np.cumsum(counts + 1) - counts) * CHUNK + WARM
        for t, at in zip(texts, begins.tolist(), strict=True):
            buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
        starts = begins[owner] + within * CHUNK - WARM
        total = np.zeros((len(texts), len(self.languages)))
        span, place = np.arange(CHUNK + 2 * WARM), np.arange(CHUNK)
        for at in range(0, len(starts), ROWS):
            rows = slice(at, at + ROWS)
            p = self.positions(buffer[starts[rows] + span[:, None]])[WARM : WARM + CHUNK]
            p[within[rows] * CHUNK + place[:, None] >= lengths[owner[rows]]] = 0
            np.add.at(total, owner[rows], p.sum(0))
        return total / np.maximum(lengths, 1)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(-1, keepdims=True)
    return p


def fit(labelled: DataFrame, rows: int = FIT_ROWS, steps: int | None = None) -> BiGru:
    """labelled: doc_id, text, lang. Of more than `rows` documents those with the smallest hash of doc_id and text are
    taken. All bytes of their texts are cut into chunks of SPAN; each step of training takes STEP of these, at random, so
    no more than steps * STEP, those with the smallest hash, reach the driver. Rows without lang or text don't count.
    With one language or none the answer is always that one, or `und`. steps: STEPS by default."""
    steps = steps or STEPS
    known = labelled.where("lang is not null and text is not null")
    sample = settle(bounded_sample(known, rows, "doc_id", "text").select("text", "lang"), "language-sample")

    def cut(batches):
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = [raw[max(0, i) : i + SPAN] for i in range(-WARM, len(raw), SPAN)]  # the first one has the outside in front
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([WARM] + [0] * (len(own) - 1), pa.int32()), pa.array([lang] * len(own), pa.string())], names=["chunk", "front", "lang"])

    chunks = sample.mapInArrow(cut, "chunk binary, front int, lang string")
    drawn = chunks.orderBy(F.xxhash64("chunk", "lang"), "chunk", "lang", "front").limit(steps * STEP).toArrow()
    languages = sorted({r["lang"] for r in sample.select("lang").distinct().collect()})
    model = BiGru.fresh(languages or ["und"])
    if len(languages) > 1 and len(drawn):
        x = np.full((len(drawn), SPAN), OUTSIDE, np.int16)
        for row, chunk, front in zip(x, drawn.column("chunk").to_pylist(), drawn.column("front").to_pylist(), strict=True):
            row[front : front + len(chunk)] = np.frombuffer(chunk, np.uint8)
        number = {lang: i for i, lang in enumerate(languages)}
        y = np.array([number[lang] for lang in drawn.column("lang").to_pylist()])
        model.train(x, y, steps)
    return model


def identify(df: DataFrame, model: BiGru, text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1), the best language's pooled probability. Every byte of a text is read,
    however long it is.

    Texts that are null or have no letter get `und` and 0. Ties go to the language that sorts first. Repeated rows come
    out repeated, an empty df stays empty, and columns of df named like these two raise ValueError.
    """
    clash = {"lang_pred", "score"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    small_batches(df.sparkSession)
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    source = df.withColumn("lang_pred", text_of(text))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, part, size = [], [], [], 0
            for k, t in enumerate(texts):
                part.append(t.encode("utf-8", "surrogatepass") if any(map(str.isalpha, t)) else b"")
                size += len(part[-1])
                if size >= TOGETHER or k + 1 == len(texts):
                    p = model.pooled(part)
                    best = p.argmax(1)
                    names += [model.languages[b] if own else "und" for b, own in zip(best.tolist(), part, strict=True)]
                    scores += np.minimum(1.0, p[np.arange(len(p)), best]).tolist()
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        tidy()

    return source.mapInArrow(run, schema)
