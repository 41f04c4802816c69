"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its UTF-8 bytes, cut into windows of fixed length; in each window one recurrence runs
forward and one backward from a zero state, every position gets a probability for each language from
both states, and a document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time on windows of a bounded sample of labelled rows.

Null texts and texts without a letter are ``und`` with score 0; nothing is learned from null
languages or empty texts. Without training rows every prediction is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, narrow, slices
from .toxicity import held_out

UNDEFINED = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes in a window; states start anew in each.
WINDOW = 128
#: Windows worked in lock step; small enough for matrix products to stay in one thread.
BLOCK = 1536
#: At most so many labelled rows of each language are learned from, with a stretch of so many bytes each.
SAMPLE, STRETCH = 600, 512


def sigmoid(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|)."""
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``sigmoid`` where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Network:
    """Two gated recurrences of ``hidden`` units over bytes and a softmax over both states.

    For each direction: ``x`` (256, 3h) the input's part of the update, reset and candidate gates,
    biases included; ``u`` (h, 3h) the state's part; ``d`` (h) the candidate's inner bias. A gate is
    (1 + s(x)) / 2 and the candidate s(x), with the algebraic sigmoid s(x) = x / (1 + |x|).
    """

    langs: list[str]
    params: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.params["uf"].shape[0]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (256, 3 * hidden))
            p["u" + d] = r.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
            p["d" + d] = np.zeros(hidden)
        p["v"] = r.normal(0, 0.1, (2 * hidden, len(langs)))
        p["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def states(self, steps: np.ndarray, direction: str, mask: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """States (time, rows, h) after each byte of ``steps`` (time, rows); masked steps keep zero states."""
        x, u, inner = (self.params[k + direction] for k in "xud")
        h, (time, rows) = self.hidden, steps.shape
        out = np.zeros((time, rows, h), np.float32)
        state = np.zeros((rows, h), np.float32)
        a, b = np.empty((rows, 3 * h), np.float32), np.empty((rows, 3 * h), np.float32)
        for t in range(time) if direction == "f" else range(time - 1, -1, -1):
            np.take(x, steps[t], axis=0, out=a, mode="clip")
            np.matmul(state, u, out=b)
            gate = sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            gate += 1
            gate *= 0.5
            z, r = gate[:, :h], gate[:, h:]
            q = b[:, 2 * h :] + inner
            n = sigmoid(a[:, 2 * h :] + r * q)
            new = n + z * (state - n)
            if mask is not None:
                new *= mask[t]
            if trace is not None:
                trace.append((t, state, z, r, n, q))
            out[t] = state = new
        return out

    def totals(self, steps: np.ndarray, active: list[int]) -> np.ndarray:
        """(rows, languages) sums of the probabilities of all positions.

        ``steps`` (time, rows) holds byte strings in order of descending length, of which the first
        ``active[t]`` have a byte at time t; the others are not worked there, so that no step is padded.
        A row's backward state is zero until its last byte.
        """
        h, rows, langs = self.hidden, steps.shape[1], len(self.langs)
        time = sum(1 for n in active if n)
        logits = np.empty((time, langs, rows), np.float32)
        out = np.zeros((langs, rows), np.float64)
        gates, sums, over, spare = (np.empty((k, rows, h), np.float32) for k in (3, 3, 3, 1))
        for d, order in (("f", range(time)), ("b", range(time - 1, -1, -1))):
            # one table for each gate; the candidate's part is in halves, as it meets (1 + s) / 2
            x = [np.ascontiguousarray(self.params["x" + d][:, i * h : (i + 1) * h]) for i in range(3)]
            u = np.stack([self.params["u" + d][:, i * h : (i + 1) * h] for i in range(3)])
            u[2] *= 0.5
            inner = np.tile(0.5 * self.params["d" + d], (rows, 1))
            v = np.ascontiguousarray((self.params["v"][:h] if d == "f" else self.params["v"][h:]).T)
            state = np.zeros((rows, h), np.float32)
            for t in order:
                n = active[t]
                g, b, o, s, diff = gates[:, :n], sums[:, :n], over[:, :n], state[:n], spare[0, :n]
                for table, into in zip(x, g, strict=True):
                    np.take(table, steps[t, :n], axis=0, out=into, mode="clip")
                np.matmul(s, u, out=b)
                g[:2] += b[:2]
                np.abs(g[:2], out=o[:2])
                o[:2] += 1
                g[:2] /= o[:2]
                b[2] += inner[:n]
                g[2] += b[2]
                b[2] *= g[1]
                g[2] += b[2]
                np.abs(g[2], out=o[2])
                o[2] += 1
                g[2] /= o[2]
                np.subtract(s, g[2], out=diff)
                diff *= g[0]
                s += g[2]
                s += diff
                s *= 0.5
                own = logits[t, :, :n]
                if d == "f":
                    np.matmul(v, s.T, out=own)
                    own += self.params["c"][:, None]
                else:
                    own += v @ s.T
                    own -= own.max(0)
                    np.exp(own, out=own)
                    own /= own.sum(0)
                    out[:, :n] += own
        return out.T

    def gradients(self, steps: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the labelled positions, and its gradients, by backpropagation through time."""
        p, h = self.params, self.hidden
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(steps, d, mask, traces[d]) for d in "fb"], axis=2)
        logits = both @ p["v"] + p["c"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        share = mask * weight[None, :, None]
        total = share.sum()
        right = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (*steps.shape, 1)), axis=2)
        loss = float(-(np.log(right + 1e-9) * share).sum() / total)
        delta = prob
        np.put_along_axis(delta, np.broadcast_to(label[None, :, None], (*steps.shape, 1)), right - 1, axis=2)
        delta *= share / total
        g = {"v": both.reshape(-1, 2 * h).T @ delta.reshape(-1, delta.shape[2]), "c": delta.sum((0, 1))}
        upper = delta @ p["v"].T
        by_byte = np.argsort(steps, axis=None, kind="stable")  # the positions of each byte value, together
        seen, firsts = np.unique(steps.ravel()[by_byte], return_index=True)
        for i, d in enumerate("fb"):
            gu, gd, inputs = np.zeros_like(p["u" + d]), np.zeros_like(p["d" + d]), np.zeros((*steps.shape, 3 * h), np.float32)
            carry = np.zeros((steps.shape[1], h), np.float32)
            for t, state, z, r, n, q in reversed(traces[d]):
                e = (carry + upper[t][:, i * h : (i + 1) * h]) * mask[t]
                en = e * (1 - z) * slope(n)
                ez = e * (state - n) * 0.5 * slope(2 * z - 1)
                er = en * q * 0.5 * slope(2 * r - 1)
                eq = en * r
                np.concatenate([ez, er, en], axis=1, out=inputs[t])
                es = np.concatenate([ez, er, eq], axis=1)
                gu += state.T @ es
                gd += eq.sum(0)
                carry = e * z + es @ p["u" + d].T
            gx = np.zeros_like(p["x" + d])
            gx[seen] = np.add.reduceat(inputs.reshape(-1, 3 * h)[by_byte], firsts, axis=0)
            g |= {"x" + d: gx, "u" + d: gu, "d" + d: gd}
        return loss, g


def train(texts: list[bytes], labels: list[str], hidden: int = 12, window: int = 64, batch: int = 192, rounds: int = 260, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network fitted by Adam on windows of ``texts``; languages weigh alike."""
    langs = sorted(set(labels))
    if not langs:
        return None
    number = {l: i for i, l in enumerate(langs)}
    rows, owner = [], []
    for text, lang in zip(texts, labels, strict=True):
        for at in range(0, len(text), window):
            if (piece := text[at : at + window]) and (at == 0 or len(piece) > window // 4):
                rows.append(piece)
                owner.append(number[lang])
    steps, mask = windows_of(rows, window)
    label = np.array(owner)
    counts = np.bincount(label, minlength=len(langs))
    weight = (len(label) / (len(langs) * np.maximum(counts, 1)))[label].astype(np.float32)
    net = Network.fresh(langs, hidden, seed)
    draw = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    for i in range(1, rounds + 1):
        pick = draw.integers(0, len(rows), min(batch, len(rows)))
        _, grads = net.gradients(steps[:, pick], mask[:, pick], label[pick], weight[pick])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        step = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.params[k] -= (step * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def windows_of(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, rows) bytes and (time, rows, 1) mask of byte strings, shorter ones padded."""
    raw = np.frombuffer(b"".join(p.ljust(length, b"\0") for p in pieces), np.uint8).reshape(len(pieces), length)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    mask = (np.arange(length)[:, None] < sizes[None, :]).astype(np.float32)[:, :, None]
    return np.ascontiguousarray(raw.T).astype(np.intp), mask


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(documents, languages) mean probabilities over all positions of every text; zeros for empty ones."""
    out = np.zeros((len(texts), len(net.langs)))
    held: dict[bytes, int] = {}  # windows that are equal are worked once
    owner: list[int] = []
    piece: list[int] = []

    def flush() -> None:
        pieces = list(held)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        length = int(sizes[order[0]])
        raw = np.frombuffer(b"".join(pieces[i].ljust(length, b"\0") for i in order.tolist()), np.uint8).reshape(len(pieces), length)
        active = (len(pieces) - np.searchsorted(np.sort(sizes), np.arange(length), side="right")).tolist()
        sums = np.empty((len(pieces), len(net.langs)))
        sums[order] = net.totals(np.ascontiguousarray(raw.T).astype(np.intp), active)
        np.add.at(out, np.array(owner), sums[np.array(piece)])
        held.clear()
        owner.clear()
        piece.clear()

    for i, text in enumerate(texts):
        for at in range(0, len(text), WINDOW):
            piece.append(held.setdefault(text[at : at + WINDOW], len(held)))
            owner.append(i)
            if len(held) == BLOCK:
                flush()
    if held:
        flush()
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, modulus: int, rest: int, size: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """A stretch of at most ``size`` training rows of each language, rows and places by a hash of the id."""
    rows = narrow(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and text <> ''").where(~held_out(modulus, rest))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col("lang") == l, F.lit(int(min(1_000_000, 2_000_000 * size / n + 100)))) for l, n in counts.items()])
    start = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - STRETCH, F.lit(1))).cast("int")
    near = rows.where(order < share).select("doc_id", "lang", order.alias("o"), F.substr("text", start + 1, F.lit(STRETCH)).alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "text"))
    picked = near.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("lang", "turn").select("lang", "text").collect()
    return [r.text.encode()[:STRETCH] for r in picked], [r.lang for r in picked]


def fit(docs: DataFrame, modulus: int = 4, rest: int = 2) -> Network | None:
    """A network learned from the rows outside the held-out part."""
    return train(*sample(docs, modulus, rest))


def predict(net: Network | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    lang, score = [UNDEFINED] * len(column), [0.0] * len(column)
    base = 0
    for texts in slices(column, 1_000_000, 256):
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if net is not None and some:
            probs = pooled(net, [texts[i].encode() for i in some])
            for i, p in zip(some, probs, strict=True):
                best = int(p.argmax())
                lang[base + i], score[base + i] = net.langs[best], round(float(min(1.0, p[best])), 6)
        base += len(texts)
    return lang, score


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. One narrow pass over whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(net, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return by_batch(rows, run, "doc_id long, lang_pred string, score double", "langid")


def accepted(docs: DataFrame, net: Network | None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not ``und`` and scores ``least`` at least."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(net, batch.column(batch.schema.get_field_index(text_col)))
        return batch.filter(pa.array([l != UNDEFINED and s >= least for l, s in zip(lang, score, strict=True)], pa.bool_()))

    return by_batch(docs, run, docs.schema, "langid")


def identified(docs: DataFrame, net: Network | None, sure: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, all columns; ``lang_col`` becomes the language of the text.

    A prediction that scores over ``sure`` stands. Below that a given language stays, and a row without one takes the prediction.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(net, batch.column(batch.schema.get_field_index(text_col)))
        at = batch.schema.get_field_index(lang_col)
        given = batch.column(at).to_pylist()
        found = [l if s > sure or g is None else g for l, s, g in zip(lang, score, given, strict=True)]
        out = batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))
        return out.filter(pa.array([l != UNDEFINED for l in lang], pa.bool_()))

    return by_batch(docs, run, docs.schema, "langid")


def languages(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """Fit on the training part of ``docs`` and predict all of it: doc_id, held_out, lang_pred, score."""
    net = fit(docs, modulus, rest)
    return identify(docs, net).select("doc_id", held_out(modulus, rest).alias("held_out"), "lang_pred", "score")
