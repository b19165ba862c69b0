"""Toxicity scores of a bidirectional gated recurrent network, trained in numpy.

A word's input is an embedding of the word and the mean of embeddings of its character
n-grams (both by hash, so no word is unknown).  A forward and a backward gated recurrent
layer read a window of words, attention pools their states, and a logistic unit scores the
window.  A document's score is that of its highest window, over overlapping windows that
cover the whole text.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import mixed

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class NetPlan:
    """Sizes of the network and bounds of its training.

    The fit sees at most ``max_docs`` labelled documents of either class, none over
    ``max_bytes``, taken by the hash of their identifier; ``dim`` and ``hidden`` are numbers
    of embedding and state values, windows of ``window`` words begin every ``stride``.
    """

    max_docs: int = 1500
    max_bytes: int = 16384
    window: int = 32
    stride: int = 16
    word_rows: int = 1 << 14
    gram_rows: int = 1 << 15
    grams: tuple[int, ...] = (3, 4, 5, 6, 7)
    dim: int = 8
    hidden: int = 8
    attention: int = 8
    epochs: int = 6
    steps: int = 240
    batch: int = 256
    rate: float = 0.01
    seed: int = 5
    threshold: float = 0.7


class Lexicon:
    """Numbers words; number 0 fills the end of a window.  Grows with what it is shown."""

    def __init__(self, plan: NetPlan):
        self.plan, self.ids = plan, {"": 0}

    def number(self, text: str, new: list[str]) -> np.ndarray:
        ids = self.ids
        found = _WORD.findall(text.lower()) if text else []
        out = np.empty(len(found), np.int64)
        for k, word in enumerate(found):
            n = ids.get(word)
            if n is None:
                n = ids[word] = len(ids)
                new.append(word)
            out[k] = n
        return out

    def hashed(self, new: list[str]):
        """``(word row of each word, n-gram rows, first n-gram of each word)``."""
        data = [b"<" + w.encode() + b">" for w in new]
        lengths = np.array([len(d) for d in data], np.int64)
        joined = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(new)), lengths)
        left = (first + lengths)[owner] - np.arange(len(joined))
        base = np.uint64(0x100000001B3)
        place = np.arange(len(joined)) - first[owner]
        power = np.cumprod(np.full(int(lengths.max(initial=1)) + 1, base, np.uint64))
        whole = np.add.reduceat(mixed(joined + power[place]), first)
        rows, owners = [], []
        for size in self.plan.grams:
            value = np.zeros(len(joined), np.uint64)
            for k in range(min(size, len(joined))):
                value[: len(joined) - k] = value[: len(joined) - k] * base + joined[k:] + np.uint64(1)
            good = left >= size
            rows.append(mixed(value[good] + np.uint64(size << 56)) % np.uint64(self.plan.gram_rows))
            owners.append(owner[good])
        rows, owners = np.concatenate(rows).astype(np.int64), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(new))
        return (
            (mixed(whole) % np.uint64(self.plan.word_rows)).astype(np.int64),
            rows[order], np.cumsum(counts) - counts, counts,
        )


def windows_of(count: int, plan: NetPlan) -> np.ndarray:
    """Where the windows of a text of ``count`` words begin; every word is in one."""
    return np.arange(0, max(1, count - plan.stride), plan.stride)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The weights, their scoring and their fit."""

    def __init__(self, plan: NetPlan):
        self.plan, self.key = plan, uuid.uuid4().hex
        rng = np.random.default_rng(plan.seed)
        d, h, a = 2 * plan.dim, plan.hidden, plan.attention

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.w = {
            "word": normal(plan.word_rows, plan.dim, scale=0.1),
            "gram": normal(plan.gram_rows, plan.dim, scale=0.1),
            "fill": normal(d, scale=0.1),
            "x": normal(2, d, 3 * h, scale=d**-0.5),
            "u": normal(2, h, 3 * h, scale=h**-0.5),
            "b": np.zeros((2, 3 * h), np.float32),
            "att": normal(2 * h, a, scale=(2 * h) ** -0.5),
            "att_b": np.zeros(a, np.float32),
            "att_v": normal(a, scale=a**-0.5),
            "out": normal(2 * h, scale=(2 * h) ** -0.5),
            "out_b": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])  # logit of a document from that of its highest window

    # Inputs

    def inputs(self, hashed) -> np.ndarray:
        word, rows, first, counts = hashed
        sums = np.add.reduceat(self.w["gram"][rows], first, axis=0)
        return np.concatenate([self.w["word"][word], sums / counts[:, None]], axis=1)

    # Windows

    def _states(self, gates):
        """States of both directions over ``gates [step, direction, window, 3 h]``, step by
        step, with what the gradient needs of each step."""
        steps, _, n, _ = gates.shape
        h = self.plan.hidden
        state, kept = np.zeros((2, n, h), np.float32), []
        for t in range(steps):
            inner = state @ self.w["u"]
            zr = _sigmoid(gates[t, :, :, : 2 * h] + inner[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(gates[t, :, :, 2 * h :] + r * inner[:, :, 2 * h :])
            kept.append((state, z, r, c, inner[:, :, 2 * h :]))
            state = state + z * (c - state)
            yield t, state, kept

    def logits(self, projected, windows) -> np.ndarray:
        """``projected [word, 2, 3 h]`` and ``windows [window, step]`` of word numbers."""
        n, steps = windows.shape
        h = self.plan.hidden
        by_step = windows.T
        states = np.empty((steps, n, 2 * h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        gates = np.empty((2, n, 3 * h), np.float32)
        forward, backward = projected[:, 0], projected[:, 1]
        for t in range(steps):
            gates[0], gates[1] = forward[by_step[t]], backward[by_step[steps - 1 - t]]
            inner = state @ self.w["u"]
            zr = gates[:, :, : 2 * h] + inner[:, :, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = inner[:, :, 2 * h :]
            c *= zr[:, :, h:]
            c += gates[:, :, 2 * h :]
            np.tanh(c, out=c)
            c -= state
            c *= zr[:, :, :h]
            state = state + c
            states[t, :, :h], states[steps - 1 - t, :, h:] = state[0], state[1]
        hidden = np.tanh(states @ self.w["att"] + self.w["att_b"])
        weight = np.exp(hidden @ self.w["att_v"])
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        return pooled @ self.w["out"] + self.w["out_b"][0]

    def project(self, inputs) -> np.ndarray:
        return np.einsum("nd,kdh->nkh", inputs, self.w["x"], optimize=True) + self.w["b"]

    # Training

    def gradients(self, hashed, windows, labels):
        """Mean loss and its gradient; ``windows`` number the words of ``hashed`` from 1."""
        w, h, dim = self.w, self.plan.hidden, self.plan.dim
        inputs = np.concatenate([w["fill"][None], self.inputs(hashed)])
        projected = self.project(inputs)
        n, steps = windows.shape
        by_step = windows.T
        gates = np.stack([projected[by_step, 0], projected[by_step[::-1], 1]], axis=1)
        states = np.empty((steps, n, 2 * h), np.float32)
        for t, state, kept in self._states(gates):
            states[t, :, :h], states[steps - 1 - t, :, h:] = state[0], state[1]
        hidden = np.tanh(states @ w["att"] + w["att_b"])
        score = hidden @ w["att_v"]
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        p = _sigmoid(pooled @ w["out"] + w["out_b"][0])
        loss = -np.mean(np.log(np.where(labels, p, 1 - p) + 1e-7))
        g = {}
        d_logit = ((p - labels) / n).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * w["out"]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * w["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tnd,tna->da", states, d_hidden, optimize=True)
        g["att_b"] = d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ w["att"].T
        d_gates = np.empty_like(gates)
        g["u"] = np.zeros_like(w["u"])
        d_state = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, c, inner = kept[t]
            d_state = d_state + np.stack([d_states[t, :, :h], d_states[steps - 1 - t, :, h:]])
            d_c = d_state * z * (1 - c**2)
            d_z = d_state * (c - before) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=2)
            d_inner = np.concatenate([d_z, d_r, d_c * r], axis=2)
            g["u"] += before.transpose(0, 2, 1) @ d_inner
            d_state = d_state * (1 - z) + d_inner @ w["u"].transpose(0, 2, 1)
        d_projected = np.zeros_like(projected)
        for k, order in ((0, by_step), (1, by_step[::-1])):
            flat, values = order.ravel(), d_gates[:, k].reshape(-1, 3 * h)
            for j in range(3 * h):
                d_projected[:, k, j] = np.bincount(flat, values[:, j], len(projected))
        g["b"] = d_projected.sum(axis=0)
        g["x"] = np.einsum("nd,nkh->kdh", inputs, d_projected, optimize=True)
        d_inputs = np.einsum("nkh,kdh->nd", d_projected, w["x"], optimize=True)
        g["fill"] = d_inputs[0]
        word, rows, _, counts = hashed
        own, mean = d_inputs[1:, :dim], d_inputs[1:, dim:] / counts[:, None]
        spread = np.repeat(np.arange(len(counts)), counts)
        g["word"] = np.stack(
            [np.bincount(word, own[:, j], self.plan.word_rows) for j in range(dim)], axis=1
        )
        g["gram"] = np.stack(
            [np.bincount(rows, mean[spread, j], self.plan.gram_rows) for j in range(dim)], axis=1
        )
        return loss, g

    def fit(self, texts, labels) -> None:
        """Fit windows by the labels of their documents.

        In the first epochs any windows of a toxic document count as toxic, later those that
        score highest; of the others the highest and random ones count as harmless.
        """
        plan, labels = self.plan, np.asarray(labels, bool)
        rng = np.random.default_rng(plan.seed)
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        if labels.all() or not labels.any():
            self.w["out"][:] = 0
            self.w["out_b"][:] = np.log(share / (1 - share))
            return
        lexicon, new = Lexicon(plan), []
        numbered = [lexicon.number(t, new) for t in texts]
        hashed = lexicon.hashed(new)
        windows, owner = _windows(numbered, plan)
        first = np.searchsorted(owner, np.arange(len(texts)))
        last = np.append(first[1:], len(owner))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        about = int(4 * labels.sum() + 2 * (~labels).sum())
        epochs = max(plan.epochs, min(40, plan.steps * plan.batch // about))
        for epoch in range(epochs):
            chosen, target = [], []
            score = None if epoch < max(2, epochs // 4) else self._all_logits(hashed, windows)
            for k in range(len(texts)):
                own = np.arange(first[k], last[k])
                random = rng.choice(own, min(4 if labels[k] else 2, len(own)), replace=False)
                if score is None:
                    picked = random
                else:
                    top = own[np.argsort(-score[own])[: 2 if labels[k] else 1]]
                    picked = top if labels[k] else np.append(top, random[0])
                chosen.append(picked)
                target.append(np.full(len(picked), labels[k], np.float32))
            chosen, target = np.concatenate(chosen), np.concatenate(target)
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), plan.batch):
                part = order[at : at + plan.batch]
                used, local = np.unique(windows[chosen[part]], return_inverse=True)
                local = local.reshape(len(part), plan.window)
                words = used[used > 0]
                if not len(words):
                    continue
                if used[0] > 0:
                    local = local + 1
                _, g = self.gradients(_some(hashed, words - 1), local, target[part])
                step += 1
                self._move(g, moment, step, plan.rate * (1 - 0.8 * epoch / epochs))
        highest = np.maximum.reduceat(self._all_logits(hashed, windows), first)
        self.scale = _calibrated(highest, labels)

    def _all_logits(self, hashed, windows):
        projected = self.project(np.concatenate([self.w["fill"][None], self.inputs(hashed)]))
        parts = [self.logits(projected, windows[k : k + 4096]) for k in range(0, len(windows), 4096)]
        return np.concatenate(parts)

    def _move(self, g, moment, step, rate):
        for k, value in g.items():
            m, v = moment[k]
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            m_hat, v_hat = m / (1 - 0.9**step), v / (1 - 0.99**step)
            self.w[k] -= (rate * m_hat / (np.sqrt(v_hat) + 1e-7)).astype(np.float32)


def _windows(numbered, plan):
    rows, owner = [], []
    for k, ids in enumerate(numbered):
        begin = windows_of(len(ids), plan)
        padded = np.append(ids, np.zeros(plan.window, np.int64))
        rows.append(padded[begin[:, None] + np.arange(plan.window)])
        owner.append(np.full(len(begin), k))
    return np.concatenate(rows), np.concatenate(owner)


def _some(hashed, chosen):
    word, rows, first, counts = hashed
    counts = counts[chosen]
    start = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(first[chosen] - start, counts)
    return word[chosen], rows[at], start, counts


def _calibrated(highest, labels):
    """Slope and shift of a logistic fit (Newton's method, a little regularised)."""
    x = np.stack([highest.astype(float), np.ones(len(highest))], axis=1)
    scale = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ scale)
        slope = x.T @ (labels - p) - 1e-2 * scale
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        scale = scale + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return np.array([max(scale[0], 1e-3), scale[1]])


class Scorer:
    """Scores texts; inputs of the gates are kept for words that were seen before."""

    def __init__(self, network: Network, most: int = 200_000):
        self.net, self.most = network, most
        self._clear()

    def _clear(self):
        self.lexicon = Lexicon(self.net.plan)
        self.projected = self.net.project(self.net.w["fill"][None]).astype(np.float32)

    def scores(self, texts) -> np.ndarray:
        if len(self.lexicon.ids) > self.most:
            self._clear()
        new: list[str] = []
        numbered = [self.lexicon.number(t, new) for t in texts]
        if new:
            added = self.net.project(self.net.inputs(self.lexicon.hashed(new)))
            self.projected = np.concatenate([self.projected, added.astype(np.float32)])
        windows, owner = _windows(numbered, self.net.plan)
        parts = [
            self.net.logits(self.projected, windows[k : k + 4096])
            for k in range(0, len(windows), 4096)
        ]
        highest = np.maximum.reduceat(
            np.concatenate(parts), np.searchsorted(owner, np.arange(len(texts)))
        )
        return _sigmoid(self.net.scale[0] * highest.astype(float) + self.net.scale[1])


def _scorer(network: Network) -> Scorer:
    """The worker's scorer of this network, kept for its next task."""
    kept = sys.modules.setdefault("llm_scorer", types.ModuleType("llm_scorer"))
    if getattr(kept, "key", None) != network.key:
        kept.key, kept.scorer = network.key, Scorer(network)
    return kept.scorer


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(
        F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False)
    )


def train(docs: DataFrame, labels: DataFrame, plan: NetPlan = NetPlan()) -> Network:
    """Fit a network on a bounded sample of the labels that are not held out.

    Rows without identifier, text or label are not learnt from.  Without documents of both
    classes the network gives every text the share of toxic ones.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg((F.max("label") > 0).alias("label"))
    )
    drawn = [
        known.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id")).limit(2 * plan.max_docs)
        for kind in (True, False)
    ]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 4 max_docs identifiers at most
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).filter(F.octet_length("text").between(1, plan.max_bytes))
    held = texts.join(chosen, "doc_id")
    sample = []
    for kind in (True, False):
        rows = held.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "text")
        sample += rows.limit(plan.max_docs).collect()
    network = Network(plan)
    network.fit([r["text"] for r in sample], [r["label"] for r in sample])
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs (doc_id, text)``.

    Whole texts are scored.  NULL, empty and blank texts are one window without words, and
    score like that; rows without ``doc_id`` are not held out; repeated rows are scored each;
    an empty table gives an empty result.  Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches):
        scorer = _scorer(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 20):
                    size += len(texts[end] or "")
                    end += 1
                found.append(scorer.scores(texts[at:end]))
                at = end
            values = np.concatenate(found) if found else np.zeros(0)
            predicted = (values >= sent.value.plan.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values),
                 pa.array(predicted)],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
