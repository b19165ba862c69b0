import random
import re
import zlib

import numpy as np

from balance_spark.llm import toxicity


def test_gradients():
    """Numeric and analytic slopes agree."""
    plan = toxicity.NetPlan(word_rows=64, gram_rows=64, dim=2, hidden=3, attention=2, window=4, stride=2)
    net = toxicity.Network(plan)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    lexicon, new = toxicity.Lexicon(plan), []
    numbered = [lexicon.number(t, new) for t in ("an odd text to read", "so it is", "")]
    hashed = lexicon.hashed(new)
    windows, _ = toxicity._windows(numbered, plan)
    labels = (np.arange(len(windows)) % 2).astype(float)
    _, slopes = net.gradients(hashed, windows, labels)
    rng = np.random.default_rng(1)
    for name, value in net.w.items():
        flat = value.reshape(-1)
        for at in rng.integers(0, len(flat), 6):
            kept = flat[at]
            ends = []
            for step in (1e-4, -1e-4):
                flat[at] = kept + step
                ends.append(net.gradients(hashed, windows, labels)[0])
            flat[at] = kept
            numeric = (ends[0] - ends[1]) / 2e-4
            assert abs(numeric - np.reshape(slopes[name], -1)[at]) < 1e-4 + 1e-2 * abs(numeric), name


def test_held_out_accuracy(spark, documents, clashing):
    rng = random.Random(13)
    rows, labels = [], []
    for d in range(1800):
        text = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.randrange(20, 200))]
        bad = d % 3 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["idiot", "Scum,", f"vile{rng.randrange(99)}x"])
        rows.append((d, " ".join(text)))
        labels.append((d, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, " "), (None, "scum idiot"), (0, rows[0][1])]
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    docs = clashing(documents(*rows))
    net = toxicity.train(docs, known)
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.93
    empty = [r for r in got if r["doc_id"] in (9000, 9001, 9002)]
    assert len({r["score"] for r in empty}) == 1 and empty[0]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.filter("false"), net).count() == 0


def test_one_class(spark, documents):
    docs = documents((1, "a"), (2, "b"))
    known = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    net = toxicity.train(docs, known.filter("false"))
    assert {r["predicted"] for r in toxicity.score(docs, net).collect()} == {0}


def test_windows_cover_texts():
    plan = toxicity.NetPlan()
    for count in (0, 1, 16, 17, 32, 33, 48, 49, 1000):
        begin = toxicity.windows_of(count, plan)
        assert begin[-1] + plan.window >= count
        assert (np.diff(begin) == plan.stride).all()


MASK = (1 << 64) - 1


def mix(v):
    v &= MASK
    v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & MASK
    v = ((v ^ v >> 27) * 0x94D049BB133111EB) & MASK
    return v ^ v >> 31


def plain_input(word, w, plan):
    """The embedding of one word: its own row, and the mean of its n-grams' rows."""
    data, base = b"<" + word.encode() + b">", 0x100000001B3
    whole = sum(mix(byte + pow(base, k + 1, 1 << 64)) for k, byte in enumerate(data)) & MASK
    grams = []
    for size in plan.grams:
        for at in range(len(data) - size + 1):
            value = 0
            for byte in data[at : at + size]:
                value = (value * base + byte + 1) & MASK
            grams.append(mix(value + (size << 56)) % plan.gram_rows)
    return np.concatenate([w["word"][mix(whole) % plan.word_rows], w["gram"][grams].mean(axis=0)])


def plain_direction(inputs, w, k, h):
    """The states of one gated recurrent direction, step by step."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    state, out = np.zeros(h), []
    for x in inputs:
        gate, inner = x @ w["x"][k] + w["b"][k], state @ w["u"][k]
        z, r = sigmoid(gate[:h] + inner[:h]), sigmoid(gate[h : 2 * h] + inner[h : 2 * h])
        c = np.tanh(gate[2 * h :] + r * inner[2 * h :])
        state = (1 - z) * state + z * c
        out.append(state)
    return out


def plain_score(text, net):
    """The score of a text, one window and one word after the other."""
    plan, w = net.plan, {k: v.astype(float) for k, v in net.w.items()}
    found = re.findall(r"\w+", (text or "").lower())
    logits = []
    for begin in range(0, max(1, len(found) - plan.stride), plan.stride):
        held = found[begin : begin + plan.window]
        inputs = [plain_input(word, w, plan) for word in held] + [w["fill"]] * (plan.window - len(held))
        forward = plain_direction(inputs, w, 0, plan.hidden)
        backward = plain_direction(inputs[::-1], w, 1, plan.hidden)[::-1]
        states = np.array([np.concatenate(both) for both in zip(forward, backward)])
        weight = np.exp(np.tanh(states @ w["att"] + w["att_b"]) @ w["att_v"])
        logits.append(weight / weight.sum() @ states @ w["out"] + w["out_b"][0])
    return 1 / (1 + np.exp(-(net.scale[0] * max(logits) + net.scale[1])))


def test_scores_equal_the_network_written_out():
    """All windows of every text, also of a very long one, against plain loops."""
    plan = toxicity.NetPlan(
        word_rows=64, gram_rows=128, grams=(3, 4, 5), dim=3, hidden=4, attention=5, window=6, stride=3
    )
    net, rng = toxicity.Network(plan), random.Random(4)
    net.w = {k: (v * 8).astype(np.float32) for k, v in net.w.items()}
    net.scale = np.array([1.3, -0.2])
    said = ["Ärger", "so", "it", "is", "語", "idiot", "a", "text", "x1", "überlang" * 4, "Ok,"]
    texts = [None, "", " ", "a", *(" ".join(rng.choice(said) for _ in range(n)) for n in (2, 5, 6, 7, 9, 10, 40))]
    texts.append(" ".join(rng.choice(said) + str(rng.randrange(300)) for _ in range(2500)))
    got = toxicity.Scorer(net).scores(texts)
    want = [plain_score(t, net) for t in texts]
    assert np.allclose(got, want, atol=1e-4)
    assert np.ptp(want) > 0.05
