"""The network of the language model learns from every token of every training text."""

import zlib

import numpy as np

from cohortflow.llm import language_model, recurrent


def test_a_text_beyond_any_window_is_learned_from(spark):
    ids = {held: [i for i in range(40) if (zlib.crc32(str(i).encode()) % 5 == 1) == held] for held in (False, True)}
    rows = [(ids[False][0], "alpha 17 " * 5000), (ids[True][0], "alpha 17 " * 20)]
    found = {r["doc_id"]: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    r = found[ids[True][0]]
    assert r["train_tokens"] == 10_001 and r["score"] > r["base_score"] + 6  # the order of the two words is worth 40 * log10(2) at most


LAYOUT = recurrent.Layout(60, np.array([0, 1, 5, 30]), 8)


def test_every_token_is_a_target_once(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = np.append(rng.integers(1, 60, 300), [9000, 1])
    bounds = np.append(0, np.cumsum(lengths))
    codes = rng.integers(0, 68, bounds[-1])
    seen, real = [], recurrent.gradients

    def spy(m, layout, inputs, targets, h, scale):
        seen.append((inputs[targets >= 0], targets[targets >= 0]))
        return real(m, layout, inputs, targets, h, scale)

    monkeypatch.setattr(recurrent, "gradients", spy)
    learner = recurrent.Learner(recurrent.start(LAYOUT, 4, 4), LAYOUT)
    learner.learn(codes, bounds)
    before = np.append(68, codes[:-1])
    before[bounds[:-1]] = 68
    inputs, targets = (np.concatenate(x) for x in zip(*seen))
    assert learner.tokens == len(codes) and sorted(zip(inputs, targets)) == sorted(zip(before, codes))


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    layout = recurrent.Layout(7, np.array([0, 1, 4]), 2)
    m = {k: v.astype(np.float64) for k, v in recurrent.start(layout, 3, 2).items()}
    inputs = rng.integers(0, 10, (7, 4))
    targets = rng.integers(0, 9, (7, 4))
    targets[5:, 3] = -1
    h = rng.normal(size=(4, 3)) / 2
    g, _, loss = recurrent.gradients(m, layout, inputs, targets, h, 1.0)
    for k, v in m.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            kept, step = v[at], 1e-5
            v[at] = kept + step
            high = recurrent.gradients(m, layout, inputs, targets, h, 1.0)[2]
            v[at] = kept - step
            low = recurrent.gradients(m, layout, inputs, targets, h, 1.0)[2]
            v[at] = kept
            assert abs((high - low) / (2 * step) - g[k][at]) < 1e-5 * max(1, abs(g[k][at])), k


def plain_score(m, layout, codes):
    """Token by token, in plain loops."""
    h, before, total = np.zeros(m["wo"].shape[0]), layout.start, 0.0
    for code in codes:
        x, own, k = m["embed"][before] @ m["wx"] + m["bx"], h @ m["wh"] + m["bh"], len(h)
        z, r = (1 / (1 + np.exp(-(x[i * k : i * k + k] + own[i * k : i * k + k]))) for i in (0, 1))
        c = np.tanh(x[2 * k :] + r * own[2 * k :])
        h = (1 - z) * c + z * h
        scores = np.exp(h @ m["wo"] + m["bo"])
        if code >= layout.words:
            total += np.log(scores[code - layout.words] / scores.sum())
        else:
            own_class = max(i for i, first in enumerate(layout.firsts) if first <= code)
            low, high = layout.bounds(own_class)
            inside = np.exp(m["ww"][low:high] @ h + m["bw"][low:high])
            total += np.log(scores[layout.others + own_class] / scores.sum()) + np.log(inside[code - low] / inside.sum())
        before = code
    return total


def test_scores_equal_plain_loops_and_probabilities_add_up():
    rng = np.random.default_rng(8)
    m = recurrent.start(LAYOUT, 5, 4)
    m = {k: v + rng.normal(size=v.shape).astype(np.float32) / 4 for k, v in m.items()}
    texts = [rng.integers(0, 68, n) for n in (1, 40, 3, 700, 12)]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    found = recurrent.score(m, LAYOUT, np.concatenate(texts), bounds)
    assert np.allclose(found, [plain_score(m, LAYOUT, t) for t in texts], rtol=1e-4)
    each = recurrent.score(m, LAYOUT, np.arange(68), np.arange(69))
    assert abs(np.exp(each).sum() - 1) < 1e-5


def test_windows_carry_the_state(monkeypatch):
    rng = np.random.default_rng(9)
    m, codes = recurrent.start(LAYOUT, 4, 4), rng.integers(0, 68, (60, 3))
    before = np.vstack((np.full((1, 3), 68), codes[:-1]))
    h, total = np.zeros((3, 4), np.float32), 0.0
    for at in range(0, 60, 24):
        _, h, loss = recurrent.gradients(m, LAYOUT, before[at : at + 24], codes[at : at + 24], h, 1.0)
        total += loss
    assert abs(total + recurrent.score(m, LAYOUT, codes.T.ravel(), np.arange(0, 181, 60)).sum()) < 1e-2
