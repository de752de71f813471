"""The stated optimizer and the least-exposed scheduler against plain loops."""

import collections

import numpy as np
import pytest

from tessera.operators import heads, sampling


def plain_adamw(x, y, classes, epochs, lr, decay):
    """Per-row sums and per-parameter steps."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std < 1e-6, 1.0, std)
    x = (x - mean) / std
    counts = np.maximum(np.bincount(y, minlength=classes), 1)
    cw = 1 / np.sqrt(counts)
    cw /= cw.mean()
    p = np.zeros((classes, x.shape[1] + 1))
    m, v, best = np.zeros_like(p), np.zeros_like(p), None
    for t in range(1, epochs + 1):
        g, loss, total = np.zeros_like(p), 0.0, 0.0
        for row, label in zip(x, y, strict=True):
            z = p[:, :-1] @ row + p[:, -1]
            q = np.exp(z) / np.exp(z).sum()
            loss -= cw[label] * np.log(q[label])
            total += cw[label]
            for c in range(classes):
                d = cw[label] * (q[c] - (c == label))
                g[c] += d * np.append(row, 1)
        g /= total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - lr * decay) - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if best is None or loss / total < best[0]:
            best = (loss / total, t - 1, p.copy())
    return best, mean, std


def test_adamw_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    y = rng.choice(3, 120, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(120, 4)) + np.eye(3, 4)[y]
    x[:, 3] = 2.0  # a constant feature
    rows = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y, strict=True)] + [(None, 1), ([0.0] * 4, None)], "f array<double>, y int").repartition(3)
    head = heads.fit_adamw(rows, "f", "y", epochs=12, lr=0.3)
    (loss, epoch, p), mean, std = plain_adamw(x, y, 3, 12, 0.3, 2e-3)
    assert head.epoch == epoch and head.loss == pytest.approx(loss)
    assert np.allclose(head.weight, p[:, :-1]) and np.allclose(head.bias, p[:, -1])
    assert np.allclose(head.mean, mean) and np.allclose(head.std, std)
    with pytest.raises(ValueError, match="no rows"):
        heads.fit_adamw(rows.limit(0), "f", "y")


def test_gradient_of_the_weighted_loss():
    rng = np.random.default_rng(6)
    x, y, cw = rng.normal(size=(30, 3)), rng.integers(0, 3, 30), np.array([0.5, 1.0, 1.5])
    p = rng.normal(size=12)
    loss = lambda q: heads.gradient_sums(x, y, q[:9].reshape(3, 3), q[9:], cw)[-2]
    by_steps = [(loss(p + 1e-6 * e) - loss(p - 1e-6 * e)) / 2e-6 for e in np.eye(12)]
    assert np.allclose(heads.gradient_sums(x, y, p[:9].reshape(3, 3), p[9:], cw)[:12], by_steps, atol=1e-5)


def test_classes_take_turns_by_exposure(spark):
    classes = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([(c,) for c in classes] + [(None,), ("c1",)], "label string")
    turns = [(r.batch, r.label, r.visit) for r in sampling.class_turns(df.repartition(4), "label", 3, 20, "s").collect()]
    again = [(r.batch, r.label, r.visit) for r in sampling.class_turns(df.coalesce(1), "label", 3, 20, "s").collect()]
    assert sorted(turns) == sorted(again) and len(turns) == 60
    seen = collections.Counter()
    orders = set()
    for batch in range(20):
        taken = [(label, visit) for b, label, visit in turns if b == batch]
        assert len({label for label, _ in taken}) == 3
        for label, visit in taken:
            assert visit == seen[label]
            seen[label] += 1
        assert max(seen.values()) - min(seen[c] for c in classes) <= 1
        orders.add(frozenset(label for label, _ in taken))
    assert len(orders) > 7  # ties are drawn anew
    assert sampling.class_turns(df.limit(0), "label", 3, 20, "s").collect() == []
    few = sampling.class_turns(spark.createDataFrame([(1,), (2,)], "label int"), "label", 5, 2, "s").collect()
    assert sorted((r.batch, r.label) for r in few) == [(0, 1), (0, 2), (1, 1), (1, 2)]
