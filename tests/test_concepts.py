"""Concepts in blocks of rows against one row after the other."""

import numpy as np
import pytest

from tidewire.functions.ks import ks_min_p_value, ks_p_value, ks_p_values
from tidewire.operators.concepts import draw, growing_percentiles, sliding_distances
from tidewire.operators.drift import concept_drift


def one_by_one(rows, least, most):
    """(key, scaled, concept, malicious, concepts) of every decided row, from the rule, with lists only."""
    samples, seen, evil = {0: []}, {0: 0}, {0: False}
    current, made, orders, queue, out = 0, 0, [], [], []

    def take(c, row):
        seen[c] += 1
        if len(samples[c]) < most:
            samples[c].append(row)
        elif (place := int(draw(c, np.array([seen[c]]))[0])) < most:
            samples[c][place] = row

    for key, row in rows:
        if not np.any(row):
            out.append((key, tuple(row), -1, False, len(samples)))
            continue
        if seen[0] < least and not queue and not made:
            take(0, row)
            continue
        if len(queue) < least:
            queue.append((key, row))
            continue
        block = np.array([r for _, r in queue])
        if not orders:
            p = ks_min_p_value(np.array(samples[current]), block)
            if p < 0.01:
                fit = {c: ks_min_p_value(block, np.array(s)) for c, s in samples.items()}
                homes = [c for c, v in fit.items() if v > 0.01]
                if not homes:
                    made += 1
                    homes = [made]
                    samples[made], seen[made], evil[made] = [], 0, max(fit.values()) < 1e-4
                    for r in block:
                        take(made, r)
                for other in homes[1:]:
                    for r in samples.pop(other):
                        take(homes[0], r)
                    evil[homes[0]] = evil[homes[0]] or evil[other]
                current = homes[0]
            orders = [current] * (1 if 0.01 <= p <= 0.99 else least)
        home = orders.pop(0)
        k, first = queue.pop(0)
        low, mid, high = np.percentile(np.array(samples[home]), [16, 50, 84], axis=0)
        out.append((k, tuple((first - mid) / np.where(high == low, 1.0, high - low)), home, evil[home], len(samples)))
        take(home, first)
        queue.append((key, row))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize(("seed", "most"), [(1, 400), (2, 45), (3, 70)])
def test_against_single_rows(spark, seed, most):
    rng = np.random.default_rng(seed)
    rows, levels = [], [(0, 1), (0, 1), (4, 1), (0.4, 1.1), (40, 3), (0, 1), (4, 1)]
    for i in range(900):
        centre, spread = levels[(i // 110) % len(levels)]
        item = np.round(rng.normal(centre, spread, 2), 1)
        rows.append((i, np.zeros(2) if rng.random() < 0.07 else item))
    table = [(n, i, *map(float, x)) for n, part in (("a", rows), ("b", rows[200:350]), ("c", rows[:20])) for i, x in part]
    df = spark.createDataFrame(table, "node string, snapshot_id long, count double, size double")
    cut = concept_drift(df, ["count", "size"], min_rows=30, max_rows=most, chunk_rows=170).collect()
    whole = concept_drift(df, ["count", "size"], min_rows=30, max_rows=most).collect()
    key = lambda r: (r.node, r.snapshot_id)
    assert sorted(cut, key=key) == sorted(whole, key=key)
    for name, part in (("a", rows), ("b", rows[200:350]), ("c", rows[:20])):
        wanted = one_by_one(part, 30, most)
        got = sorted((r for r in whole if r.node == name), key=key)
        assert [(r.snapshot_id, r.concept_id, r.malicious_concept, r.num_concepts) for r in got] == [(k, c, bool(m), n) for k, _, c, m, n in wanted]
        assert np.allclose([(r["count"], r["size"]) for r in got], [s for _, s, *_ in wanted])
        by_key = dict(part)
        assert all((r.original_count, r.original_size) == tuple(by_key[r.snapshot_id]) for r in got)
    assert len({r.concept_id for r in whole if r.node == "a"}) > 2


def test_pieces():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, m = int(rng.integers(3, 40)), int(rng.integers(1, 30))
        held, added = np.sort(rng.integers(0, 9, n).astype(float)), rng.integers(0, 12, m).astype(float)
        got = growing_percentiles(held, added)
        assert np.allclose(got, [np.percentile(np.concatenate((held, added[:t])), [16, 50, 84]) for t in range(m)])
        count, enter = int(rng.integers(1, 6)), int(rng.integers(0, 6))
        rows = rng.integers(0, 9, count - 1 + 7).astype(float)
        for t, d in enumerate(sliding_distances(held, rows, 7, count, enter)):
            x, y = np.concatenate((held, rows[: min(t, enter)])), rows[t : t + 7]
            grid = np.unique(np.concatenate((x, y)))
            assert d == pytest.approx(np.abs((x[:, None] <= grid).mean(0) - (y[:, None] <= grid).mean(0)).max())
    sizes, d = np.array([30, 31, 77, 300]), np.array([0.2, 0.0, 0.31, 0.11])
    assert np.allclose(ks_p_values(d, 30, sizes), [ks_p_value(a, 30, int(b)) for a, b in zip(d, sizes, strict=True)])
