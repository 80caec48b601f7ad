"""Plain in-memory versions of what the library spreads over tasks."""

import numpy as np


def solve_logistic(x, y, c=1.0):
    """Newton's method on pair rows."""
    a = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(c * (a.T * (p * (1 - p))) @ a + np.diag(ridge + 1e-12), c * a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1], float(w[-1])


def lambdas(score, gain, group):
    """Gradient and curvature of a pool's NDCG loss from the table of all its pairs."""
    g, h = np.zeros(len(score)), np.zeros(len(score))
    for one in np.unique(group):
        at = np.flatnonzero(group == one)
        s, y = score[at], gain[at]
        place = np.empty(len(at), dtype=int)
        place[np.argsort(-s, kind="stable")] = np.arange(len(at))
        discount = 1 / np.log2(2.0 + place)
        ideal = (np.sort(y)[::-1] / np.log2(2.0 + np.arange(len(at)))).sum()
        better = y[:, None] > y[None]
        change = np.abs((y[:, None] - y[None]) * (discount[:, None] - discount[None])) / ideal * better
        p = 1 / (1 + np.exp(np.clip(s[:, None] - s[None], -35, 35)))
        pull, bend = change * p, change * p * (1 - p)
        g[at] += pull.sum(axis=0) - pull.sum(axis=1)
        h[at] += bend.sum(axis=0) + bend.sum(axis=1)
    return g, h


def fit_listwise(x, rank, group, sampled, columns_of, cuts, rounds, depth=3, rate=0.05, l1=1.0, l2=5.0, least=5.0):
    """Scores of all rows by boosted trees, a node and a threshold at a time; ``sampled(round)`` says which rows count."""
    n, d = x.shape
    gain, score = np.maximum(32 - rank, 1).astype(float), np.zeros(n)
    best = lambda g, h: max(abs(g) - l1, 0) ** 2 / (h + l2)
    for round_ in range(rounds):
        g, h = lambdas(score, gain, group)
        unit = h.mean()
        g, h = g / unit, h / unit
        rows = sampled(round_)

        def grow(inside, level):
            used = inside & rows
            gs, hs = g[used].sum(), h[used].sum()
            if level == depth:
                score[inside] += -rate * np.sign(gs) * max(abs(gs) - l1, 0) / (hs + l2)
                return
            found = (1e-12, None)
            for f in columns_of(round_):
                v = x[:, f]
                for missing_left in (True, False):
                    for cut in cuts[f]:
                        left = used & np.where(np.isnan(v), missing_left, v < cut)
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= least and hs - hl >= least:
                            won = best(gl, hl) + best(gs - gl, hs - hl) - best(gs, hs)
                            if won > found[0] + 1e-9:
                                found = (won, np.where(np.isnan(v), missing_left, v < cut))
            if found[1] is None:
                grow(inside, level + 1) if level + 1 == depth else grow_whole(inside, level + 1)
                return
            grow(inside & found[1], level + 1)
            grow(inside & ~found[1], level + 1)

        def grow_whole(inside, level):
            grow(inside, depth if level == depth else level)

        grow(np.ones(n, dtype=bool), 0)
    return score
