"""Dense estimator on expanded designs, for small panels: no aggregation, no elimination."""

import numpy as np


def dense(y, worker, firm, unit, n=None, t=None, deletion="match", centering="none", z=None, joint=False):
    y, n = np.asarray(y, float), np.ones(len(y)) if n is None else np.asarray(n, float)
    t = n if t is None else np.asarray(t, float)
    w, f = (np.unique(np.asarray(x), return_inverse=True)[1] for x in (worker, firm))
    d, ff = np.eye(w.max() + 1)[w], np.eye(f.max() + 1)[f][:, :-1]
    x = np.hstack([d, ff])
    if joint:
        x = np.hstack([x, np.asarray(z, float)])
    elif z is not None:
        full = np.hstack([x, np.asarray(z, float)])
        b = np.linalg.solve(full.T @ (n[:, None] * full), full.T @ (n * y))
        y = y - np.asarray(z, float) @ b[x.shape[1] :]
    a = np.linalg.inv(x.T @ (n[:, None] * x))
    b = a @ x.T @ (n * y)
    e = y - x @ b
    s = t / t.sum()
    c = np.diag(s) - np.outer(s, s)
    pad_d, pad_f = 0 * x, 0 * x
    pad_d[:, : d.shape[1]], pad_f[:, d.shape[1] : d.shape[1] + ff.shape[1]] = d, ff
    q = [pad_d.T @ c @ pad_d, pad_f.T @ c @ pad_f, (pad_d.T @ c @ pad_f + pad_f.T @ c @ pad_d) / 2]
    plug = [b @ k @ b for k in q]
    v = y - (n @ y / n.sum() if centering == "mean" else 0)
    bias = np.zeros(3)
    if deletion == "match":
        for u in set(unit):
            at = np.array([k == u for k in unit])
            r = np.sqrt(n[at])[:, None] * x[at]
            left = np.linalg.solve(np.eye(at.sum()) - r @ a @ r.T, np.sqrt(n[at]) * e[at])
            bias += [np.sqrt(n[at]) * v[at] @ (r @ a @ k @ a @ r.T) @ left for k in q]
    else:
        h = np.einsum("ij,jk,ik->i", x, a, x)
        bias += [np.sum(n * v * e * np.einsum("ij,jk,ik->i", x, a @ k @ a, x) / (1 - h)) for k in q]
    join = lambda p: (*p, p[0] + p[1] + 2 * p[2])
    return join(plug), join(bias)
