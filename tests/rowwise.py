"""Row-by-row numpy computation of models and indicators, written from the
formulas with explicit matrices; shares no code with the library."""

from __future__ import annotations

import numpy as np


def design(df, spec):
    cols, names = [np.ones(len(df))], ["(Intercept)"]
    dummies = {}
    for m in spec.main:
        seen = [v for v in m.values if (df[m.name] == v).any()]
        for v in seen[1:]:
            dummies[m.name, v] = (df[m.name] == v).to_numpy(float)
            cols.append(dummies[m.name, v])
            names.append(f"{m.name}[{v}]")
    for n in spec.numeric:
        cols.append(df[n].to_numpy(float))
        names.append(n)
    for a, b in spec.interactions:
        for (x, u), du in dummies.items():
            for (y, v), dv in dummies.items():
                if x == a and y == b:
                    cols.append(du * dv)
                    names.append(f"{a}[{u}]:{b}[{v}]")
    return np.column_stack(cols), names


def logit(x, y, w):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(x @ beta)))
        info = x.T @ (x * (w * mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, x.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-(x @ beta)))
    return beta, np.linalg.inv(x.T @ (x * (w * mu * (1 - mu))[:, None]))


def gauss(x, y, w):
    cross = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = cross @ x.T @ (w * y)
    s2 = np.sum(w * (y - x @ beta) ** 2) / (len(y) - x.shape[1])
    return beta, cross * s2


class Design:
    def __init__(self, w, strata):
        self.w, self.strata = w, strata
        flat = all(np.ptp(w[strata == s]) == 0 for s in np.unique(strata))
        self.kind = "PPS" if not flat else ("SI" if len(np.unique(strata)) == 1 else "STSI")

    def var_total(self, y):
        if self.kind == "PPS":
            n, t = len(y), y * self.w
            return np.sum((n * t - t.sum()) ** 2) / n / (n - 1)
        out = 0.0
        for s in np.unique(self.strata):
            k = self.strata == s
            big, n = self.w[k].sum(), k.sum()
            out += big**2 * (1 - n / big) * np.var(y[k], ddof=1) / n
        return out


def cov_ml(a, w):
    c = a - np.average(a, axis=0, weights=w)
    return c.T @ (c * w[:, None]) / w.sum()


def indicator(df, spec, y, w, strata, family="binomial"):
    x, _ = design(df, spec)
    d = Design(w, strata)
    fit = logit if family == "binomial" else gauss
    beta, sigma = fit(x, y, w / w.mean())
    eta = x @ beta
    p = 1 / (1 + np.exp(-eta)) if family == "binomial" else eta
    g = p * (1 - p) if family == "binomial" else np.ones(len(p))
    z = x * g[:, None]
    pop, n = w.sum(), len(w)
    mean = np.average(p, weights=w)
    s2 = np.sum(w * (p - mean) ** 2) / (pop - 1)
    s2_ml = np.sum(w * (p - mean) ** 2) / pop
    bias = (np.sum(w * np.einsum("ij,jk,ik->i", z, sigma, z)) - d.var_total(p) / pop) / pop
    cov = cov_ml(np.column_stack([p, z]), w)
    a, b = cov[1:, 0], cov[1:, 1:]
    var = (4 * a @ sigma @ a + 2 * np.trace(b @ sigma @ b @ sigma)
           + d.var_total((p - mean) ** 2) / pop**2) / s2_ml
    f = 0.0 if bias > s2 else 1 - bias / s2
    cv = np.sqrt(s2 * f) / mean
    out = {
        "prop_mean": mean, "r": 1 - 2 * np.sqrt(s2 * f), "r_unadj": 1 - 2 * np.sqrt(s2),
        "r_se": np.sqrt(var), "bias_factor": f, "cv": cv, "cv_unadj": np.sqrt(s2) / mean,
        "cv_se": np.sqrt(0.25 * var / mean**2 + cv**4 / n), "design": d.kind,
    }
    return out, p, z, sigma, d


def partials(df, spec, y, w, strata, variables, one_factor, family="binomial"):
    """{variable: ({by variable}, {category: {...}})}; one_factor(variable) gives its spec."""
    base, p, z, sigma, d = indicator(df, spec, y, w, strata, family)
    pop, mean, f = w.sum(), base["prop_mean"], base["bias_factor"]
    result = {}
    for v in variables:
        cats, by_cat = df[v].to_numpy(), {}
        others = [o for o in spec.covariates if o != v]
        key = df[others].astype(str).agg("~".join, axis=1).to_numpy() if others else np.zeros(len(df))
        p0, z0 = np.zeros(len(p)), np.zeros(z.shape)
        for o in np.unique(key):
            k = key == o
            p0[k] = np.average(p[k], weights=w[k])
            z0[k] = np.average(z[k], axis=0, weights=w[k])
        dp, dz = p - p0, z - z0
        pu2 = pc2 = 0.0
        for c in np.unique(cats):
            k = (cats == c).astype(float)
            nk = np.sum(w * k)
            pk = np.sum(w * k * p) / nk
            part = nk * (pk - mean) ** 2 / pop
            pu2 += part
            v1, v2 = d.var_total(k * p), d.var_total((1 - k) * p)
            cond = np.sum(w * k * dp**2) / pop
            pc2 += cond
            a = (dp * k * w) @ dz
            b = dz.T @ (dz * (k * w)[:, None])
            top = 4 * a @ sigma @ a + 2 * np.trace(b @ sigma @ b @ sigma) + d.var_total(dp**2 * k)
            by_cat[c] = {
                "pu_unadj": np.sign(pk - mean) * np.sqrt(part),
                "pu_unadj_se": np.sqrt(nk / pop * (v1 * (1 / nk - 1 / pop) ** 2 + v2 / pop**2)),
                "pc_unadj": np.sqrt(cond),
                "pc_unadj_se": np.sqrt(0.25 * top / (pop * np.sum(w * k * dp**2))),
            }
        alone, *_ = indicator(df, one_factor(v), y, w, strata, family)
        result[v] = ({
            "pu": np.sqrt(pu2 * f), "pu_unadj": np.sqrt(pu2), "pu_se": 0.5 * alone["r_se"],
            "pc": np.sqrt(pc2 * f), "pc_unadj": np.sqrt(pc2),
        }, by_cat)
    return base, result


def draft(ids, rank_a, rank_b, start="aa"):
    """Greedy alternating picks, straight from the rule."""
    left, out = set(ids), []
    for i in range(1, max(1, len(ids) // 2) + 1):
        use_a = (i == 1 or i % 2 == 0) if start == "aa" else i % 2 == 1
        rank = rank_a if use_a else rank_b
        best = min(left, key=lambda c: rank[c])
        left.remove(best)
        out.append(best)
    return set(out)
