"""Probabilistic PCA by EM, in the observed-cell form and in the form with missing cells as latent variables.

Both are stateless: a row's posterior is recomputed from its observed cells and the parameters.
"""

from __future__ import annotations

import numpy as np

from ...functions.linalg import leading_eigen
from .engine import Algorithm
from .factors import observed_products


class PPCA(Algorithm):
    name = "PPCA"
    tolerance = 1e-6

    def start(self, ctx, previous=None):
        p = self.options.get("start_loadings")
        p = leading_eigen(ctx.correlation(), ctx.a)[1] if p is None else np.asarray(p, float)
        now = {"p": p, "mu": np.zeros(ctx.v), "s2": self.options.get("start_variance") or ctx.total_variance()}
        return {**now, "rows": now, "bound": None, "n": ctx.n, "n_obs": ctx.n_obs, "s_obs": ctx.s_obs,
                "ss_obs": ctx.ss_obs}

    @staticmethod
    def posterior(params, x):
        """Scores t (n, A), covariances S (n, A, A) and the observed mask."""
        p, s2 = params["p"], params["s2"]
        o = (~np.isnan(x)).astype(float)
        d = np.where(o > 0, x - params["mu"], 0.0)
        w = np.linalg.inv(observed_products(o, p) + s2 * np.eye(p.shape[1]))
        return np.einsum("nab,nb->na", w, d @ p), s2 * w, o

    def stats(self, params, x, z, state):
        t, cov, o = self.posterior(params, x)
        n, a = t.shape
        x0 = np.where(o > 0, x, 0.0)
        tt = (t[:, :, None] * t[:, None, :]).reshape(n, a * a)
        cov = cov.reshape(n, a * a)
        return np.concatenate([(tt + cov).sum(axis=0), (o.T @ t).ravel(), (x0.T @ t).ravel(),
                               (o.T @ tt).ravel(), (o.T @ cov).ravel()])

    def update(self, params, sums, last):
        p_old = params["p"]
        v, a = p_old.shape
        cuts = np.cumsum([a * a, v * a, v * a, v * a * a])
        second, st, sxt, stt, scov = np.split(sums, cuts)
        second, st, sxt = second.reshape(a, a), st.reshape(v, a), sxt.reshape(v, a)
        stt, scov = stt.reshape(v, a, a), scov.reshape(v, a, a)
        n, sx, sxx = params["n_obs"], params["s_obs"], params["ss_obs"]
        mu = (sx - (p_old * st).sum(axis=1)) / n
        right = sxt - mu[:, None] * st
        p = np.einsum("vab,vb->va", np.linalg.inv(stt + scov), right)
        centred = sxx - 2 * mu * sx + n * mu * mu
        cross = (p * right).sum(axis=1)
        s2 = float((centred - 2 * cross + np.einsum("va,vab,vb->v", p, stt + scov, p)).sum() / n.sum())
        bound = -(params["n"] * v / 2 * np.log(s2) + np.trace(second) / 2
                  + np.trace(p.T @ p @ second) / (2 * s2)) - (centred.sum() / 2 - cross.sum()) / s2
        stop = params["bound"] is not None and abs((bound - params["bound"]) / params["bound"]) < self.tolerance
        params.update(rows={k: params[k] for k in ("p", "mu", "s2")}, p=p, mu=mu, s2=s2, bound=bound)
        return {"lower_bound": bound}, stop

    def fill(self, params, x, z, state):
        t = self.posterior(params["rows"], x)[0]
        return t @ params["p"].T + params["mu"]


class PPCAM(PPCA):
    name = "PPCA-M"

    def stats(self, params, x, z, state):
        p, mu, s2 = params["p"], params["mu"], params["s2"]
        t, cov, o = self.posterior(params, x)
        n, a = t.shape
        v = p.shape[0]
        m = 1.0 - o
        full = np.where(o > 0, x, t @ p.T + mu)
        x0 = np.where(o > 0, x, 0.0)
        cov2 = cov.reshape(n, a * a)
        # Expected x t' has an extra covariance term on missing cells only, so it is summed per variable.
        missing_cov = (m.T @ cov2).reshape(v, a, a)
        extra = np.einsum("vab,vb->va", missing_cov, p)
        spread = m.sum(axis=0) * s2 + np.einsum("va,vab,vb->v", p, missing_cov, p)
        xt_missing = (full * m).T @ t + extra
        square_missing = ((full * m) ** 2).sum(axis=0) + spread
        second = (t.T @ t).ravel() + cov2.sum(axis=0)
        return np.concatenate([second, t.sum(axis=0), full.sum(axis=0), (x0.T @ t).ravel(), xt_missing.ravel(),
                               square_missing])

    def update(self, params, sums, last):
        p_old = params["p"]
        v, a = p_old.shape
        n = params["n"]
        second, st, sx, xt_observed, xt_missing, square_missing = np.split(
            sums, np.cumsum([a * a, a, v, v * a, v * a]))
        second = second.reshape(a, a)
        xt_observed, xt_missing = xt_observed.reshape(v, a), xt_missing.reshape(v, a)
        mu = (sx - p_old @ st) / n
        xt = xt_observed + xt_missing
        p = (xt - np.outer(mu, st)) @ np.linalg.inv(second)
        square_observed = params["ss_obs"].sum()
        s2 = float((square_observed + square_missing.sum() - 2 * (xt * p).sum() - 2 * mu @ sx + 2 * mu @ (p @ st)
                    + np.trace(p @ second @ p.T) + n * mu @ mu) / (n * v))
        bound = -(n * v / 2 * np.log(s2) + np.trace(second) / 2 + np.trace(p.T @ p @ second) / (2 * s2)) - (
            square_observed / 2 - (xt_observed * p).sum() - (xt_missing * p).sum() + square_missing.sum() / 2) / s2
        stop = params["bound"] is not None and abs((bound - params["bound"]) / params["bound"]) < self.tolerance
        params.update(rows={k: params[k] for k in ("p", "mu", "s2")}, p=p, mu=mu, s2=s2, bound=bound)
        return {"lower_bound": bound}, stop
