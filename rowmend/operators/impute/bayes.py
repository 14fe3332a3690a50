"""Bayesian PCA by variational inference with a relevance prior per component."""

from __future__ import annotations

import numpy as np

from ...functions.linalg import leading_eigen
from .engine import Algorithm
from .factors import observed_products

# Fixed values of the prior.
GAMMA_ALPHA, BETA_ALPHA = 1e-10, 1.0
GAMMA_TAU, BETA_TAU = 1e-10, 1.0
GAMMA_MU = 0.001
TAU_MIN, TAU_MAX = 1e-10, 1e10
FIRST_TAU = 1000.0


class BPCA(Algorithm):
    """Rows without any observed cell take no part in the fit and stay missing."""

    name = "BPCA"
    tolerance = 1e-6

    def start(self, ctx, previous=None):
        mean = ctx.s / ctx.n
        cov = (ctx.g - ctx.n * np.outer(mean, mean)) / (ctx.n - 1)
        lam, vec = leading_eigen(cov, ctx.a)
        w = self.options.get("start_loadings")
        w = vec * np.sqrt(lam) if w is None else np.asarray(w, float)
        rest = np.trace(cov) - lam.sum()
        tau = self.options.get("start_precision") or float(np.clip(1.0 / max(rest, 1.0 / TAU_MAX), TAU_MIN, TAU_MAX))
        now = {"w": w, "tau": tau, "sig_w": np.eye(ctx.a)}
        return {**now, "rows": now, "mu": ctx.s_obs / ctx.n_obs, "tau_old": FIRST_TAU, "first": True,
                "alpha": (2 * GAMMA_ALPHA + ctx.v) / (tau * (w * w).sum(axis=0) + 2 * GAMMA_ALPHA / BETA_ALPHA)}

    @staticmethod
    def posterior(params, mu, x):
        w, tau = params["w"], params["tau"]
        o = (~np.isnan(x)).astype(float)
        d = np.where(o > 0, x - mu, 0.0)
        r = np.linalg.inv(observed_products(o, w) * tau + np.eye(w.shape[1]) + params["sig_w"])
        y = tau * np.einsum("nab,nb->na", r, d @ w)
        return y, r, np.where(o > 0, d, y @ w.T), o

    def stats(self, params, x, z, state):
        x = x[~np.isnan(x).all(axis=1)]
        w, tau = params["w"], params["tau"]
        y, r, d, o = self.posterior(params, params["mu"], x)
        v, a = w.shape
        m = 1.0 - o
        missing_r = (m.T @ r.reshape(len(x), a * a)).reshape(v, a, a)
        t = d.T @ y + np.einsum("vab,vb->va", missing_r, w)
        spread = (d * d).sum() + m.sum() / tau + np.einsum("va,vab,vb->", w, missing_r, w)
        return np.concatenate([t.ravel(), [spread, len(x)]])

    def update(self, params, sums, last):
        w, tau, sig_w, alpha, mu = (params[k] for k in ("w", "tau", "sig_w", "alpha", "mu"))
        v, a = w.shape
        n = sums[-1]
        t, spread = sums[:-2].reshape(v, a) / n, sums[-2] / n
        rx_inv = np.linalg.inv(np.eye(a) + tau * w.T @ w + sig_w)
        dw_inv = np.linalg.inv(rx_inv + tau * t.T @ w @ rx_inv + np.diag(alpha) / n)
        w_new = t @ dw_inv
        tau_new = float((v + 2 * GAMMA_TAU / n) / (
            spread - np.trace(t.T @ w_new) + (GAMMA_MU * mu @ mu + 2 * GAMMA_TAU / BETA_TAU) / n))
        sig_new = dw_inv * (v / n)
        alpha_new = (2 * GAMMA_ALPHA + v) / (
            tau_new * (w_new * w_new).sum(axis=0) + np.diag(sig_new) + 2 * GAMMA_ALPHA / BETA_ALPHA)
        change = abs(np.log10(tau_new) - np.log10(params["tau_old"]))
        stop = not params["first"] and change < self.tolerance
        params.update(rows={"w": w, "tau": tau, "sig_w": sig_w}, w=w_new, tau=tau_new, sig_w=sig_new,
                      alpha=alpha_new, tau_old=tau_new, first=False)
        return {"dtau": change}, stop

    def fill(self, params, x, z, state):
        _, _, d, _ = self.posterior(params["rows"], params["mu"], x)
        out = d + params["mu"]
        out[np.isnan(x).all(axis=1)] = np.nan
        return out
