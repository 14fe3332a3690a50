"""Alternating least squares (two forms) and iterated SVD."""

from __future__ import annotations

import numpy as np

from ...functions.draws import uniform_value
from ...functions.linalg import leading_eigen
from .engine import Algorithm, Replayed

PINV_CUTOFF = 1e-12  # eigenvalues of P'P below this share of the largest count as rank loss


def observed_products(o: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P_O'P_O for every row as an (n, A, A) array: one matrix product instead of one per missing pattern."""
    v, a = p.shape
    return (o @ (p[:, :, None] * p[:, None, :]).reshape(v, a * a)).reshape(-1, a, a)


class Alternating(Algorithm):
    """Rows by least squares on their observed cells, then mean and loading of each variable by least squares on its
    observed cells."""

    name = "Alternating"
    tolerance = 1e-6
    centred = True

    def first_loadings(self, ctx):
        return leading_eigen(ctx.g_obs / (ctx.n - 1), ctx.a)[1]

    def start(self, ctx, previous=None):
        p = self.options.get("start_loadings")
        p = self.first_loadings(ctx) if p is None else np.asarray(p, float)
        return {"p": p, "mu": np.zeros(ctx.v), "p_rows": p, "mu_rows": np.zeros(ctx.v), "sse": None,
                "n_obs": ctx.n_obs, "s_obs": ctx.s_obs, "ss_obs": ctx.ss_obs}

    @staticmethod
    def row_scores(p, mu, x):
        o = (~np.isnan(x)).astype(float)
        d = np.where(o > 0, x - mu, 0.0)
        inverse = np.linalg.pinv(observed_products(o, p), rcond=PINV_CUTOFF, hermitian=True)
        return np.einsum("nab,nb->na", inverse, d @ p), o

    def stats(self, params, x, z, state):
        t, o = self.row_scores(params["p"], params["mu"], x)
        a = t.shape[1]
        x0 = np.where(o > 0, x, 0.0)
        tt = (t[:, :, None] * t[:, None, :]).reshape(len(t), a * a)
        return np.concatenate([(o.T @ t).ravel(), (x0.T @ t).ravel(), (o.T @ tt).ravel()])

    def update(self, params, sums, last):
        p_old = params["p"]
        v, a = p_old.shape
        st, sxt = sums[:v * a].reshape(v, a), sums[v * a:2 * v * a].reshape(v, a)
        stt = sums[2 * v * a:].reshape(v, a, a)
        n, sx, sxx = params["n_obs"], params["s_obs"], params["ss_obs"]
        mu = (sx - (p_old * st).sum(axis=1)) / n if self.centred else np.zeros(v)
        right = sxt - mu[:, None] * st
        p = np.einsum("vab,vb->va", np.linalg.pinv(stt, rcond=PINV_CUTOFF, hermitian=True), right)
        sse = float((sxx - 2 * mu * sx + n * mu * mu - 2 * (p * right).sum(axis=1)
                     + np.einsum("va,vab,vb->v", p, stt, p)).sum())
        stop = params["sse"] is not None and abs((sse - params["sse"]) / params["sse"]) < self.tolerance
        params.update(p_rows=p_old, mu_rows=params["mu"], p=p, mu=mu, sse=sse)
        return {"sse_obs": sse}, stop

    def fill(self, params, x, z, state):
        t, _ = self.row_scores(params["p_rows"], params["mu_rows"], x)
        return t @ params["p"].T + params["mu"]


class ALS(Alternating):
    """The uncentred factorisation from a seeded random start; `fill_als` compares several."""

    name = "ALS"
    centred = False

    def first_loadings(self, ctx):
        draws = np.array([[uniform_value(ctx.seed, "als", ctx.candidate, j, k) for k in range(ctx.a)] for j in range(ctx.v)])
        return np.linalg.qr(draws - 0.5)[0]


class SVDImpute(Replayed):
    """Replace missing cells by their rank-A reconstruction until the observed error settles."""

    name = "SVDImpute"
    needs_filled = True
    n_state = 1
    tolerance = 1e-6

    def start(self, ctx, previous=None):
        step = leading_eigen(ctx.g / (ctx.n - 1), ctx.a)[1]
        params = {"n": ctx.n, "cells": ctx.n_obs.sum(), "a": ctx.a, "mse": 0.0, "history": [], "step": step}
        if previous is not None:  # warm start: continue from the filled table of the last round
            params["history"] = [*previous["history"], previous["step"]]
        return params

    def initial(self, params, x, z):
        return [z]

    def advance(self, params, step, x, state):
        return [np.where(np.isnan(x), state[0] @ step @ step.T, x)]

    def stats(self, params, x, z, state):
        s = self.current(params, x, z, state)[0]
        estimate = s @ params["step"] @ params["step"].T
        missing = np.isnan(x)
        new = np.where(missing, estimate, x)
        return np.append((new.T @ new).ravel(), np.where(missing, 0.0, (s - estimate) ** 2).sum())

    def update(self, params, sums, last):
        mse = sums[-1] / params["cells"]
        stop = mse == 0 or abs((mse - params["mse"]) / mse) < self.tolerance
        params["mse"] = mse
        if not (stop or last):
            v = params["step"].shape[0]
            self.commit(params, leading_eigen(sums[:-1].reshape(v, v) / (params["n"] - 1), params["a"])[1])
        return {"mse_obs": mse}, stop

    def fill(self, params, x, z, state):
        return self.advance(params, params["step"], x, self.current(params, x, z, state))[0]
