"""Low-rank completion: singular value thresholding and the inexact augmented Lagrangian."""

from __future__ import annotations

import numpy as np

from ...functions.linalg import shrink_operator
from .engine import Replayed


class SVT(Replayed):
    """Z grows on observed cells until its soft-thresholded form matches them."""

    name = "SVT"
    uses_components = False
    n_state = 1
    tolerance = 1e-4

    def start(self, ctx, previous=None):
        tau = self.options.get("tau")
        tau = 5.0 * ctx.n if tau is None else float(tau)
        norm = float(np.sqrt(ctx.ss_obs.sum()))
        delta = 1.2 * ctx.n * ctx.v / ctx.n_obs.sum()
        first = np.ceil(tau / delta / norm) * delta
        return {"tau": tau, "delta": delta, "norm": norm, "first": first, "history": [],
                "step": shrink_operator(first * first * ctx.g_obs, tau)}

    def initial(self, params, x, z):
        return [params["first"] * np.nan_to_num(x, nan=0.0)]

    def advance(self, params, step, x, state):
        return [state[0] + params["delta"] * np.nan_to_num(x - state[0] @ step, nan=0.0)]

    def stats(self, params, x, z, state):
        s = self.current(params, x, z, state)
        error = np.nan_to_num(x - s[0] @ params["step"], nan=0.0)
        new = s[0] + params["delta"] * error
        return np.append((new.T @ new).ravel(), (error * error).sum())

    def update(self, params, sums, last):
        ratio = float(np.sqrt(sums[-1]) / params["norm"])
        stop = ratio <= self.tolerance
        if not (stop or last):
            v = params["step"].shape[0]
            self.commit(params, shrink_operator(sums[:-1].reshape(v, v), params["tau"]))
        return {"relative_error": ratio}, stop

    def fill(self, params, x, z, state):
        return self.current(params, x, z, state)[0] @ params["step"]


class ALM(Replayed):
    """D = A + E with A of low rank and E on the missing cells; multiplier Y and growing penalty."""

    name = "ALM"
    uses_components = False
    n_state = 2
    tolerance_fit, tolerance_change = 1e-7, 1e-6

    def start(self, ctx, previous=None):
        norm = float(np.sqrt(ctx.ss_obs.sum()))
        mu = 1.0 / norm
        missing_share = 1.0 - ctx.n_obs.sum() / (ctx.n * ctx.v)
        return {"norm": norm, "rho": 1.2172 + 1.8588 * (1.0 - missing_share), "history": [], "first": True,
                "step": (shrink_operator(ctx.g_obs, 1.0 / mu), mu)}

    def initial(self, params, x, z):
        return [np.zeros_like(x), np.zeros_like(x)]

    @staticmethod
    def parts(step, x, state):
        b, mu = step
        e, y = state
        m = np.isnan(x)
        d = np.where(m, 0.0, x)
        low = (d - e + y / mu) @ b
        e_new = np.where(m, d - low + y / mu, 0.0)
        gap = d - low - e_new
        return d, low, e_new, y + mu * gap, gap

    def advance(self, params, step, x, state):
        _, _, e, y, _ = self.parts(step, x, state)
        return [e, y]

    def stats(self, params, x, z, state):
        old = self.current(params, x, z, state)
        d, _, e, y, gap = self.parts(params["step"], x, old)
        c = d - e
        return np.concatenate([(c.T @ c).ravel(), (c.T @ y).ravel(), (y.T @ y).ravel(),
                               [(gap * gap).sum(), ((e - old[0]) ** 2).sum()]])

    def update(self, params, sums, last):
        b, mu = params["step"]
        v = b.shape[0]
        cc, cy, yy = (sums[i * v * v:(i + 1) * v * v].reshape(v, v) for i in range(3))
        gap, change = np.sqrt(sums[-2:]) / params["norm"]
        mu_new = mu * params["rho"] if min(mu, np.sqrt(mu)) * change < self.tolerance_change else mu
        change_new = min(mu_new, np.sqrt(mu_new)) * change
        stop = not params["first"] and gap < self.tolerance_fit and change_new < self.tolerance_change
        params["first"] = False
        if not (stop or last):
            gram = cc + (cy + cy.T) / mu_new + yy / (mu_new * mu_new)
            self.commit(params, (shrink_operator(gram, 1.0 / mu_new), mu_new))
        return {"ratio1": gap, "ratio2": change_new}, bool(stop)

    def fill(self, params, x, z, state):
        return self.parts(params["step"], x, self.current(params, x, z, state))[1]
