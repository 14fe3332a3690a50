"""SQL for DuckDB that iterates to the end: recursive queries whose body is one iteration (or one round) of an operator.

The parameters of a fit, or the flags of an outlier search, are the rows of the recursive table; its body recomputes everything
else from the observed cells.  Fits are written for up to two components: with one, the second loading is zero and stays zero.
The loop over the number of components is unrolled for two rounds; were a table to need more, the result would be empty.
"""

from __future__ import annotations

from .oracles import BOUNDS, FLAG_LIM, NB_OM, OM, PROTECTED, V, each, eig, interpolated, lit, long, masked, norm_ppf, rnd, spiked, u, with_

N = len(V)
TOLERANCE = 1e-6
START_COMPONENTS = 2
COPIES = 50


def body(ctes: list[str], select: str) -> str:
    return "(WITH " + ",\n".join(ctes) + "\n" + select + ")"


# -- number of components ---------------------------------------------------------------------------------------------

FOLDS = ("fold AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT row_id, floor({u(lit(0), lit(r // 4), 'row_id', slot=r % 4)} * 5)::INT + {r * 5} AS f FROM om" for r in range(10)) + ")")


def choice(src: str, tag: str, k: int = 5) -> list[str]:
    """`<tag>a`(a): the one-standard-error choice from repeated cross-validation of src(row_id, i, x), by sums over folds."""
    t = tag
    mean = "(g.si / g.n)"
    return [
        f"{t}z AS MATERIALIZED (SELECT row_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM {src})",
        f"{t}fm AS MATERIALIZED (SELECT f, a.i, b.i AS j, sum(a.z * b.z) AS g, sum(a.z) AS si, sum(b.z) AS sj, count(*) AS n FROM {t}z a "
        f"JOIN {t}z b USING (row_id) JOIN fold USING (row_id) GROUP BY f, a.i, b.i)",
        f"{t}tr AS MATERIALIZED (SELECT f, i, j, sum(g) OVER w - g AS g, sum(si) OVER w - si AS si, sum(sj) OVER w - sj AS sj, sum(n) OVER w - n AS n "
        f"FROM {t}fm WINDOW w AS (PARTITION BY f // 5, i, j))",
        f"{t}sd AS MATERIALIZED (SELECT f, i, {mean} AS m, sqrt((g - n * {mean} * {mean}) / (n - 1)) AS sd, n FROM {t}tr g WHERE i = j)",
        f"{t}fc AS MATERIALIZED (SELECT g.f, g.i, g.j, (g.g - g.n * x.m * y.m) / ((g.n - 1) * x.sd * y.sd) AS v FROM {t}tr g "
        f"JOIN {t}sd x ON x.f = g.f AND x.i = g.i JOIN {t}sd y ON y.f = g.f AND y.i = g.j)",
        f"{t}te AS MATERIALIZED (SELECT g.f, g.i, g.j, (g.g - x.m * g.sj - y.m * g.si + g.n * x.m * y.m) / (x.sd * y.sd) AS v FROM {t}fm g "
        f"JOIN {t}sd x ON x.f = g.f AND x.i = g.i JOIN {t}sd y ON y.f = g.f AND y.i = g.j)",
        *eig(f"{t}fc", k, f"{t}e", "f"),
        f"{t}rm AS MATERIALIZED (SELECT x.f, c.a, x.i, y.i AS j, (x.i = y.i)::INT - sum(x.p * y.p) AS r FROM {t}e x JOIN {t}e y USING (f, a) "
        f"JOIN (SELECT unnest(range(1, {k + 1})) AS a) c ON x.a <= c.a GROUP BY x.f, c.a, x.i, y.i)",
        f"{t}rt AS MATERIALIZED (SELECT m.f, m.a, e.j AS l, m.j, sum(m.r * e.v) AS v FROM {t}rm m JOIN {t}te e ON e.f = m.f AND e.i = m.i GROUP BY m.f, m.a, e.j, m.j)",
        f"{t}pr AS MATERIALIZED (SELECT b.f, b.a, sum(b.v * m.r / (d.r * d.r)) / {N} AS press FROM {t}rt b JOIN {t}rm m ON m.f = b.f AND m.a = b.a AND m.i = b.l "
        f"AND m.j = b.j JOIN {t}rm d ON d.f = b.f AND d.a = b.a AND d.i = b.j AND d.j = b.j GROUP BY b.f, b.a)",
        f"{t}all AS (SELECT * FROM {t}pr UNION ALL SELECT f, {k + 1}, press FROM {t}pr WHERE a = {k})",
        f"{t}ov AS (SELECT f, a, press, press > avg(press) OVER (PARTITION BY a) + {norm_ppf(0.999)!r} * stddev_pop(press) OVER (PARTITION BY a) AS o FROM {t}all)",
        f"{t}us AS (SELECT a, press FROM (SELECT *, bool_and(o) OVER (PARTITION BY f) AS gone FROM {t}ov) WHERE NOT gone)",
        f"{t}pa AS (SELECT a, avg(press) AS m, stddev_samp(press) / sqrt(count(*)) AS se FROM {t}us GROUP BY a)",
        f"{t}a AS MATERIALIZED (SELECT min(a)::INT AS a FROM {t}pa WHERE m < (SELECT min_by(m + se, m) FROM {t}pa) OR m = (SELECT min(m) FROM {t}pa))"]


# -- fits -------------------------------------------------------------------------------------------------------------

def start(prefill: str) -> list[str]:
    """raw, xs(row_id, i, x) scaled observed cells, f0(row_id, i, x) the scaled prefilled table, st(i, mu, sd), n1(n)."""
    if prefill == "mean":
        table = "pre AS MATERIALIZED (SELECT row_id, i, coalesce(x, avg(x) OVER (PARTITION BY i)) AS x FROM raw)"
        extra = []
    else:
        extra = [NB_OM, "pw AS MATERIALIZED (SELECT row_id, " + ", ".join(f"{interpolated(v)} AS {v}" for v in V) + " FROM nb)"]
        table = long("pw", "pre")
    return [OM, masked(), long("m", "raw"), *extra, table, FOLDS,
            "n1 AS MATERIALIZED (SELECT count(*) AS n FROM om)",
            "st AS MATERIALIZED (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM pre GROUP BY i)",
            "xs AS MATERIALIZED (SELECT row_id, i, (x - mu) / sd AS x FROM raw JOIN st USING (i))",
            "f0 AS MATERIALIZED (SELECT row_id, i, (x - mu) / sd AS x FROM pre JOIN st USING (i))"]


def gram_of(src: str, name: str, kind: str) -> str:
    """<name>(i, j, v): sums of products, 'cov' or 'cor' of src(row_id, i, x); nulls count as zero."""
    value = "sum(coalesce(a.x, 0) * coalesce(b.x, 0))"
    forms = {"gram": value, "cov": f"({value} - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1)", "cor": "corr(a.x, b.x)"}
    return f"{name} AS MATERIALIZED (SELECT a.i, b.i AS j, {forms[kind]} AS v FROM {src} a JOIN {src} b USING (row_id) GROUP BY a.i, b.i)"


def pair(source: str, name: str, comps: str, scale: str = "1") -> str:
    """<name>(i, p1, p2): leading vectors of the eigenpairs `source`, the second zero if `comps` is 1."""
    return (f"{name} AS MATERIALIZED (SELECT i, max(CASE WHEN a = 1 THEN p * {scale} END) AS p1, "
            f"max(CASE WHEN a = 2 THEN CASE WHEN {comps} >= 2 THEN p * {scale} ELSE 0 END END) AS p2 FROM {source} GROUP BY i)")


# sums over the observed cells of a variable, of scores t1, t2 and, for the EM fits, their covariance c11, c12, c22
PER_VARIABLE = ("count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(t1) AS st1, sum(t2) AS st2, sum(x * t1) AS sxt1, sum(x * t2) AS sxt2, "
                "sum(t1 * t1 + c11) AS s11, sum(t1 * t2 + c12) AS s12, sum(t2 * t2 + c22) AS s22")
OBSERVED = "CASE WHEN x IS NOT NULL THEN {} ELSE 0 END"


def row_sums(extra: str = "") -> str:
    """Per row: products of the loadings of its observed cells and their sums with the cells."""
    parts = {"w11": "p1 * p1", "w12": "p1 * p2", "w22": "p2 * p2", "b1": "p1 * (x - mu)", "b2": "p2 * (x - mu)"}
    return "rs AS MATERIALIZED (SELECT row_id, " + ", ".join(f"sum({OBSERVED.format(e)}) AS {n}" for n, e in parts.items()) + f"{extra} FROM xs JOIN cur USING (i) GROUP BY row_id)"


def alternating(tag: str, comps: str, previous: str) -> list[str]:
    solve = ("CASE WHEN s11 * s22 - s12 * s12 > 1e-12 * (s11 + s22) * (s11 + s22) THEN ({x} * {d} - {y} * s12) / (s11 * s22 - s12 * s12) "
             "WHEN s11 + s22 > 0 THEN ({x} * {o} + {y} * s12) / ((s11 + s22) * (s11 + s22)) ELSE 0 END")
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < 1000)", row_sums(),
             "ts AS MATERIALIZED (SELECT row_id, " + ", ".join(
                 f"{solve.format(x=x, y=y, d=d, o=o)} AS {n}" for n, x, y, d, o in (("t1", "b1", "b2", "s22", "s11"), ("t2", "b2", "b1", "s11", "s22")))
             + ", 0.0 AS c11, 0.0 AS c12, 0.0 AS c22 FROM (SELECT row_id, w11 AS s11, w12 AS s12, w22 AS s22, b1, b2 FROM rs))",
             f"vs AS MATERIALIZED (SELECT i, {PER_VARIABLE} FROM xs JOIN ts USING (row_id) WHERE x IS NOT NULL GROUP BY i)",
             "ms AS (SELECT vs.*, cur.k, cur.p1, cur.p2, cur.mu AS mu0, cur.sse AS sse0, (sx - p1 * st1 - p2 * st2) / n AS mu FROM vs JOIN cur USING (i))",
             "rr AS (SELECT *, sxt1 - mu * st1 AS r1, sxt2 - mu * st2 AS r2 FROM ms)",
             "ps AS MATERIALIZED (SELECT *, " + solve.format(x="r1", y="r2", d="s22", o="s11") + " AS n1, " + solve.format(x="r2", y="r1", d="s11", o="s22") + " AS n2 FROM rr)",
             "se AS (SELECT sum(sxx - 2 * mu * sx + n * mu * mu - 2 * (n1 * r1 + n2 * r2) + n1 * n1 * s11 + 2 * n1 * n2 * s12 + n2 * n2 * s22) AS sse FROM ps)"]
    step = (f"SELECT k + 1, i, n1, n2, ps.mu, p1, p2, mu0, se.sse, coalesce(abs((se.sse - sse0) / sse0) < {TOLERANCE}, false) FROM ps CROSS JOIN se")
    fill = ("SELECT xs.row_id, xs.i, coalesce(xs.x, t1 * f.p1 + t2 * f.p2 + f.mu) AS x FROM xs JOIN {t} USING (row_id) JOIN {f} f USING (i)")
    last = f"{tag}f"
    again = [f"cur AS (SELECT i, q1 AS p1, q2 AS p2, qmu AS mu FROM {last})", row_sums(), inner[2]]
    return [gram_of("(SELECT row_id, i, x FROM xs)", f"{tag}g", "gram"), *eig(f"{tag}g", 2, f"{tag}e"), pair(f"{tag}e", f"{tag}p", comps),
            f"{tag}(k, i, p1, p2, mu, q1, q2, qmu, sse, done) AS (SELECT 0, i, p1, p2, 0.0::DOUBLE, p1, p2, 0.0::DOUBLE, NULL::DOUBLE, false FROM {tag}p UNION ALL {body(inner, step)})",
            f"{last} AS MATERIALIZED (SELECT * FROM {tag} WHERE done)",
            f"{tag}fill AS MATERIALIZED {body(again, fill.format(t='ts', f=last))}"]


POSTERIOR = ("ts AS MATERIALIZED (SELECT row_id, (b1 * w22 - b2 * w12) / det AS t1, (b2 * w11 - b1 * w12) / det AS t2, s2 * w22 / det AS c11, "
             "-s2 * w12 / det AS c12, s2 * w11 / det AS c22 FROM (SELECT *, w11 * w22 - w12 * w12 AS det FROM (SELECT row_id, w11 + s2 AS w11, w12, "
             "w22 + s2 AS w22, b1, b2, s2 FROM rs)))")


def em(tag: str, comps: str, previous: str, latent: bool) -> list[str]:
    """PPCA, or with `latent` the form that treats missing cells as latent variables."""
    second = ("sd AS (SELECT sum(t1 * t1 + c11) AS a11, sum(t1 * t2 + c12) AS a12, sum(t2 * t2 + c22) AS a22, sum(t1) AS a1, sum(t2) AS a2, count(*) AS rows FROM ts)")
    trace = f"(a11 + CASE WHEN {comps} >= 2 THEN a22 ELSE 0 END)"
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < 1000)", row_sums(", any_value(s2) AS s2"), POSTERIOR, second]
    solve = "({x} * {d} - {y} * s12) / (s11 * s22 - s12 * s12)"
    if not latent:
        inner += [f"vs AS MATERIALIZED (SELECT i, {PER_VARIABLE} FROM xs JOIN ts USING (row_id) WHERE x IS NOT NULL GROUP BY i)",
                  "ms AS (SELECT vs.*, cur.k, cur.p1, cur.p2, cur.mu AS mu0, cur.s2, cur.bound, (sx - p1 * st1 - p2 * st2) / n AS mu FROM vs JOIN cur USING (i))",
                  "rr AS (SELECT *, sxt1 - mu * st1 AS r1, sxt2 - mu * st2 AS r2 FROM ms)",
                  f"ps AS MATERIALIZED (SELECT *, {solve.format(x='r1', y='r2', d='s22')} AS n1, {solve.format(x='r2', y='r1', d='s11')} AS n2 FROM rr)",
                  "tot AS (SELECT sum(sxx - 2 * mu * sx + n * mu * mu) AS centred, sum(n1 * r1 + n2 * r2) AS cr, "
                  "sum(sxx - 2 * mu * sx + n * mu * mu - 2 * (n1 * r1 + n2 * r2) + n1 * n1 * s11 + 2 * n1 * n2 * s12 + n2 * n2 * s22) / sum(n) AS v2 FROM ps)"]
        rest = "(centred / 2 - cr) / v2"
    else:
        inner += ["cc AS MATERIALIZED (SELECT row_id, i, x IS NULL AS gone, p1, p2, mu, s2, t1, t2, c11, c12, c22, coalesce(x, t1 * p1 + t2 * p2 + mu) AS y FROM xs "
                  "JOIN ts USING (row_id) JOIN cur USING (i))",
                  "vs AS MATERIALIZED (SELECT i, sum(y) AS sx, sum(y * t1 + CASE WHEN gone THEN c11 * p1 + c12 * p2 ELSE 0 END) AS xt1, "
                  "sum(y * t2 + CASE WHEN gone THEN c12 * p1 + c22 * p2 ELSE 0 END) AS xt2, sum(y * y + CASE WHEN gone THEN s2 + p1 * p1 * c11 + 2 * p1 * p2 * c12 "
                  "+ p2 * p2 * c22 ELSE 0 END) AS sq FROM cc GROUP BY i)",
                  "ms AS (SELECT vs.*, cur.k, cur.p1, cur.p2, cur.mu AS mu0, cur.s2, cur.bound, a1, a2, a11 AS s11, a12 AS s12, a22 AS s22, rows, "
                  "(sx - p1 * a1 - p2 * a2) / rows AS mu FROM vs JOIN cur USING (i) CROSS JOIN sd)",
                  "rr AS (SELECT *, xt1 - mu * a1 AS r1, xt2 - mu * a2 AS r2 FROM ms)",
                  f"ps AS MATERIALIZED (SELECT *, {solve.format(x='r1', y='r2', d='s22')} AS n1, {solve.format(x='r2', y='r1', d='s11')} AS n2 FROM rr)",
                  "tot AS (SELECT sum(sq) / 2 - sum(xt1 * n1 + xt2 * n2) AS half, sum(sq - 2 * (xt1 * n1 + xt2 * n2) - 2 * mu * sx + 2 * mu * (n1 * a1 + n2 * a2) "
                  f"+ n1 * n1 * s11 + 2 * n1 * n2 * s12 + n2 * n2 * s22 + rows * mu * mu) / (any_value(rows) * {N}) AS v2 FROM ps)"]
        rest = "half / v2"
    inner.append("bd AS (SELECT v2, -(rows * " + str(N) + f" / 2.0 * ln(v2) + {trace} / 2 + (pp11 * a11 + 2 * pp12 * a12 + pp22 * a22) / (2 * v2)) - {rest} AS nb "
                 "FROM tot CROSS JOIN sd CROSS JOIN (SELECT sum(n1 * n1) AS pp11, sum(n1 * n2) AS pp12, sum(n2 * n2) AS pp22 FROM ps))")
    step = f"SELECT k + 1, i, n1, n2, ps.mu, v2, p1, p2, mu0, s2, nb, coalesce(abs((nb - bound) / bound) < {TOLERANCE}, false) FROM ps CROSS JOIN bd"
    last = f"{tag}f"
    again = [f"cur AS (SELECT i, q1 AS p1, q2 AS p2, qmu AS mu, qs AS s2 FROM {last})", row_sums(", any_value(s2) AS s2"), POSTERIOR]
    fill = f"SELECT xs.row_id, xs.i, coalesce(xs.x, t1 * f.p1 + t2 * f.p2 + f.mu) AS x FROM xs JOIN ts USING (row_id) JOIN {last} f USING (i)"
    return [gram_of(previous, f"{tag}g", "cor"), *eig(f"{tag}g", 2, f"{tag}e"), pair(f"{tag}e", f"{tag}p", comps),
            f"{tag}v AS (SELECT var_pop(x) AS s2 FROM {previous})",
            f"{tag}(k, i, p1, p2, mu, s2, q1, q2, qmu, qs, bound, done) AS (SELECT 0, i, p1, p2, 0.0::DOUBLE, s2, p1, p2, 0.0::DOUBLE, s2, NULL::DOUBLE, false "
            f"FROM {tag}p CROSS JOIN {tag}v UNION ALL {body(inner, step)})",
            f"{last} AS MATERIALIZED (SELECT * FROM {tag} WHERE done)", f"{tag}fill AS MATERIALIZED {body(again, fill)}"]


def ppca(tag, comps, previous):
    return em(tag, comps, previous, False)


def ppcam(tag, comps, previous):
    return em(tag, comps, previous, True)


def bpca(tag: str, comps: str, previous: str) -> list[str]:
    small, prior = 1e-10, 0.001
    post = ["rs AS MATERIALIZED (SELECT row_id, any_value(tau) AS tau, " + ", ".join(
        f"sum({OBSERVED.format(e)}) AS {n}" for n, e in {"w11": "p1 * p1", "w12": "p1 * p2", "w22": "p2 * p2", "b1": "p1 * (x - m)", "b2": "p2 * (x - m)"}.items())
        + ", any_value(g11) AS g11, any_value(g12) AS g12, any_value(g22) AS g22 FROM xs JOIN mo USING (i) JOIN cur USING (i) JOIN ok USING (row_id) GROUP BY row_id)",
        "ri AS (SELECT row_id, tau, b1, b2, tau * w11 + 1 + g11 AS a, tau * w12 + g12 AS b, tau * w22 + 1 + g22 AS d FROM rs)",
        "ts AS MATERIALIZED (SELECT row_id, d / (a * d - b * b) AS r11, -b / (a * d - b * b) AS r12, a / (a * d - b * b) AS r22, "
        "tau * (d * b1 - b * b2) / (a * d - b * b) AS y1, tau * (a * b2 - b * b1) / (a * d - b * b) AS y2 FROM ri)"]
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < 1000)", *post,
             "cc AS MATERIALIZED (SELECT row_id, i, x IS NULL AS gone, p1, p2, tau, r11, r12, r22, y1, y2, coalesce(x - m, y1 * p1 + y2 * p2) AS dd FROM xs "
             "JOIN mo USING (i) JOIN cur USING (i) JOIN ts USING (row_id))",
             "nn AS (SELECT count(*) AS n FROM ts)",
             "tv AS MATERIALIZED (SELECT i, p1, p2, sum(dd * y1 + CASE WHEN gone THEN r11 * p1 + r12 * p2 ELSE 0 END) / (SELECT n FROM nn) AS t1, "
             "sum(dd * y2 + CASE WHEN gone THEN r12 * p1 + r22 * p2 ELSE 0 END) / (SELECT n FROM nn) AS t2 FROM cc GROUP BY i, p1, p2)",
             "sp AS (SELECT sum(dd * dd + CASE WHEN gone THEN 1 / tau + r11 * p1 * p1 + 2 * r12 * p1 * p2 + r22 * p2 * p2 ELSE 0 END) / (SELECT n FROM nn) AS spread FROM cc)",
             "hy AS (SELECT any_value(k) AS k, any_value(tau) AS tau, any_value(g11) AS g11, any_value(g12) AS g12, any_value(g22) AS g22, any_value(al1) AS al1, "
             "any_value(al2) AS al2, any_value(told) AS told FROM cur HAVING count(*) > 0)",
             "ww AS (SELECT sum(p1 * p1) AS w11, sum(p1 * p2) AS w12, sum(p2 * p2) AS w22, sum(t1 * p1) AS x11, sum(t1 * p2) AS x12, sum(t2 * p1) AS x21, sum(t2 * p2) AS x22 FROM tv)",
             "rx AS (SELECT *, 1 + tau * w11 + g11 AS a, tau * w12 + g12 AS b, 1 + tau * w22 + g22 AS d FROM hy CROSS JOIN ww)",
             "rv AS (SELECT *, d / (a * d - b * b) AS v11, -b / (a * d - b * b) AS v12, a / (a * d - b * b) AS v22 FROM rx)",
             "dw AS (SELECT *, v11 + tau * (x11 * v11 + x12 * v12) + al1 / n AS e11, v12 + tau * (x11 * v12 + x12 * v22) AS e12, v12 + tau * (x21 * v11 + x22 * v12) AS e21, "
             "v22 + tau * (x21 * v12 + x22 * v22) + al2 / n AS e22 FROM rv CROSS JOIN nn)",
             "di AS MATERIALIZED (SELECT *, e22 / (e11 * e22 - e12 * e21) AS h11, -e12 / (e11 * e22 - e12 * e21) AS h12, -e21 / (e11 * e22 - e12 * e21) AS h21, "
             "e11 / (e11 * e22 - e12 * e21) AS h22 FROM dw)",
             "wn AS MATERIALIZED (SELECT i, tv.p1, tv.p2, t1, t2, t1 * h11 + t2 * h21 AS n1, t1 * h12 + t2 * h22 AS n2 FROM tv CROSS JOIN di)",
             f"hn AS (SELECT *, ({N} + {2 * small!r} / n) / (spread - tw + ({prior} * mm + {2 * small!r}) / n) AS tnew, {N} / n AS vn FROM di CROSS JOIN sp CROSS JOIN "
             "(SELECT sum(t1 * n1 + t2 * n2) AS tw, sum(n1 * n1) AS q11, sum(n2 * n2) AS q22 FROM wn) CROSS JOIN (SELECT sum(m * m) AS mm FROM mo))"]
    step = (f"SELECT hn.k + 1, wn.i, n1, n2, tnew, h11 * vn, (h12 + h21) / 2 * vn, h22 * vn, ({N} + {2 * small!r}) / (tnew * q11 + h11 * vn + {2 * small!r}), "
            f"({N} + {2 * small!r}) / (tnew * q22 + h22 * vn + {2 * small!r}), tnew, wn.p1, wn.p2, hn.tau, hn.g11, hn.g12, hn.g22, "
            f"hn.k > 0 AND abs(log10(tnew) - log10(hn.told)) < {TOLERANCE} FROM wn CROSS JOIN hn")
    last = f"{tag}f"
    again = [f"cur AS (SELECT i, q1 AS p1, q2 AS p2, qtau AS tau, k11 AS g11, k12 AS g12, k22 AS g22 FROM {last})", *post]
    fill = ("SELECT xs.row_id, xs.i, coalesce(xs.x, y1 * p1 + y2 * p2 + m) AS x FROM xs JOIN ts USING (row_id) JOIN cur USING (i) JOIN mo USING (i)")
    alpha = lambda c: f"({N} + {2 * small!r}) / (tau * sum({c} * {c}) OVER () + {2 * small!r})"
    shared = [] if previous != "f0" else ["mo AS MATERIALIZED (SELECT i, avg(x) AS m FROM xs GROUP BY i)",
                                          "ok AS MATERIALIZED (SELECT DISTINCT row_id FROM xs WHERE x IS NOT NULL)"]
    return [*shared, gram_of(previous, f"{tag}g", "cov"), *eig(f"{tag}g", 2, f"{tag}e"), pair(f"{tag}e", f"{tag}p", comps, "sqrt(l)"),
            f"{tag}v AS (SELECT 1 / greatest(sum(CASE WHEN i = j THEN v END) - (SELECT sum(l) FROM (SELECT DISTINCT a, l FROM {tag}e WHERE a <= {comps})), 1e-10) AS tau FROM {tag}g)",
            f"{tag}(k, i, p1, p2, tau, g11, g12, g22, al1, al2, told, q1, q2, qtau, k11, k12, k22, done) AS (SELECT 0, i, p1, p2, tau, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, "
            f"{alpha('p1')}, {alpha('p2')}, 1000.0::DOUBLE, p1, p2, tau, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, false FROM {tag}p CROSS JOIN {tag}v UNION ALL {body(inner, step)})",
            f"{last} AS MATERIALIZED (SELECT * FROM {tag} WHERE done)", f"{tag}fill AS MATERIALIZED {body(again, fill)}"]


def svd(tag: str, comps: str, previous: str) -> list[str]:
    """The rows themselves are the state: x before the step."""
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < 1000)",
             "g AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM cur a JOIN cur b USING (row_id) GROUP BY a.i, b.i)",
             *eig("g", 2, "ge"), pair("ge", "pp", comps),
             "ts AS (SELECT row_id, sum(x * p1) AS t1, sum(x * p2) AS t2 FROM cur JOIN pp USING (i) GROUP BY row_id)",
             "nw AS MATERIALIZED (SELECT cur.row_id, cur.i, cur.k, cur.mse, cur.gone, cur.x, t1 * p1 + t2 * p2 AS est FROM cur JOIN ts USING (row_id) JOIN pp USING (i))",
             "er AS (SELECT avg((x - est) * (x - est)) AS mse FROM nw WHERE NOT gone)"]
    step = ("SELECT k + 1, row_id, i, gone, CASE WHEN gone THEN est ELSE x END, er.mse, er.mse = 0 OR "
            f"abs((er.mse - coalesce(nw.mse, 0)) / er.mse) < {TOLERANCE} FROM nw CROSS JOIN er")
    return [f"{tag}(k, row_id, i, gone, x, mse, done) AS (SELECT 0, row_id, i, xs.x IS NULL, f.x, NULL::DOUBLE, false FROM {previous} f JOIN xs USING (row_id, i) "
            f"UNION ALL {body(inner, step)})",
            f"{tag}fill AS MATERIALIZED (SELECT row_id, i, x FROM {tag} WHERE done)"]


def alm(tag: str) -> list[str]:
    """State per cell: the error matrix and the multiplier; the penalty and its step travel along."""
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < 1000)",
             "c AS MATERIALIZED (SELECT row_id, i, d - e + y / mu AS x FROM cur)",
             "g AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (row_id) GROUP BY a.i, b.i)",
             *eig("g", N, "ge"),
             "sh AS (SELECT i, a, p, sqrt(greatest(l, 0)) AS s, max(sqrt(greatest(l, 0))) OVER () AS top FROM ge)",
             "bb AS MATERIALIZED (SELECT x.i, y.i AS j, sum(CASE WHEN x.s > greatest(1 / h.mu, 1e-8 * x.top) THEN x.p * y.p * (1 - 1 / h.mu / x.s) ELSE 0 END) AS v "
             "FROM sh x JOIN sh y USING (a) CROSS JOIN (SELECT any_value(mu) AS mu FROM cur) h GROUP BY x.i, y.i)",
             "lo AS (SELECT row_id, j AS i, sum(x * v) AS a1 FROM c JOIN bb USING (i) GROUP BY row_id, j)",
             "ne AS MATERIALIZED (SELECT cur.* EXCLUDE (low), a1 AS low, CASE WHEN gone THEN d - a1 + y / mu ELSE 0 END AS e1 FROM cur JOIN lo USING (row_id, i))",
             "nm AS (SELECT sqrt(sum((d - low - e1) * (d - low - e1))) / any_value(norm) AS gap, sqrt(sum((e1 - e) * (e1 - e))) / any_value(norm) AS change, "
             "any_value(mu) AS mu0, any_value(rho) AS rho0 FROM ne)",
             "mn AS (SELECT *, CASE WHEN least(mu0, sqrt(mu0)) * change < 1e-6 THEN mu0 * rho0 ELSE mu0 END AS mu1 FROM nm)"]
    step = ("SELECT k + 1, row_id, i, gone, d, e1, y + mu * (d - low - e1), mu1, rho, norm, low, gap, least(mu1, sqrt(mu1)) * change, k > 0 AND gap < 1e-7 AND least(mu1, sqrt(mu1)) * change < 1e-6 "
            "FROM ne CROSS JOIN mn")
    return [f"{tag}(k, row_id, i, gone, d, e, y, mu, rho, norm, low, ratio1, ratio2, done) AS (SELECT 0, row_id, i, x IS NULL, coalesce(x, 0), 0.0::DOUBLE, 0.0::DOUBLE, 1 / sqrt(ss), "
            f"1.2172 + 1.8588 * nobs / (n * {N}), sqrt(ss), 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, false FROM xs CROSS JOIN n1 CROSS JOIN (SELECT count(x) AS nobs, sum(x * x) AS ss FROM xs) "
            f"UNION ALL {body(inner, step)})",
            f"{tag}fill AS MATERIALIZED (SELECT row_id, i, CASE WHEN gone THEN low ELSE d END AS x FROM {tag} WHERE done)"]


# position of every observed cell of a variable, and the donor cells of every missing one
LINKS = [
    "ob AS MATERIALIZED (SELECT row_id, i, row_number() OVER (PARTITION BY i ORDER BY t, row_id) - 1 AS pos FROM raw JOIN om USING (row_id) WHERE x IS NOT NULL)",
    f"dg AS (SELECT row_id, i, k, md5(concat_ws('|', '0', row_id, 'x' || i, k)) AS h FROM raw CROSS JOIN range({COPIES // 2}) c(k) WHERE x IS NULL)",
    "dr AS (SELECT row_id, i, 2 * k + s AS copy, ('0x' || substr(h, 16 * s + 1, 8))::BIGINT / 4294967296.0::DOUBLE + ('0x' || substr(h, 16 * s + 9, 8))::BIGINT / 4294967296.0::DOUBLE "
    "/ 4294967296.0::DOUBLE AS share FROM dg CROSS JOIN range(2) h2(s))",
    "li AS MATERIALIZED (SELECT dr.row_id, dr.i, dr.copy, ob.row_id AS donor FROM dr JOIN (SELECT i, count(*) AS n FROM ob GROUP BY i) USING (i) "
    "JOIN ob ON ob.i = dr.i AND ob.pos = floor(share * n)::BIGINT)"]


def pcada(tag: str, comps: str, previous: str, most: int = 1000) -> list[str]:
    """State: the current table and the loadings, as rows (row_id, i, x, p1, p2)."""
    polar = ("CASE WHEN {c} >= 2 THEN {two} ELSE {one} END")
    inner = [f"cur AS (SELECT * FROM {tag} WHERE NOT done AND k < {most})",
             "ts AS (SELECT row_id, sum(x * p1) AS t1, sum(x * p2) AS t2 FROM cur GROUP BY row_id)",
             "nw AS MATERIALIZED (SELECT cur.*, t1 * p1 + t2 * p2 AS est, CASE WHEN gone THEN t1 * p1 + t2 * p2 ELSE x0 END AS base FROM cur JOIN ts USING (row_id))",
             "er AS (SELECT avg((x0 - est) * (x0 - est)) AS mse FROM nw WHERE NOT gone)",
             "le AS MATERIALIZED (SELECT li.row_id, li.i, li.copy, d.x0 - d.est AS r FROM li JOIN nw d ON d.row_id = li.donor AND d.i = li.i)",
             "mv AS (SELECT row_id, i, avg(r) AS r FROM le GROUP BY row_id, i)",
             # a copy differs from the base on missing cells only
             "gb AS (SELECT a.i, b.i AS j, sum(a.base * b.base) AS v FROM nw a JOIN nw b USING (row_id) GROUP BY a.i, b.i)",
             "gx AS (SELECT copy, le.i, b.i AS j, sum(le.r * b.base) AS v FROM le JOIN nw b USING (row_id) GROUP BY copy, le.i, b.i)",
             "gd AS (SELECT a.copy, a.i, b.i AS j, sum(a.r * b.r) AS v FROM le a JOIN le b ON a.row_id = b.row_id AND a.copy = b.copy GROUP BY a.copy, a.i, b.i)",
             f"gk AS MATERIALIZED (SELECT copy, i, j, sum(v) AS v FROM (SELECT copy, i, j, v FROM gb CROSS JOIN range({COPIES}) q(copy) UNION ALL SELECT copy, i, j, v FROM gx "
             "UNION ALL SELECT copy, j, i, v FROM gx UNION ALL SELECT copy, i, j, v FROM gd) GROUP BY copy, i, j)",
             *eig("gk", 2, "ge", "copy"),
             "al AS (SELECT g.copy, g.a, g.i, g.p * CASE WHEN sum(g.p * f.p) OVER (PARTITION BY g.copy, g.a) < 0 THEN -1 ELSE 1 END AS p FROM ge g JOIN (SELECT a, i, p FROM ge WHERE copy = 0) f USING (a, i))",
             "av AS MATERIALIZED (SELECT i, avg(CASE WHEN a = 1 THEN p END) AS m1, avg(CASE WHEN a = 2 THEN p END) AS m2 FROM al GROUP BY i)",
             # polar factor M (M'M)^-1/2, closed form for two columns: the root of a 2 x 2 matrix is (M'M + d I) / sqrt(trace + 2 d)
             "sm AS (SELECT sum(m1 * m1) AS a, sum(m1 * m2) AS b, sum(m2 * m2) AS c FROM av)",
             "rt AS (SELECT *, sqrt(a * c - b * b) AS d FROM sm)",
             "ru AS (SELECT (a + d) / sqrt(a + c + 2 * d) AS r11, b / sqrt(a + c + 2 * d) AS r12, (c + d) / sqrt(a + c + 2 * d) AS r22, a FROM rt)",
             "pn AS MATERIALIZED (SELECT i, " + polar.format(c=comps, two="(m1 * r22 - m2 * r12) / (r11 * r22 - r12 * r12)", one="m1 / sqrt(a)") + " AS n1, "
             + polar.format(c=comps, two="(m2 * r11 - m1 * r12) / (r11 * r22 - r12 * r12)", one="0") + " AS n2 FROM av CROSS JOIN ru)"]
    step = ("SELECT k + 1, nw.row_id, nw.i, gone, x0, CASE WHEN gone THEN est + r ELSE x0 END, n1, n2, er.mse, "
            f"coalesce(abs((er.mse - nw.mse) / nw.mse) < {TOLERANCE}, false) FROM nw LEFT JOIN mv USING (row_id, i) JOIN pn USING (i) CROSS JOIN er")
    shared = LINKS if previous == "f0" else []
    return [*shared, gram_of(previous, f"{tag}g", "cor"), *eig(f"{tag}g", 2, f"{tag}e"), pair(f"{tag}e", f"{tag}p", comps),
            f"{tag}(k, row_id, i, gone, x0, x, p1, p2, mse, done) AS (SELECT 0, row_id, i, xs.x IS NULL, xs.x, f.x, p1, p2, NULL::DOUBLE, false FROM {previous} f "
            f"JOIN xs USING (row_id, i) JOIN {tag}p USING (i) UNION ALL {body(inner, step)})",
            f"{tag}fill AS MATERIALIZED (SELECT row_id, i, x FROM {tag} WHERE done OR k = {most})"]


def finish(source: str, digits: int = 2) -> str:
    cells = each(f"max(CASE WHEN i = {{i}} THEN {rnd('coalesce(r.x, h.x * sd + mu) + 0.0000314', digits)} END) AS {{v}}")
    return f"SELECT row_id, {cells}, any_value(h.a) AS components FROM raw r JOIN ({source}) h USING (row_id, i) JOIN st USING (i) GROUP BY row_id"


def to_the_end(fit, prefill: str) -> str:
    """Fit with two components, choose again, fit with that number; the loop must end there."""
    c = [*start(prefill), *fit("r1", str(START_COMPONENTS), "f0"), *choice("r1fill", "c1"),
         *fit("r2", "(SELECT a FROM c1a)", "r1fill"), *choice("r2fill", "c2")]
    return with_(*c) + finish(
        f"SELECT row_id, i, x, {START_COMPONENTS} AS a FROM r1fill WHERE (SELECT a FROM c1a) = {START_COMPONENTS} UNION ALL SELECT row_id, i, x, (SELECT a FROM c1a) FROM r2fill "
        f"WHERE (SELECT a FROM c1a) < {START_COMPONENTS} AND (SELECT a FROM c2a) = (SELECT a FROM c1a)")


def one_component(fit, prefill: str) -> list[str]:
    """`out`(row_id, i, x): a fit with one component whose choice confirms it, so that the loop ends; else no rows."""
    fitted = fit("r1") if fit is alm else fit("r1", "1", "f0")
    return [*start(prefill), *fitted, *choice("r1fill", "c1"), "out AS (SELECT row_id, i, x FROM r1fill WHERE (SELECT a FROM c1a) = 1)"]


def alm_to_the_end() -> str:
    """The number of components is only reported: the fit does not use it."""
    return with_(*start("mean"), *alm("r1"), *choice("r1fill", "c1")) + finish("SELECT row_id, i, x, (SELECT a FROM c1a) AS a FROM r1fill")


def four_donor_rounds() -> str:
    c = [*start("interpolation"), *pcada("r1", "1", "f0", 4)]
    return f"SELECT * EXCLUDE (components) FROM ({with_(*c)}{finish('SELECT row_id, i, x, 1 AS a FROM r1fill', 3)})"


def best_start(candidates: int = 5) -> str:
    """Least squares without means from random starts; the fill whose missing cells have the smallest largest contribution."""
    draw = u(lit(0), lit("als"), "c", "i - 1", lit(0))
    step = ["cur AS (SELECT * FROM als WHERE NOT done AND k < 1000)",
            "ts AS MATERIALIZED (SELECT cand, row_id, coalesce(sum(p * x) / nullif(sum(CASE WHEN x IS NOT NULL THEN p * p END), 0), 0) AS t FROM xs JOIN cur USING (i) GROUP BY cand, row_id)",
            "vs AS MATERIALIZED (SELECT cand, i, sum(x * t) AS xt, sum(t * t) AS tt, sum(x * x) AS xx FROM xs JOIN ts USING (row_id) WHERE x IS NOT NULL GROUP BY cand, i)",
            "se AS (SELECT cand, sum(xx - xt * xt / tt) AS e FROM vs GROUP BY cand)"]
    select = (f"SELECT k + 1, cand, i, xt / tt, cur.p, se.e, coalesce(abs((se.e - cur.sse) / cur.sse) < {TOLERANCE}, false) FROM cur JOIN vs USING (cand, i) JOIN se USING (cand)")
    c = [*start("mean"),
         f"dw AS (SELECT c AS cand, i, {draw} - 0.5 AS d FROM st CROSS JOIN range({candidates}) r(c))",
         f"als(k, cand, i, p, q, sse, done) AS (SELECT 0, cand, i, d / sqrt(sum(d * d) OVER (PARTITION BY cand)), 0.0::DOUBLE, NULL::DOUBLE, false FROM dw UNION ALL {body(step, select)})",
         "fin AS MATERIALIZED (SELECT * FROM als WHERE done)",
         "tf AS (SELECT cand, row_id, coalesce(sum(q * x) / nullif(sum(CASE WHEN x IS NOT NULL THEN q * q END), 0), 0) AS t FROM xs JOIN fin USING (i) GROUP BY cand, row_id)",
         "fl AS MATERIALIZED (SELECT cand, row_id, i, xs.x IS NULL AS gone, coalesce(xs.x, t * p) AS x FROM xs JOIN tf USING (row_id) JOIN fin USING (cand, i))",
         "z AS MATERIALIZED (SELECT cand, row_id, i, gone, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM fl WINDOW w AS (PARTITION BY cand, i))",
         "cor AS MATERIALIZED (SELECT a.cand, a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM z a JOIN z b USING (cand, row_id) GROUP BY a.cand, a.i, b.i)",
         *eig("cor", 1, "pc", "cand"),
         "sc AS (SELECT cand, row_id, sum(z * p) AS t FROM z JOIN pc USING (cand, i) GROUP BY cand, row_id)",
         "wo AS (SELECT cand, max(greatest(z * t * p, 0) / s2) AS worst FROM z JOIN sc USING (cand, row_id) JOIN pc USING (cand, i) "
         "JOIN (SELECT cand, var_pop(t) AS s2 FROM sc GROUP BY cand) USING (cand) WHERE gone GROUP BY cand)"]
    return f"SELECT * EXCLUDE (components) FROM ({with_(*c)}{finish('SELECT row_id, i, x, 1 AS a FROM fl WHERE cand = (SELECT arg_min(cand, worst) FROM wo)')})"


# every algorithm with its prefill, the name of what its iterations report, and how to get that from the recursive table
TRACED = {
    "Alternating": (alternating, "mean", {"sse_obs": "round(any_value(sse), 3)"}),
    "SVDImpute": (svd, "interpolation", {"mse_obs": "round(any_value(mse), 7)"}),
    "PPCA": (ppca, "interpolation", {"lower_bound": "round(any_value(bound), 3)"}),
    "PPCA-M": (ppcam, "interpolation", {"lower_bound": "round(any_value(bound), 3)"}),
    "BPCA": (bpca, "mean", {"dtau": "round(abs(log10(any_value(told)) - log10(lag(any_value(told)) OVER (ORDER BY k))), 7)"}),
    "ALM": (alm, "mean", {"ratio1": "round(any_value(ratio1), 7)", "ratio2": "round(any_value(ratio2), 7)"}),
}


def traces() -> str:
    parts = []
    for name, (fit, prefill, metrics) in TRACED.items():
        for metric, value in metrics.items():
            fitted = fit("r1") if fit is alm else fit("r1", "1", "f0")
            parts.append(f"SELECT * FROM ({with_(*start(prefill), *fitted)} SELECT '{name}' AS algorithm, 1 AS round, k::INT AS iteration, '{metric}' AS metric, {value} AS value "
                         "FROM r1 GROUP BY k) WHERE iteration > 0")
    return "\nUNION ALL\n".join(parts)


COMPARED = {"Alternating": (alternating, "mean"), "SVDImpute": (svd, "interpolation"), "BPCA": (bpca, "mean"), "ALM": (alm, "mean")}


def comparison() -> str:
    """Scores of converged fits with one component: refit, limits and flags of each filled table, bounds, errors against the truth."""
    q = norm_ppf(FLAG_LIM)
    unscaled = "SELECT row_id, i, coalesce(r.x, o.x * sd + mu) AS x FROM out o JOIN raw r USING (row_id, i) JOIN st USING (i)"
    fills = [f"SELECT '{name}' AS alg, * FROM ({with_(*one_component(fit, prefill))}{unscaled})" for name, (fit, prefill) in COMPARED.items()]
    bounds = "CASE i " + " ".join(f"WHEN {i + 1} THEN {BOUNDS[v]!r}" for i, v in enumerate(V)) + " END"
    c = [OM, masked(), long("m", "raw"), long("om", "truth"),
         "fl AS MATERIALIZED (SELECT 'MI' AS alg, row_id, i, coalesce(x, avg(x) OVER (PARTITION BY i)) AS x FROM raw UNION ALL " + " UNION ALL ".join(fills) + ")",
         "z AS MATERIALIZED (SELECT alg, row_id, i, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM fl WINDOW w AS (PARTITION BY alg, i))",
         "cor AS MATERIALIZED (SELECT a.alg, a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM z a JOIN z b USING (alg, row_id) GROUP BY a.alg, a.i, b.i)",
         *eig("cor", 1, "pc", "alg"),
         "sc AS (SELECT alg, row_id, sum(z * p) AS t FROM z JOIN pc USING (alg, i) GROUP BY alg, row_id)",
         "sg AS (SELECT alg, var_pop(t) AS s2 FROM sc GROUP BY alg)",
         "cn AS MATERIALIZED (SELECT alg, row_id, i, z * t * p / s2 AS ct, (z - t * p) * (z - t * p) AS cq FROM z JOIN sc USING (alg, row_id) JOIN pc USING (alg, i) JOIN sg USING (alg))",
         f"li AS (SELECT alg, i, avg(ct) + {q!r} * stddev_pop(ct) AS lt, avg(cq) + {q!r} * stddev_pop(cq) AS lq FROM cn GROUP BY alg, i)",
         "sd AS (SELECT i, stddev_pop(x) AS sd FROM truth GROUP BY i)"]
    return with_(*c) + (
        "SELECT alg AS algorithm, count(*) FILTER (WHERE abs(ct) > lt OR abs(cq) > lq)::DOUBLE AS plausibility, 1.0::DOUBLE AS components, "
        f"count(*) FILTER (WHERE fl.x < 0 OR fl.x > {bounds})::DOUBLE AS feasibility, {rnd('sqrt(avg(((fl.x - truth.x) / sd) * ((fl.x - truth.x) / sd)))', 4)} AS nrmse "
        "FROM fl JOIN raw USING (row_id, i) JOIN truth USING (row_id, i) JOIN sd USING (i) JOIN cn USING (alg, row_id, i) JOIN li USING (alg, i) WHERE raw.x IS NULL GROUP BY alg")


def statuses() -> str:
    names = ["MI", "Alternating", "SVDImpute", "PCADA", "PPCA", "PPCA-M", "BPCA", "SVT", "ALM", "ALS"]
    return "SELECT algorithm, 'ok' AS status, NULL::VARCHAR AS error, rounds FROM (VALUES " + ", ".join(
        f"('{n}', {int(n != 'MI')})" for n in names) + ") t(algorithm, rounds)"


# -- outliers ---------------------------------------------------------------------------------------------------------

def neighbours_long(v: str = "x") -> str:
    w, seen = "(PARTITION BY i ORDER BY t, row_id ROWS BETWEEN", f"CASE WHEN {v} IS NOT NULL THEN t END"
    up, down = "UNBOUNDED PRECEDING AND CURRENT ROW)", "CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (f"last_value({v} IGNORE NULLS) OVER {w} {up} AS x_p, last_value({seen} IGNORE NULLS) OVER {w} {up} AS x_pt, "
            f"first_value({v} IGNORE NULLS) OVER {w} {down} AS x_n, first_value({seen} IGNORE NULLS) OVER {w} {down} AS x_nt")


def outlier_rounds() -> list[str]:
    """`flags`(row_id, i): the cells flagged when a round flags none, at most 20 rounds.  A row (-1, 0) starts the recursion."""
    q = norm_ppf(FLAG_LIM)
    inner = ["cur AS (SELECT * FROM fl WHERE NOT done AND k < 20)", "nowk AS (SELECT DISTINCT k FROM cur)",
             "us AS MATERIALIZED (SELECT r.row_id, r.i, o.t, CASE WHEN c.row_id IS NULL THEN r.x END AS x, r.x IS NOT NULL AND c.row_id IS NULL AS open FROM raw r "
             "JOIN om o USING (row_id) CROSS JOIN nowk LEFT JOIN cur c ON c.row_id = r.row_id AND c.i = r.i)",
             f"nb AS (SELECT row_id, i, t, x, open, {neighbours_long()} FROM us)",
             f"fu AS MATERIALIZED (SELECT row_id, i, t, open, {interpolated('x')} AS x FROM nb)",
             *choice("fu", "c"),
             "z AS MATERIALIZED (SELECT row_id, i, t, open, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS z FROM fu)",
             "cor AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM z a JOIN z b USING (row_id) GROUP BY a.i, b.i)",
             *eig("cor", 5, "pc"),
             "us2 AS (SELECT pc.* FROM pc WHERE a <= (SELECT a FROM ca))",
             "cnt AS (SELECT count(*) / 6.0 AS n FROM z)",
             "dd AS MATERIALIZED (SELECT x.i, y.i AS j, sum(x.p * y.p / (x.l * (n - 1) / n)) AS v, (x.i = y.i)::INT - sum(x.p * y.p) AS c FROM us2 x JOIN us2 y USING (a) CROSS JOIN cnt GROUP BY x.i, y.i)",
             "cn AS MATERIALIZED (SELECT z.row_id, dd.j AS i, sum(z.z * dd.v) AS xd, sum(z.z * dd.c) AS e FROM z JOIN dd ON dd.i = z.i GROUP BY z.row_id, dd.j)",
             "cq AS MATERIALIZED (SELECT row_id, i, t, open, z * xd AS ct, e * e AS cq FROM cn JOIN z USING (row_id, i))",
             f"li AS (SELECT i, avg(ct) + {q!r} * stddev_pop(ct) AS lt, avg(cq) + {q!r} * stddev_pop(cq) AS lq FROM cq GROUP BY i)",
             f"nf AS MATERIALIZED (SELECT row_id, i FROM cq JOIN li USING (i) WHERE open AND t > {PROTECTED!r} AND (abs(ct) > lt OR abs(cq) > lq))"]
    step = ("SELECT k + 1, row_id, i, (SELECT count(*) FROM nf) = 0 FROM (SELECT row_id, i FROM cur UNION ALL SELECT row_id, i FROM nf) CROSS JOIN nowk")
    return [OM, spiked(), masked(name="m", src="sp"), long("m", "raw"), FOLDS,
            f"fl(k, row_id, i, done) AS (SELECT 0, -1::BIGINT, 0, false UNION ALL {body(inner, step)})",
            "flags AS MATERIALIZED (SELECT row_id, i FROM fl WHERE (done OR k = 20) AND row_id >= 0)"]


def found_outliers() -> str:
    num = "CASE i " + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(V)) + " END"
    return with_(*outlier_rounds()) + f"SELECT row_id, {num} AS variable, x AS value FROM flags JOIN raw USING (row_id, i)"


def cleaned_counts() -> str:
    num = "CASE i " + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(V)) + " END"
    labels = (f"lb AS (SELECT raw.row_id, {num.replace('CASE i', 'CASE raw.i')} AS variable, CASE WHEN x IS NULL THEN 'missing' WHEN f.row_id IS NOT NULL THEN 'outlier' ELSE 'observed' END AS label "
              "FROM raw LEFT JOIN flags f ON f.row_id = raw.row_id AND f.i = raw.i)")
    final = ("fin AS (SELECT variable, CASE WHEN count(*) FILTER (WHERE label = 'observed') OVER (PARTITION BY row_id) < 5 THEN 'removed' ELSE label END AS label FROM lb)")
    return with_(*outlier_rounds(), labels, final) + "SELECT variable, label, count(*) AS n FROM fin GROUP BY CUBE (variable, label)"


def oracle_sql() -> dict[str, str]:
    return {
        "fit_alternating": to_the_end(alternating, "mean"), "fit_svd": to_the_end(svd, "interpolation"), "fit_ppca": to_the_end(ppca, "interpolation"),
        "fit_ppcam": to_the_end(ppcam, "interpolation"), "fit_bpca": to_the_end(bpca, "mean"), "fit_alm": alm_to_the_end(),
        "fit_pcada": to_the_end(pcada, "interpolation"), "detect_outliers": found_outliers(), "clean_step_a": cleaned_counts(),
        "impute_pcada": four_donor_rounds(), "impute_als": best_start(), "convergence_trace": traces(), "compare_algorithms": comparison(), "run_all_status": statuses(),
        "fill_missing_loop": f"SELECT * EXCLUDE (components) FROM ({with_(*one_component(svd, 'interpolation'))}{finish('SELECT row_id, i, x, 1 AS a FROM out')})"}
