"""SQL for DuckDB that recomputes the registered queries from the same tables.

Eigenvectors come from repeated squaring of a small (i, j, v) table with trace normalisation, then deflation.  Iterative
algorithms are unrolled for one component, where every matrix formula is scalar algebra per variable.
"""

from __future__ import annotations

import math

# Fixed values from published tables, so that a wrong quantile in the package does not pass.
NORM_PPF = {0.75: 0.6744897501960817, 0.999: 3.090232306167813, 0.9999: 3.7190164854557084, 0.9995: 3.2905267314919255, 0.99995: 3.89059188641312}


def norm_ppf(p: float) -> float:
    return NORM_PPF[p]


def chi2_ppf(p: float, dof: int) -> float:
    """One degree of freedom: the square of a normal quantile."""
    assert dof == 1
    return NORM_PPF[(1 + p) / 2] ** 2


V = ["x1", "x2", "x3", "x4", "x5", "x6"]
COLS = ", ".join(V)
LIM, FLAG_LIM = 0.999, 0.9999
PROTECTED = 10000 / 1440
SQUARINGS = 12
# Fixed literals shared with the queries.
MU = {"x1": 100.0, "x2": 200000.0, "x3": 10000.0, "x4": 8000.0, "x5": 4.0, "x6": 400000.0}
SIGMA = {"x1": 50.0, "x2": 90000.0, "x3": 6000.0, "x4": 5000.0, "x5": 0.0, "x6": 150000.0}
BOUNDS = {"x1": 400.0, "x2": 650000.0, "x3": 30000.0, "x4": 25000.0, "x5": 12.0, "x6": 1000000.0}
UNITS = {"x1": "pieces", "x2": "money", "x3": "money", "x4": "money", "x5": "lines", "x6": "money"}


def u(*key, slot: int = 0) -> str:
    """Uniform draw; key parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), {1 + 8 * slot}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def lit(s) -> str:
    return f"'{s}'"


def rnd(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def each(template: str, sep: str = ", ") -> str:
    """Repeat a template for every variable; {v} is its name, {i} its number."""
    return sep.join(template.format(v=v, i=i + 1) for i, v in enumerate(V))


OM = """om AS MATERIALIZED (
  SELECT o_orderkey AS row_id, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS t,
         x1, x2, x3, x4, x5, round(o_totalprice + x2, 2) AS x6
  FROM orders JOIN (
    SELECT l_orderkey, sum(l_quantity) AS x1, round(sum(l_extendedprice), 2) AS x2,
           round(sum(l_extendedprice * l_discount), 4) AS x3, round(sum(l_extendedprice * l_tax), 4) AS x4,
           count(*)::DOUBLE AS x5
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
ES = """es AS (SELECT event_id AS row_id, user_id AS series, epoch_us(ts) AS t, value AS x FROM events)"""


def masked(level=0.1, seed=42, name="m", src="om") -> str:
    cells = each(f"CASE WHEN {u(lit(seed), 'row_id', lit('{v}'))} >= {level} THEN {{v}} END AS {{v}}")
    return f"{name} AS MATERIALIZED (SELECT row_id, t, {cells} FROM {src})"


def spiked(share=0.002, seed=7, name="sp", src="om") -> str:
    cells = each(f"CASE WHEN {u(lit(seed), 'row_id', lit('{v}'))} < {share} THEN {{v}} * 8.0 ELSE {{v}} END AS {{v}}")
    return f"{name} AS MATERIALIZED (SELECT row_id, t, {cells} FROM {src})"


MES = f"""me AS (SELECT row_id, series, t, CASE WHEN {u(lit(42), 'row_id', lit('x'))} >= 0.1 THEN x END AS x FROM es)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def long(src: str, name: str, keys: str = "row_id", nulls: bool = True) -> str:
    """Long form (keys, i, x) of a wide table."""
    parts = each(f"SELECT {keys}, {{i}} AS i, {{v}} AS x FROM {src}", " UNION ALL ")
    return f"{name} AS MATERIALIZED (SELECT * FROM ({parts}){'' if nulls else ' WHERE x IS NOT NULL'})"


# -- labels -----------------------------------------------------------------------------------------------------------

LAB = "lab AS MATERIALIZED (SELECT o.row_id, o.t, " + each(
    "o.{v}, CASE WHEN m.{v} IS NULL THEN 'missing' WHEN " + u(lit(7), "o.row_id", lit("{v}"))
    + " < 0.05 THEN 'outlier' ELSE 'observed' END AS label_{v}") + " FROM om o JOIN m USING (row_id))"
LAB_LONG = "ll AS (" + each(
    "SELECT lab.row_id, lab.t, '{v}' AS variable, m.{v} AS value, label_{v} AS label FROM lab JOIN m USING (row_id)",
    " UNION ALL ") + ")"
N_OBSERVED = "(" + each("(label_{v} = 'observed')::INT", " + ") + ")"
LABELLED = (OM, masked(), LAB)

# -- gaps -------------------------------------------------------------------------------------------------------------


def neighbours(v: str, part: str) -> str:
    w = f"({part} ORDER BY t, row_id ROWS BETWEEN"
    seen = f"CASE WHEN {v} IS NOT NULL THEN t END"
    up, down = "UNBOUNDED PRECEDING AND CURRENT ROW)", "CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (f"last_value({v} IGNORE NULLS) OVER {w} {up} AS {v}_p, last_value({seen} IGNORE NULLS) OVER {w} {up} AS {v}_pt, "
            f"first_value({v} IGNORE NULLS) OVER {w} {down} AS {v}_n, "
            f"first_value({seen} IGNORE NULLS) OVER {w} {down} AS {v}_nt")


def interpolated(v: str) -> str:
    return (f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN {v}_p IS NULL THEN {v}_n WHEN {v}_n IS NULL THEN {v}_p "
            f"WHEN {v}_nt = {v}_pt THEN {v}_p "
            f"ELSE {v}_p + ({v}_n - {v}_p) / ({v}_nt - {v}_pt)::DOUBLE * (t - {v}_pt) END")


NB_OM = f"nb AS (SELECT row_id, t, {COLS}, {', '.join(neighbours(v, '') for v in V)} FROM m)"
NB_ES = f"nb AS (SELECT row_id, series, t, x, {neighbours('x', 'PARTITION BY series')} FROM me)"


def islands(src: str, v: str, name: str, group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    g = f"{group}, " if group else ""
    return f"""SELECT {g}'{name}' AS variable, min(t) AS start_t, max(t) AS end_t, count(*) AS length FROM (
      SELECT {g}t, {v} IS NULL AS gap, row_number() OVER ({part} ORDER BY t, row_id)
        - row_number() OVER (PARTITION BY {g}{v} IS NULL ORDER BY t, row_id) AS island FROM {src})
      WHERE gap GROUP BY {g}island"""


# -- PCA --------------------------------------------------------------------------------------------------------------

def eig(src: str, k: int, tag: str, key: str = "", rounds: int = SQUARINGS) -> list[str]:
    """CTEs ending in `<tag>`(key, i, a, p, l): the k leading eigenpairs of the symmetric table src(key, i, j, v)."""
    g = f"{key}, " if key else ""
    over = f"OVER (PARTITION BY {key})" if key else "OVER ()"
    same = f" AND a.{key} = b.{key}" if key else ""
    ag = f"a.{key}, " if key else ""
    by = f"PARTITION BY {key} " if key else ""
    ctes, current = [], src
    for c in range(1, k + 1):
        trace = f"sum(CASE WHEN i = j THEN v END) {over}"
        ctes.append(f"{tag}{c}_0 AS MATERIALIZED (SELECT {g}i, j, v / {trace} AS v FROM {current})")
        for r in range(1, rounds + 1):
            ctes.append(f"{tag}{c}_{r} AS MATERIALIZED (SELECT {g}i, j, v / {trace} AS v FROM (SELECT {ag}a.i, b.j, "
                        f"sum(a.v * b.v) AS v FROM {tag}{c}_{r - 1} a JOIN {tag}{c}_{r - 1} b ON a.j = b.i{same} "
                        f"GROUP BY {ag}a.i, b.j))")
        ctes.append(f"{tag}{c}_j AS (SELECT {g}i AS j FROM (SELECT {g}i, row_number() OVER ({by}ORDER BY v DESC) AS rn "
                    f"FROM {tag}{c}_{rounds} WHERE i = j) WHERE rn = 1)")
        using = f"USING ({key + ', ' if key else ''}j)"
        ctes.append(f"{tag}{c}_v AS MATERIALIZED (SELECT {g}i, v / sqrt(sum(v * v) {over}) AS p FROM {tag}{c}_{rounds} "
                    f"JOIN {tag}{c}_j {using})")
        ctes.append(f"{tag}{c}_p AS MATERIALIZED (SELECT {g}i, p * sign(max_by(p, abs(p)) {over}) AS p FROM {tag}{c}_v)")
        on_key = f" AND c.{key} = a.{key} AND c.{key} = b.{key}" if key else ""
        pick = f"a.{key}, " if key else ""
        group = f" GROUP BY a.{key}" if key else ""
        ctes.append(f"{tag}{c}_l AS MATERIALIZED (SELECT {pick}sum(a.p * c.v * b.p) AS l FROM {current} c JOIN {tag}{c}_p a "
                    f"ON a.i = c.i JOIN {tag}{c}_p b ON b.i = c.j{on_key}{group})")
        with_l = f"JOIN {tag}{c}_l l ON l.{key} = c.{key}" if key else f"CROSS JOIN {tag}{c}_l l"
        ck = f"c.{key}, " if key else ""
        ctes.append(f"{tag}{c}_d AS MATERIALIZED (SELECT {ck}c.i, c.j, c.v - l.l * a.p * b.p AS v FROM {current} c "
                    f"JOIN {tag}{c}_p a ON a.i = c.i JOIN {tag}{c}_p b ON b.i = c.j{on_key} {with_l})")
        current = f"{tag}{c}_d"
    union = " UNION ALL ".join(
        f"SELECT {'p.' + key + ', ' if key else ''}p.i, {c} AS a, p.p, l.l FROM {tag}{c}_p p "
        + (f"JOIN {tag}{c}_l l USING ({key})" if key else f"CROSS JOIN {tag}{c}_l l") for c in range(1, k + 1))
    ctes.append(f"{tag} AS MATERIALIZED ({union})")
    return ctes


def scaled_long(src: str, name: str = "z") -> list[str]:
    """Autoscaled long form."""
    return [long(src, f"{name}_raw"),
            f"{name}_st AS MATERIALIZED (SELECT i, avg(x) AS mu, stddev_samp(x) AS sd FROM {name}_raw GROUP BY i)",
            f"{name} AS MATERIALIZED (SELECT row_id, i, (x - mu) / sd AS z FROM {name}_raw JOIN {name}_st USING (i))"]


def pca(src: str = "om", k: int = 2) -> list[str]:
    """z, cor, pc(i, a, p, l), n1, score(row_id, a, t), sg(a, s2), dd / cc (i, j, v)."""
    return [*scaled_long(src), f"n1 AS MATERIALIZED (SELECT count(*) AS n FROM {src})",
            "cor AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / (SELECT n - 1 FROM n1) AS v FROM z a JOIN z b "
            "USING (row_id) GROUP BY a.i, b.i)",
            *eig("cor", k, "pc"),
            "score AS MATERIALIZED (SELECT row_id, a, sum(z * p) AS t FROM z JOIN pc USING (i) GROUP BY row_id, a)",
            "sg AS MATERIALIZED (SELECT a, var_pop(t) AS s2 FROM score GROUP BY a)",
            "dd AS MATERIALIZED (SELECT x.i, y.i AS j, sum(x.p * y.p / s2) AS v FROM pc x JOIN pc y USING (a) JOIN sg USING (a) "
            "GROUP BY x.i, y.i)",
            "cc AS MATERIALIZED (SELECT x.i, y.i AS j, (x.i = y.i)::INT - sum(x.p * y.p) AS v FROM pc x JOIN pc y USING (a) "
            "GROUP BY x.i, y.i)"]


RESID = """resid AS MATERIALIZED (SELECT z.row_id, z.i, z.z, r.rec, z.z - r.rec AS e FROM z JOIN (
  SELECT row_id, i, sum(t * p) AS rec FROM score JOIN pc USING (a) GROUP BY row_id, i) r USING (row_id, i))"""
T2 = "t2 AS MATERIALIZED (SELECT row_id, sum(t * t / s2) AS t2 FROM score JOIN sg USING (a) GROUP BY row_id)"
SRE = "sre AS MATERIALIZED (SELECT row_id, sum(e * e) AS sre FROM resid GROUP BY row_id)"


def contributions(kind: str) -> list[str]:
    """con(row_id, i, ct, cq)."""
    if kind in ("simple", "absolute"):
        ct = "ct" if kind == "simple" else "ct * z"
        cq = "e" if kind == "simple" else "e * e"
        return [RESID, "con0 AS (SELECT row_id, i, sum(t / sqrt(s2) * p) AS ct FROM score JOIN sg USING (a) JOIN pc USING (a) "
                       "GROUP BY row_id, i)",
                f"con AS MATERIALIZED (SELECT row_id, i, {ct} AS ct, {cq} AS cq FROM con0 JOIN resid USING (row_id, i))"]
    xd = ("SELECT z.row_id, dd.j AS i, sum(z.z * dd.v) AS xd, sum(z.z * cc.v) AS xc FROM z JOIN dd ON dd.i = z.i "
          "JOIN cc ON cc.i = dd.i AND cc.j = dd.j GROUP BY z.row_id, dd.j")
    if kind == "2D-Chiang":
        return [RESID, f"con AS MATERIALIZED (SELECT row_id, i, z * xd AS ct, e * e AS cq FROM ({xd}) "
                       "JOIN resid USING (row_id, i))"]
    return [f"con AS MATERIALIZED (SELECT row_id, w.i, xd * xd / dd.v AS ct, xc * xc / cc.v AS cq FROM ({xd}) w "
            "JOIN dd ON dd.i = w.i AND dd.j = w.i JOIN cc ON cc.i = w.i AND cc.j = w.i)"]


def limits(kind: str, method: str, lim: float) -> list[str]:
    """clim(i, lt, lq)."""
    level = lim + (1 - lim) / 2 if kind == "simple" else lim
    if method == "norm":
        q = norm_ppf(level)
        return [f"clim AS MATERIALIZED (SELECT i, avg(ct) + {q!r} * stddev_pop(ct) AS lt, avg(cq) + {q!r} * stddev_pop(cq) "
                "AS lq FROM con GROUP BY i)"]
    q = chi2_ppf(lim, 1)
    # D S D and C S C only through their diagonals
    def ratio(w):
        return (f"SELECT x.j AS i, sum(x.v * cor.v * y.v) / any_value(d.v) AS g FROM {w} x JOIN cor ON cor.i = x.i "
                f"JOIN {w} y ON y.i = cor.j AND y.j = x.j JOIN {w} d ON d.i = x.j AND d.j = x.j GROUP BY x.j")
    return [f"clim AS MATERIALIZED (SELECT i, {q!r} * t.g AS lt, {q!r} * s.g AS lq FROM ({ratio('dd')}) t "
            f"JOIN ({ratio('cc')}) s USING (i))"]


# The Student quantile depends on the row count: solve its distribution function by bisection.  For so many degrees of
# freedom the density is integrated through the incomplete beta series, here as a Cornish-Fisher expansion around the normal.
def t_limit(lim: float) -> list[str]:
    z = norm_ppf(lim)
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    return [f"tq AS (SELECT n - 3 AS dof, {z!r} + {g1!r} / (n - 3) + {g2!r} / power(n - 3, 2) + {g3!r} / power(n - 3, 3) AS q "
            "FROM n1)",
            "clim AS MATERIALIZED (SELECT i, sqrt(sum(ct * ct) / any_value(dof)) * any_value(q) AS lt, "
            "sqrt(sum(cq * cq) / any_value(dof)) * any_value(q) AS lq FROM con CROSS JOIN tq GROUP BY i)"]


# Box limits: scaled chi-square whose quantile is found by bisection on the incomplete gamma series.
BOX = f"""box AS MATERIALIZED (
  SELECT 't2' AS what, 2 * avg(t2) * avg(t2) / var_pop(t2) AS dof, avg(t2) AS mean FROM t2
  UNION ALL SELECT 'sre', 2 * avg(sre) * avg(sre) / var_pop(sre), avg(sre) FROM sre),
bis(what, dof, mean, step, lo, hi) AS (
  SELECT what, dof, mean, 0, 0.0::DOUBLE, 200.0::DOUBLE FROM box
  UNION ALL
  SELECT what, dof, mean, step + 1, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END FROM (
    SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(400), lambda k:
      exp((dof / 2 + k) * ln((lo + hi) / 4) - (lo + hi) / 4 - lgamma(dof / 2 + k + 1)))) < {LIM} AS below
    FROM bis WHERE step < 60)),
lims AS (SELECT what, mean / dof * (lo + hi) / 2 AS lim FROM bis WHERE step = 60)"""


def press(n_splits: int, seed: int, sd: str, k: int = 2, repeats: int = 1) -> list[str]:
    """pr(f, a, press) of repeated k-fold with 1..k components; f numbers the splits of all repeats."""
    folds = " UNION ALL ".join(
        f"SELECT row_id, {r} AS rep, floor({u(lit(seed), lit(r // 4), 'row_id', slot=r % 4)} * {n_splits})::INT + {r * n_splits} AS f FROM om"
        for r in range(repeats))
    return [
        f"fold AS MATERIALIZED ({folds})",
        "split AS MATERIALIZED (SELECT DISTINCT rep, f FROM fold)",
        long("om", "raw"),
        f"tr AS MATERIALIZED (SELECT g.f, i, avg(x) AS mu, {sd}(x) AS sd FROM raw JOIN fold USING (row_id) "
        "JOIN split g ON g.rep = fold.rep AND g.f <> fold.f GROUP BY g.f, i)",
        "ztr AS MATERIALIZED (SELECT row_id, g.f, i, (x - mu) / sd AS z FROM raw JOIN fold USING (row_id) "
        "JOIN split g ON g.rep = fold.rep AND g.f <> fold.f JOIN tr ON tr.f = g.f AND tr.i = raw.i)".replace("row_id, g.f, i,", "row_id, g.f, raw.i,"),
        "fcor AS MATERIALIZED (SELECT a.f, a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM ztr a JOIN ztr b "
        "USING (row_id, f) GROUP BY a.f, a.i, b.i)",
        *eig("fcor", k, "fp", "f"),
        "zte AS MATERIALIZED (SELECT row_id, fold.f, i, (x - mu) / sd AS z FROM raw JOIN fold USING (row_id) "
        "JOIN tr USING (i) WHERE fold.f = tr.f)",
        f"rm AS MATERIALIZED (SELECT x.f, k.a, x.i, y.i AS j, (x.i = y.i)::INT - sum(x.p * y.p) AS r FROM fp x "
        f"JOIN fp y USING (f, a) JOIN (SELECT unnest(range(1, {k + 1})) AS a) k ON x.a <= k.a GROUP BY x.f, k.a, x.i, y.i)",
        "er AS (SELECT row_id, zte.f, rm.a, rm.j, sum(z * rm.r) / any_value(d.r) AS e FROM zte JOIN rm ON rm.f = zte.f "
        "AND rm.i = zte.i JOIN rm d ON d.f = rm.f AND d.a = rm.a AND d.i = rm.j AND d.j = rm.j "
        "GROUP BY row_id, zte.f, rm.a, rm.j)",
        f"pr AS MATERIALIZED (SELECT f, a, sum(e * e) / {len(V)} AS press FROM er GROUP BY f, a)"]


PRESS5 = press(5, 1, "stddev_samp")

# -- iterative algorithms with one component --------------------------------------------------------------------------

P0 = repr(1 / math.sqrt(len(V)))
FIT_START = [
    OM, "m_here", long("m", "raw"),
    "n1 AS MATERIALIZED (SELECT count(*) AS n FROM om)",
    "st AS MATERIALIZED (SELECT i, mu, sqrt(sum((x - mu) * (x - mu)) / (SELECT n FROM n1)) AS sd FROM raw JOIN "
    "(SELECT i, avg(x) AS mu FROM raw GROUP BY i) USING (i) GROUP BY i, mu)",
    "xs AS MATERIALIZED (SELECT row_id, i, (x - mu) / sd AS x FROM raw JOIN st USING (i))",
]


def fit_start(mask: str | None = None) -> list[str]:
    """Scaled observed cells xs(row_id, i, x) of the order matrix under a mask."""
    return [c if c != "m_here" else (mask or masked()) for c in FIT_START]


def refill(hat: str) -> str:
    """Wide result from hat(row_id, i, h) in scaled units."""
    cells = each(f"max(CASE WHEN i = {{i}} THEN {rnd('coalesce(r.x, h.h * sd + mu) + 0.00003', 3)} END) AS {{v}}")
    return f"SELECT row_id, {cells} FROM raw r JOIN ({hat}) h USING (row_id, i) JOIN st USING (i) GROUP BY row_id"


def alternating(iterations: int) -> str:
    c = [*fit_start(), f"q0 AS (SELECT i, {P0}::DOUBLE AS p, 0.0::DOUBLE AS mu FROM st)"]
    for k in range(1, iterations + 1):
        c += [f"t{k} AS MATERIALIZED (SELECT row_id, coalesce(sum(p * (x - q{k-1}.mu)) / sum(CASE WHEN x IS NOT NULL THEN p * p END), 0) AS t "
              f"FROM xs JOIN q{k-1} USING (i) GROUP BY row_id)",
              f"q{k} AS MATERIALIZED (SELECT i, mu, (sxt - mu * st) / stt AS p FROM (SELECT i, (sum(x) - p * sum(t)) / count(*) AS mu, "
              f"sum(x * t) AS sxt, sum(t) AS st, sum(t * t) AS stt FROM xs JOIN t{k} USING (row_id) JOIN q{k-1} USING (i) "
              f"WHERE x IS NOT NULL GROUP BY i, p))"]
    n = iterations
    return with_(*c) + refill(f"SELECT row_id, i, t * p + q{n}.mu AS h FROM t{n} CROSS JOIN q{n}")


def ppca(iterations: int) -> str:
    c = [*fit_start(), f"q0 AS (SELECT i, {P0}::DOUBLE AS p, 0.0::DOUBLE AS mu FROM st)", "s0 AS (SELECT 1.0::DOUBLE AS s2)"]
    for k in range(1, iterations + 1):
        c += [f"t{k} AS MATERIALIZED (SELECT row_id, coalesce(sum(p * (x - q{k-1}.mu)), 0) / w AS t, s2 / w AS s FROM (SELECT *, "
              f"s2 + coalesce(sum(CASE WHEN x IS NOT NULL THEN p * p END) OVER (PARTITION BY row_id), 0) AS w FROM xs JOIN q{k-1} USING (i) "
              f"CROSS JOIN s{k-1}) q{k-1} GROUP BY row_id, w, s2)",
              f"q{k} AS MATERIALIZED (SELECT i, mu, (sxt - mu * st) / stt AS p FROM (SELECT i, (sum(x) - p * sum(t)) / count(*) AS mu, "
              f"sum(x * t) AS sxt, sum(t) AS st, sum(t * t + s) AS stt FROM xs JOIN t{k} USING (row_id) JOIN q{k-1} USING (i) "
              f"WHERE x IS NOT NULL GROUP BY i, p))",
              f"s{k} AS MATERIALIZED (SELECT avg((x - p * t - mu) * (x - p * t - mu) + p * p * s) AS s2 FROM xs JOIN t{k} USING (row_id) "
              f"JOIN q{k} USING (i) WHERE x IS NOT NULL)"]
    n = iterations
    return with_(*c) + refill(f"SELECT row_id, i, t * p + q{n}.mu AS h FROM t{n} CROSS JOIN q{n}")


def ppcam(iterations: int) -> str:
    c = [*fit_start(), f"q0 AS (SELECT i, {P0}::DOUBLE AS p, 0.0::DOUBLE AS mu FROM st)", "s0 AS (SELECT 1.0::DOUBLE AS s2)"]
    for k in range(1, iterations + 1):
        c += [f"t{k} AS MATERIALIZED (SELECT row_id, coalesce(sum(p * (x - q{k-1}.mu)), 0) / w AS t, s2 / w AS s FROM (SELECT *, "
              f"s2 + coalesce(sum(CASE WHEN x IS NOT NULL THEN p * p END) OVER (PARTITION BY row_id), 0) AS w FROM xs JOIN q{k-1} USING (i) "
              f"CROSS JOIN s{k-1}) q{k-1} GROUP BY row_id, w, s2)",
              f"f{k} AS MATERIALIZED (SELECT row_id, i, t, s, coalesce(x, t * p + mu) AS x, (x IS NULL)::INT AS m, p AS p0, s2 FROM xs "
              f"JOIN t{k} USING (row_id) JOIN q{k-1} USING (i) CROSS JOIN s{k-1})",
              f"q{k} AS MATERIALIZED (SELECT i, mu, (sxt - mu * st) / stt AS p FROM (SELECT i, avg(x - p0 * t) AS mu, "
              f"sum(x * t + m * s * p0) AS sxt, sum(t) AS st, sum(t * t + s) AS stt FROM f{k} GROUP BY i))",
              f"s{k} AS MATERIALIZED (SELECT avg(x * x + m * (s2 + p0 * p0 * s) - 2 * (x * t + m * s * p0) * p - 2 * mu * x + 2 * mu * t * p "
              f"+ p * p * (t * t + s) + mu * mu) AS s2 FROM f{k} JOIN q{k} USING (i))"]
    n = iterations
    return with_(*c) + refill(f"SELECT row_id, i, t * p + q{n}.mu AS h FROM t{n} CROSS JOIN q{n}")


def bpca_ctes(iterations: int, mask: str | None = None) -> list[str]:
    v, ga, gm, gt = len(V), 1e-10, 0.001, 1e-10
    c = [*fit_start(mask), "mo AS (SELECT i, avg(x) AS mu FROM xs GROUP BY i)",
         "ok AS (SELECT row_id FROM xs WHERE x IS NOT NULL GROUP BY row_id)", "nn AS (SELECT count(*) AS n FROM ok)",
         f"w0 AS (SELECT i, {P0}::DOUBLE AS w FROM st)",
         f"h0 AS (SELECT 1.0::DOUBLE AS tau, 1.0::DOUBLE AS sig, ({v} + {2 * ga}) / (1.0 + {2 * ga}) AS alpha)"]
    for k in range(1, iterations + 1):
        c += [f"y{k} AS MATERIALIZED (SELECT row_id, tau * sum(CASE WHEN x IS NOT NULL THEN w * (x - mu) ELSE 0 END) / r AS y, r FROM (SELECT *, 1 + sig "
              f"+ tau * sum(CASE WHEN x IS NOT NULL THEN w * w ELSE 0 END) OVER (PARTITION BY row_id) AS r FROM xs JOIN ok USING (row_id) "
              f"JOIN w{k-1} USING (i) JOIN mo USING (i) CROSS JOIN h{k-1}) GROUP BY row_id, tau, r)",
              f"e{k} AS MATERIALIZED (SELECT row_id, i, w, y, r, tau, (x IS NULL)::INT AS m, coalesce(x - mu, w * y) AS d FROM xs "
              f"JOIN y{k} USING (row_id) JOIN w{k-1} USING (i) JOIN mo USING (i) CROSS JOIN h{k-1})",
              f"tt{k} AS MATERIALIZED (SELECT i, w, sum(d * y + m * w / r) / (SELECT n FROM nn) AS t FROM e{k} GROUP BY i, w)",
              f"ts{k} AS MATERIALIZED (SELECT sum(d * d + m / tau + m * w * w / r) / (SELECT n FROM nn) AS trs FROM e{k})",
              f"dw{k} AS MATERIALIZED (SELECT any_value(rx) + tau * sum(t * w) * any_value(rx) + alpha / n AS dw, n FROM tt{k} CROSS JOIN h{k-1} CROSS JOIN nn "
              f"CROSS JOIN (SELECT 1 / (1 + any_value(tau) * sum(w * w) + any_value(sig)) AS rx FROM tt{k} CROSS JOIN h{k-1}) GROUP BY tau, alpha, n)",
              f"w{k} AS MATERIALIZED (SELECT i, t / dw AS w, t FROM tt{k} CROSS JOIN dw{k})",
              f"h{k} AS MATERIALIZED (SELECT tau, sig, ({v} + {2 * ga}) / (tau * ww + sig + {2 * ga}) AS alpha FROM (SELECT ({v} + {2 * gt} / n) / "
              f"(trs - tw + (mm * {gm} + {2 * gt}) / n) AS tau, {v} / n / dw AS sig, ww FROM dw{k} CROSS JOIN ts{k} CROSS JOIN "
              f"(SELECT sum(t * w) AS tw, sum(w * w) AS ww FROM w{k}) CROSS JOIN (SELECT sum(mu * mu) AS mm FROM mo)))"]
    return c


def bpca(iterations: int) -> str:
    return with_(*bpca_ctes(iterations)) + refill(f"SELECT row_id, i, d + mu AS h FROM e{iterations} JOIN mo USING (i)")


def holdout(iterations: int, share: float) -> str:
    """Error of the variational fit on hidden cells."""
    cells = each(f"CASE WHEN {u(lit(0), lit('holdout'), 'row_id', lit('{v}'))} >= {share} THEN {{v}} END AS {{v}}")
    ctes = bpca_ctes(iterations, f"m AS MATERIALIZED (SELECT row_id, t, {cells} FROM om)")
    return with_(*ctes, long("om", "truth")) + (
        f"SELECT {rnd('sqrt(avg(e * e)) / stddev_samp(y)', 5)} AS nrmse, {rnd('sqrt(avg(e * e))', 3)} AS rmse FROM (SELECT "
        f"(d + mo.mu) * st.sd + st.mu - truth.x AS e, truth.x AS y FROM e{iterations} JOIN mo USING (i) JOIN st USING (i) "
        "JOIN truth USING (row_id, i) WHERE m = 1)")


def gram(src: str, name: str, value: str = "x", divide: str = "1") -> str:
    return (f"{name} AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.{value} * b.{value}) / ({divide}) AS v FROM {src} a "
            f"JOIN {src} b USING (row_id) GROUP BY a.i, b.i)")


def svd_impute(iterations: int) -> str:
    c = [*fit_start(), "f0 AS MATERIALIZED (SELECT row_id, i, coalesce(x, 0) AS x FROM xs)"]
    for k in range(1, iterations + 1):
        c += [gram(f"f{k-1}", f"g{k}", divide="SELECT n - 1 FROM n1"), *eig(f"g{k}", 1, f"e{k}"),
              f"h{k} AS (SELECT row_id, sum(x * p) AS t FROM f{k-1} JOIN e{k} USING (i) GROUP BY row_id)",
              f"f{k} AS MATERIALIZED (SELECT row_id, i, coalesce(xs.x, t * p) AS x FROM xs JOIN h{k} USING (row_id) JOIN e{k} USING (i))"]
    return with_(*c) + refill(f"SELECT row_id, i, x AS h FROM f{iterations}")


def shrunk(src: str, tag: str, threshold: str, k: int, scale: str = "1.0") -> list[str]:
    """<tag>_b(i, j, v): soft-thresholding operator of a matrix whose Gram table is src, times scale squared."""
    return [*eig(src, k, tag),
            f"{tag}_b AS MATERIALIZED (SELECT x.i, y.i AS j, sum(x.p * y.p * greatest(0, 1 - ({threshold}) / (({scale}) * sqrt(x.l)))) AS v "
            f"FROM {tag} x JOIN {tag} y USING (a) GROUP BY x.i, y.i)"]


OBS0 = "f0 AS MATERIALIZED (SELECT row_id, i, coalesce(x, 0) AS x FROM xs)"


def svt() -> str:
    """Two iterations with tau = 2 sqrt(N)."""
    c = [*fit_start(), OBS0,
         "k AS MATERIALIZED (SELECT 2 * sqrt(n) AS tau, 1.2 * n * 6 / nobs AS delta, sqrt(ss) AS nrm, n FROM n1 CROSS JOIN "
         "(SELECT count(x) AS nobs, sum(x * x) AS ss FROM xs))",
         "k0 AS MATERIALIZED (SELECT *, ceil(tau / delta / nrm) * delta AS first FROM k)",
         "za AS MATERIALIZED (SELECT row_id, i, x * first AS x FROM f0 CROSS JOIN k0)",
         gram("za", "ga"), *shrunk("ga", "ea", "SELECT tau FROM k0", 2),
         "aa AS (SELECT row_id, j AS i, sum(x * v) AS a FROM za JOIN ea_b USING (i) GROUP BY row_id, j)",
         "zb AS MATERIALIZED (SELECT row_id, i, za.x + CASE WHEN xs.x IS NULL THEN 0 ELSE delta * (xs.x - a) END AS x FROM za "
         "JOIN aa USING (row_id, i) JOIN xs USING (row_id, i) CROSS JOIN k0)",
         gram("zb", "gb"), *shrunk("gb", "eb", "SELECT tau FROM k0", 3)]
    return with_(*c) + refill("SELECT row_id, j AS i, sum(x * v) AS h FROM zb JOIN eb_b USING (i) GROUP BY row_id, j")


def alm() -> str:
    """Two iterations: the first only raises the penalty, so the second thresholds D (1 + 1 / rho)."""
    c = [*fit_start(), OBS0,
         "k AS MATERIALIZED (SELECT 1.2172 + 1.8588 * nobs / (n * 6) AS rho, sqrt(ss) AS nrm FROM n1 CROSS JOIN "
         "(SELECT count(x) AS nobs, sum(x * x) AS ss FROM xs))",
         gram("f0", "ga"), *shrunk("ga", "ea", "SELECT nrm / rho FROM k", 5, "SELECT 1 + 1 / rho FROM k")]
    return with_(*c) + refill("SELECT row_id, j AS i, sum(x * v) * (SELECT 1 + 1 / rho FROM k) AS h FROM f0 "
                              "JOIN ea_b USING (i) GROUP BY row_id, j")


# -- evaluation -------------------------------------------------------------------------------------------------------

MEAN_FILLED = [OM, masked(), "av AS (SELECT " + each("avg({v}) AS {v}") + " FROM m)",
               "fl AS MATERIALIZED (SELECT m.row_id, m.t, " + each("coalesce(m.{v}, av.{v}) AS {v}") + " FROM m CROSS JOIN av)"]
ERR = "err AS (" + each("SELECT '{v}' AS variable, fl.{v} - om.{v} AS e, om.{v} AS y FROM fl JOIN om USING (row_id) "
                        "JOIN m USING (row_id) WHERE m.{v} IS NULL", " UNION ALL ") + ")"
TS = "ts AS (" + each("SELECT '{v}' AS variable, avg({v}) AS mean, stddev_pop({v}) AS std, max({v}) - min({v}) AS range FROM om",
                      " UNION ALL ") + ")"

SCALED = {v: f"(x - {MU[v]!r}) / {SIGMA[v]!r}" for v in V if SIGMA[v]} | {"x5": "(x - 4.0) / 2.0"}
FIXED_LONG = "fx AS MATERIALIZED (SELECT row_id, i, CASE i " + " ".join(
    f"WHEN {i + 1} THEN {SCALED[v]}" for i, v in enumerate(V)) + " END AS z FROM raw)"


def _fold(rep: int, n: int) -> str:
    return f"floor({u(lit(1), lit(rep // 4), 'row_id', slot=rep % 4)} * {n})::INT"


def _results() -> str:
    parts = each("SELECT floor(t / 365)::INT AS sim, substr(o_orderpriority, 1, 1)::INT AS miss_type, '{v}' AS variable, {v} AS x "
                 "FROM om JOIN orders ON o_orderkey = row_id", " UNION ALL ")
    return (f"res AS (SELECT sim, miss_type, 'MI' AS algorithm, variable, 'range' AS metric, round(max(x) - min(x), 2) AS value "
            f"FROM ({parts}) GROUP BY sim, miss_type, variable)")


def oracle_sql() -> dict[str, str]:
    num = "CASE i " + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(V)) + " END"
    q: dict[str, str] = {}
    om = with_(OM)
    q["read_matrix_days"] = "SELECT event_id, epoch_us(ts) / 8.64e10 AS t, value FROM events"
    q["minutes_to_days"] = om + f"SELECT row_id, {rnd('x1 / 1440.0', 9)} AS days FROM om"
    q["select_filter"] = om + "SELECT row_id, t, x1, x3, x5 FROM om WHERE t < 720"
    q["align_metadata"] = om + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{UNITS[v]}' AS unit, 0.0::DOUBLE AS lb, {BOUNDS[v]}::DOUBLE AS ub, max({v}) AS largest FROM om"
        for v in ("x1", "x3", "x5"))
    q["decode_sentinel"] = with_(OM, masked()) + ("SELECT row_id, CASE WHEN x1 <= 900 THEN x1 END AS x1, x5 FROM m")
    q["missing_mask"] = with_(OM, masked()) + "SELECT row_id, " + each("({v} IS NULL)::INT AS {v}") + " FROM m"
    q["drop_all_missing_rows"] = with_(OM, masked(0.7)) + (
        f"SELECT row_id, (coalesce({COLS}) IS NOT NULL)::INT AS has_values FROM m")
    q["merge_imputed"] = with_(OM, masked()) + "SELECT row_id, " + each("coalesce({v}, -1.0) AS {v}") + " FROM m"
    q["null_outliers"] = with_(*LABELLED) + "SELECT row_id, " + each(
        "CASE WHEN label_{v} <> 'outlier' THEN m.{v} END AS {v}") + " FROM lab JOIN m USING (row_id)"
    q["drop_low_quality"] = with_(*LABELLED) + "SELECT row_id, " + each(
        f"CASE WHEN {N_OBSERVED} < 5 THEN 'removed' ELSE label_{{v}} END AS label_{{v}}") + " FROM lab"
    q["keep_good_rows"] = with_(*LABELLED) + f"SELECT m.* EXCLUDE (t) FROM lab JOIN m USING (row_id) WHERE {N_OBSERVED} >= 5"
    q["relabel"] = with_(*LABELLED) + "SELECT row_id, " + each(
        "CASE label_{v} WHEN 'missing' THEN 'imputed' WHEN 'outlier' THEN 'replaced' ELSE label_{v} END AS label_{v}") + " FROM lab"
    q["protect_window"] = om + f"SELECT row_id, (t > {PROTECTED!r})::INT AS open_row FROM om"

    q["impute_mean"] = with_(OM, masked()) + "SELECT row_id, " + each(
        rnd("coalesce({v}, avg({v}) OVER ())", 4) + " AS {v}") + " FROM m"
    q["impute_mi"] = q["impute_mean"]
    q["impute_mean_by_series"] = with_(ES, MES) + (
        f"SELECT row_id, series, {rnd('coalesce(x, avg(x) OVER (PARTITION BY series))', 6)} AS x FROM me")
    q["impute_interpolate"] = with_(OM, masked(), NB_OM) + "SELECT row_id, " + ", ".join(
        f"{rnd(interpolated(v) + ' + 0.0000271828', 4)} AS {v}" for v in V) + " FROM nb"
    q["impute_interpolate_buckets"] = q["impute_interpolate"]
    q["impute_interpolate_series"] = with_(ES, MES, NB_ES) + (
        f"SELECT row_id, series, {rnd(interpolated('x'), 6)} AS x FROM nb")
    q["impute_locf"] = with_(OM, masked(), NB_OM) + "SELECT row_id, " + each("coalesce({v}, {v}_p, {v}_n) AS {v}") + " FROM nb"
    q["impute_locf_series"] = with_(ES, MES, NB_ES) + "SELECT row_id, series, coalesce(x, x_p, x_n) AS x FROM nb"
    q["gap_islands"] = with_(OM, masked()) + " UNION ALL ".join(islands("m", v, v) for v in V)
    q["gap_islands_series"] = with_(ES, MES) + islands("me", "x", "x", "series")

    q["autoscale"] = om + "SELECT row_id, " + each(rnd("({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER ()", 6) + " AS {v}") + " FROM om"
    q["standardize_pop"] = with_(*MEAN_FILLED) + "SELECT row_id, " + each(
        rnd("({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER ()", 6) + " AS {v}") + " FROM fl"
    q["mean_center"] = om + "SELECT row_id, " + each(rnd("{v} - avg({v}) OVER ()", 4) + " AS {v}") + " FROM om"
    q["scale_by"] = om + "SELECT row_id, " + ", ".join(
        f"{rnd(f'({v} - {MU[v]!r}) / {SIGMA[v]!r}', 8) if SIGMA[v] else '0.0::DOUBLE'} AS {v}" for v in V) + " FROM om"
    q["scale_rescale_roundtrip"] = om + "SELECT row_id, " + ", ".join(
        f"{rnd(v, 4) if SIGMA[v] else repr(MU[v]) + '::DOUBLE'} AS {v}" for v in V) + " FROM om"
    q["normalize_roundtrip"] = with_(OM, masked()) + "SELECT row_id, " + each(rnd("{v}", 4) + " AS {v}") + " FROM m"
    q["soft_threshold_cells"] = om + ", z AS (SELECT row_id, ".replace(", z", ", zz", 1) + each(
        "({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS {v}") + " FROM om) SELECT row_id, " + each(
        rnd("sign({v}) * greatest(abs({v}) - 0.5, 0)", 6) + " AS {v}") + " FROM zz"
    q["project_observed"] = with_(OM, masked()) + "SELECT row_id, " + each("coalesce({v}, 0.0) AS {v}") + " FROM m"

    q["covariance"] = with_(OM, long("om", "raw"), FIXED_LONG) + (
        f"SELECT {num.replace('CASE i', 'CASE a.i')} AS variable_i, {num.replace('CASE i', 'CASE b.i')} AS variable_j, "
        f"{rnd('covar_samp(a.z, b.z)', 6)} AS covariance FROM fx a JOIN fx b USING (row_id) GROUP BY a.i, b.i")
    q["covariance_by_nation"] = with_(OM, long("om", "raw"), FIXED_LONG, (
        "keyed AS (SELECT c_nationkey, row_id, i, z FROM fx JOIN orders ON o_orderkey = row_id "
        "JOIN customer ON c_custkey = o_custkey)")) + (
        f"SELECT a.c_nationkey, {num.replace('CASE i', 'CASE a.i')} AS variable_i, {num.replace('CASE i', 'CASE b.i')} AS variable_j, "
        f"{rnd('covar_samp(a.z, b.z)', 6)} AS covariance FROM keyed a JOIN keyed b USING (row_id) GROUP BY a.c_nationkey, a.i, b.i")
    q["repeated_kfold"] = om + f"SELECT row_id, {', '.join(f'{_fold(r, 5)} AS fold_{r}' for r in range(3))} FROM om"
    q["moments_by_fold"] = with_(OM, long("om", "raw"), FIXED_LONG) + " UNION ALL ".join(
        f"SELECT {r} AS rep, f AS fold, {num} AS variable, count(*) AS n, {rnd('avg(z)', 6)} AS mean, "
        f"{rnd('covar_samp(z, z1)', 6)} AS cov_x1 FROM (SELECT b.row_id, b.i, b.z, a.z AS z1, {_fold(r, 5).replace('row_id', 'b.row_id')} AS f "
        "FROM fx b JOIN fx a ON a.row_id = b.row_id AND a.i = 1) GROUP BY f, i" for r in range(2))

    model = [OM, *pca()]
    q["pca_loadings"] = with_(*model) + (
        f"SELECT {num} AS variable, {rnd('max(CASE WHEN a = 1 THEN p END)', 6)} AS p1, "
        f"{rnd('max(CASE WHEN a = 2 THEN p END)', 6)} AS p2 FROM pc GROUP BY i")
    q["pca_scores"] = with_(*model) + (
        f"SELECT row_id, {rnd('max(CASE WHEN a = 1 THEN t END)', 5)} AS score_1, "
        f"{rnd('max(CASE WHEN a = 2 THEN t END)', 5)} AS score_2 FROM score GROUP BY row_id")
    q["score_variance"] = with_(*model) + f"SELECT a AS component, {rnd('s2', 6)} AS score_variance FROM sg"
    q["explained_variance"] = with_(*model) + (
        f"SELECT component, {rnd('ev', 6)} AS explained, {rnd('sum(ev) OVER (ORDER BY component)', 6)} AS cumulative FROM "
        "(SELECT DISTINCT a AS component, l / (SELECT sum(v) FROM cor WHERE i = j) AS ev FROM pc)")
    q["reconstruct_residual"] = with_(*model, RESID) + "SELECT row_id, " + each(
        f"max(CASE WHEN i = {{i}} THEN {rnd('rec', 5)} END) AS reconstruction_{{v}}") + ", " + each(
        f"max(CASE WHEN i = {{i}} THEN {rnd('e', 5)} END) AS residual_{{v}}") + " FROM resid GROUP BY row_id"
    q["residual_sse_by_a"] = with_(*model, (
        "ra AS (SELECT k.a, z.row_id, z.i, any_value(z.z) - sum(t * p) AS e FROM z JOIN score USING (row_id) JOIN pc ON pc.i = z.i AND "
        "pc.a = score.a JOIN (SELECT unnest([1, 2]) AS a) k ON score.a <= k.a GROUP BY k.a, z.row_id, z.i)")) + (
        f"SELECT a AS component, {rnd('sum(e * e)', 4)} AS sse, {rnd('avg(e)', 4)} AS bias, "
        f"{rnd('sqrt((sum(e * e) - count(*) * avg(e) * avg(e)) / ((SELECT n FROM n1) - 1))', 4)} AS se FROM ra GROUP BY a")
    q["pca_dual"] = with_(
        "lg AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i "
        "FROM embeddings) GROUP BY label, i)",
        "ce AS MATERIALIZED (SELECT label AS row_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM lg)",
        gram("ce", "gg"), *eig("gg", 1, "dp", rounds=16)) + (
        f"SELECT 'e' || (i - 1) AS variable, {rnd('p', 6)} AS loading_1 FROM dp")
    q["hotelling_t2"] = with_(*model, T2) + f"SELECT row_id, {rnd('t2', 5)} AS T_sq FROM t2"
    q["sre"] = with_(*model, RESID, SRE) + f'SELECT row_id, {rnd("sre", 5)} AS "SRE" FROM sre'
    q["row_limits"] = with_(*model, RESID, T2, SRE, BOX) + (
        f"SELECT {rnd(chr(40) + 'SELECT lim FROM lims WHERE what = ' + lit('t2') + ')', 5)} AS lim_T_sq, "
        f"{rnd(chr(40) + 'SELECT lim FROM lims WHERE what = ' + lit('sre') + ')', 5)} AS lim_SRE")
    q["row_control_chart"] = with_(*model, RESID, T2, SRE, BOX) + (
        f'SELECT row_id, {rnd("t2", 5)} AS T_sq, {rnd("sre", 5)} AS "SRE" FROM t2 JOIN sre USING (row_id) WHERE '
        "t2 > (SELECT lim FROM lims WHERE what = 't2') OR sre > (SELECT lim FROM lims WHERE what = 'sre')")
    for name, kind in (("simple", "simple"), ("absolute", "absolute"), ("chiang", "2D-Chiang"), ("alcala", "2D-Alcala")):
        q[f"contrib_{name}"] = with_(*model, *contributions(kind)) + (
            f"SELECT row_id, {num} AS variable, {rnd('ct', 5)} AS t2_con, {rnd('cq', 5)} AS q_con FROM con")
    tail = f"SELECT {num} AS variable, {rnd('lt', 5)} AS lim_T_sq_con, {rnd('lq', 5)} AS lim_SRE_con FROM clim"
    q["limits_norm"] = with_(*model, *contributions("simple"), *limits("simple", "norm", LIM)) + tail
    q["limits_norm_chiang"] = with_(*model, *contributions("2D-Chiang"), *limits("2D-Chiang", "norm", LIM)) + tail
    q["limits_t"] = with_(*model, *contributions("2D-Chiang"), *t_limit(LIM)) + tail
    q["limits_alcala"] = with_(*model, *limits("2D-Alcala", "2D-Alcala", LIM)) + tail

    q["press_table"] = with_(OM, *PRESS5) + f"SELECT f AS split, a::INT AS component, {rnd('press', 3)} AS press FROM pr"
    q["drop_outlier_splits"] = with_(OM, *PRESS5) + (
        "SELECT split, component, press FROM (SELECT f AS split, a::INT AS component, " + rnd("press", 3)
        + " AS press, bool_and(over_) OVER (PARTITION BY f) AS gone FROM (SELECT *, press > avg(press) OVER (PARTITION BY a) + "
        f"{norm_ppf(0.75)!r} * stddev_pop(press) OVER (PARTITION BY a) AS over_ FROM pr)) WHERE NOT gone")
    q["one_se_choice"] = with_(OM, *PRESS5, (
        "pa AS (SELECT a, avg(press) AS m, stddev_samp(press) / sqrt(count(*)) AS se FROM pr GROUP BY a)")) + (
        "SELECT min(a)::INT AS component FROM pa WHERE m < (SELECT min_by(m + se, m) FROM pa) OR m = (SELECT min(m) FROM pa)")
    q["rmsecv"] = with_(OM, *press(7, 11, "stddev_pop")) + (
        f"SELECT a::INT AS component, {rnd('sqrt(sum(press) / (SELECT count(*) FROM om))', 6)} AS rmsecv FROM pr GROUP BY a")

    q["argmin_rmsecv"] = with_(OM, *press(7, 11, "stddev_pop", 5)) + (
        "SELECT arg_min(a, s)::INT AS component FROM (SELECT a, sum(press) AS s FROM pr GROUP BY a)")
    # the deflation by the last component leaves nothing and is skipped, so its PRESS repeats the one before
    q["select_components"] = with_(OM, *press(5, 0, "stddev_samp", 5, 10), (
        "pall AS (SELECT * FROM pr UNION ALL SELECT f, 6, press FROM pr WHERE a = 5)"), (
        f"over_ AS (SELECT f, a, press, press > avg(press) OVER (PARTITION BY a) + {norm_ppf(0.999)!r} * stddev_pop(press) "
        "OVER (PARTITION BY a) AS o FROM pall)"), (
        "used AS (SELECT a, press FROM (SELECT *, bool_and(o) OVER (PARTITION BY f) AS gone FROM over_) WHERE NOT gone)"), (
        "pa AS (SELECT a, avg(press) AS m, stddev_samp(press) / sqrt(count(*)) AS se FROM used GROUP BY a)")) + (
        "SELECT min(a)::INT AS component FROM pa WHERE m < (SELECT min_by(m + se, m) FROM pa) OR m = (SELECT min(m) FROM pa)")
    q["holdout_reestimate"] = holdout(4, 0.02)
    q["max_components"] = om + (
        f"SELECT c_nationkey, k AS n_splits, least(floor(n * (1 - 1.0 / k)), {len(V)}, coalesce(ub, {len(V)}))::INT AS components FROM (SELECT c_nationkey, count(*) AS n "
        "FROM om JOIN orders ON o_orderkey = row_id JOIN customer ON c_custkey = o_custkey WHERE t < 60 GROUP BY c_nationkey) CROSS JOIN (VALUES (2, NULL), (5, NULL), (7, 4)) s(k, ub)")
    q["rapidity"] = "SELECT * FROM (VALUES ('MI', false), ('Alternating', true), ('ALM', true)) t(algorithm, measured)"

    spiked_model = [OM, spiked(), *pca("sp")]
    q["flag_cells"] = with_(*spiked_model, *contributions("2D-Chiang"), *limits("2D-Chiang", "norm", FLAG_LIM)) + (
        f"SELECT row_id, {num} AS variable FROM con JOIN clim USING (i) JOIN sp USING (row_id) "
        f"WHERE (abs(ct) > lt OR abs(cq) > lq) AND t > {PROTECTED!r}")
    q["count_new_outliers"] = with_(*spiked_model, *contributions("2D-Alcala"), *limits("2D-Alcala", "2D-Alcala", FLAG_LIM)) + (
        "SELECT count(*) AS n_outliers FROM con JOIN clim USING (i) JOIN sp USING (row_id) "
        f"WHERE (abs(ct) > lt OR abs(cq) > lq) AND t > {PROTECTED!r}")
    sets = [
        "old AS MATERIALIZED (" + each(f"SELECT row_id, '{{v}}' AS variable FROM om WHERE {u(lit(7), 'row_id', lit('{v}'))} < 0.02", " UNION ALL ") + ")",
        "new AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT row_id, '{v}' AS variable FROM om WHERE {v} > {MU[v] * 1.8!r}" for v in V) + ")",
        f"parts AS MATERIALIZED (SELECT row_id, variable, 'new' AS part FROM (SELECT * FROM new EXCEPT SELECT * FROM old) JOIN om USING (row_id) WHERE t > {PROTECTED!r} "
        f"UNION ALL SELECT row_id, variable, 'old' FROM old JOIN om USING (row_id) WHERE t > {PROTECTED!r})"]
    q["outlier_sets"] = with_(OM, *sets) + "SELECT row_id, variable, part FROM parts"
    q["normal_cells"] = with_(OM, masked(), *sets) + (
        "SELECT variable, count(*) AS n FROM (" + each(
            "SELECT row_id, '{v}' AS variable FROM m WHERE {v} IS NOT NULL", " UNION ALL ")
        + ") c WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.row_id = c.row_id AND p.variable = c.variable) GROUP BY variable")

    q["impute_alternating"] = alternating(3)
    q["impute_svd"] = svd_impute(2)
    q["impute_ppca"] = ppca(3)
    q["impute_ppcam"] = ppcam(3)
    q["impute_bpca"] = bpca(3)
    q["impute_svt"] = svt()
    q["impute_alm"] = alm()

    q["inject_mcar"] = om + "SELECT row_id, " + each(
        f"CASE WHEN {u(lit(3), lit(0), 'row_id', lit('{v}'))} >= 0.1 THEN {{v}} END AS {{v}}") + " FROM om"
    pos = "pos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, row_id) - 1 AS pos FROM om)"
    key = [lit(5), lit(0), "e"]
    q["inject_dropout"] = with_(OM, pos, "n1 AS (SELECT count(*) AS n FROM om)", (
        f"ev AS (SELECT floor({u(*key, lit('sensor'))} * 6)::INT + 1 AS i, floor({u(*key, lit('start'))} * n)::BIGINT AS s, "
        f"floor({u(*key, lit('length'))} * 10)::BIGINT + 1 AS l FROM n1, unnest(range(n // 10)) r(e))"),
        "hit AS (SELECT DISTINCT row_id, i FROM pos JOIN ev ON pos.pos BETWEEN ev.s AND ev.s + ev.l - 1)",
        "hits AS (SELECT row_id, list(i) AS h FROM hit GROUP BY row_id)") + "SELECT row_id, " + each(
        "CASE WHEN NOT coalesce(list_contains(h, {i}), false) THEN {v} END AS {v}") + " FROM om LEFT JOIN hits USING (row_id)"
    q["inject_multirate"] = with_(OM, pos) + (
        "SELECT row_id, CASE WHEN pos % 3 <> 0 THEN x1 END AS x1, x2, x3, CASE WHEN pos % 4 = 0 THEN x4 END AS x4, x5, "
        "CASE WHEN pos % 2 <> 0 THEN x6 END AS x6 FROM pos")
    q["inject_multirate_series"] = with_(ES) + (
        "SELECT row_id, series, CASE WHEN pos % (2 + series % 4) <> 0 THEN x END AS x FROM (SELECT *, row_number() OVER "
        "(PARTITION BY series ORDER BY t, row_id) - 1 AS pos FROM es)")
    q["inject_censoring"] = om + (
        f"SELECT row_id, CASE WHEN x1 <= {MU['x1'] * 1.5!r} THEN x1 END AS x1, x2, CASE WHEN x3 >= {MU['x3'] * 0.3!r} THEN x3 END AS x3, "
        "x4, x5, x6 FROM om")
    hit = f"{u(lit(9), lit(0), 'row_id', lit('row'))} < 0.25"
    q["inject_patterned"] = om + "SELECT row_id, " + ", ".join(
        f"CASE WHEN NOT ({hit}) THEN {v} END AS {v}" if v in ("x2", "x4", "x5") else v for v in V) + " FROM om"
    q["missing_rate"] = with_(OM, masked()) + (
        f"SELECT {rnd('sum(' + each('({v} IS NULL)::INT', ' + ') + ') / (count(*) * 6.0)', 9)} AS missing_rate FROM m")
    q["row_positions"] = with_(OM, pos) + "SELECT row_id, pos FROM pos"

    q["truth_stats"] = with_(OM, TS) + f"SELECT variable, {rnd('mean', 3)} AS mean, {rnd('std', 3)} AS std, {rnd('range', 3)} AS range FROM ts"
    q["nrmse_variable"] = with_(*MEAN_FILLED, ERR, TS) + (
        f"SELECT variable, {rnd('sqrt(avg(e * e / (std * std)))', 6)} AS nrmse FROM err JOIN ts USING (variable) GROUP BY variable")
    q["nrmse_range"] = with_(*MEAN_FILLED, ERR, TS) + (
        f"SELECT variable, {rnd('sqrt(avg(e * e / (range * range)))', 6)} AS nrmse FROM err JOIN ts USING (variable) GROUP BY variable")
    q["nrmse_overall"] = with_(*MEAN_FILLED, ERR, TS) + (
        f"SELECT {rnd('sqrt(avg(e * e / (std * std)))', 6)} AS nrmse FROM err JOIN ts USING (variable)")
    q["missing_nrmse"] = with_(*MEAN_FILLED, ERR) + (
        f"SELECT {rnd('sqrt(avg(e * e)) / stddev_samp(y)', 5)} AS nrmse, {rnd('sqrt(avg(e * e))', 5)} AS rmse FROM err")
    q["feasibility"] = with_(OM, masked()) + "SELECT sum(" + " + ".join(
        f"(m.{v} IS NULL AND (CASE WHEN om.x5 > 4 THEN om.{v} * 1.5 ELSE om.{v} - 100.0 END NOT BETWEEN 0 AND {BOUNDS[v]}))::INT"
        for v in V) + ")::BIGINT AS feasibility FROM om JOIN m USING (row_id)"
    q["plausibility"] = with_(*MEAN_FILLED, spiked(0.01, 11, "sp", "fl"), *pca("sp"), *contributions("2D-Chiang"),
                              *limits("2D-Chiang", "norm", FLAG_LIM), long("m", "ml")) + (
        "SELECT count(*) AS plausibility FROM con JOIN clim USING (i) JOIN ml USING (row_id, i) "
        "WHERE ml.x IS NULL AND (abs(ct) > lt OR abs(cq) > lq)")
    q["label_counts"] = with_(*LABELLED, LAB_LONG) + "SELECT variable, label, count(*) AS n FROM ll GROUP BY CUBE (variable, label)"
    q["before_after"] = with_(*LABELLED, LAB_LONG, (
        "mn AS (SELECT variable, avg(CASE WHEN label = 'observed' THEN value END) AS mean FROM ll GROUP BY variable)")) + (
        "SELECT row_id, variable, CASE label WHEN 'missing' THEN 'imputed' ELSE 'replaced' END AS label, value AS before, "
        f"{rnd('mean', 4)} AS after FROM ll JOIN mn USING (variable) WHERE label <> 'observed'")
    q["cells_long"] = with_(*LABELLED, LAB_LONG) + "SELECT row_id, t, variable, value, label FROM ll"
    q["write_read_results"] = with_(OM, _results()) + "SELECT sim, miss_type, algorithm, variable, metric, value FROM res"
    q["summarise_results"] = with_(OM, _results()) + (
        f"SELECT miss_type, algorithm, variable, 'nrmse' AS metric, {rnd('avg(nullif(value, 0))', 3)} AS mean, "
        f"{rnd('stddev_pop(nullif(value, 0))', 3)} AS std, count(nullif(value, 0)) AS n, "
        f"{rnd('least(avg(nullif(value, 0)), stddev_pop(nullif(value, 0)))', 3)} AS lower FROM res GROUP BY miss_type, algorithm, variable")
    return q
