"""Text of the SQL each registered query is checked against.

Plain views of the same tables, plus generators for the parts SQL has no
words for: Newton steps and k x k algebra written out element by element.
"""

from __future__ import annotations

from ..specs import ModelSpec

ATTEMPTS = """
attempts AS MATERIALIZED (
  SELECT b.*, max(CASE WHEN done THEN attempt END) OVER (PARTITION BY case_id) AS success,
    count(CASE WHEN done THEN 1 END) OVER (PARTITION BY case_id) AS n_success,
    max(CASE WHEN done THEN attempt END) OVER (PARTITION BY case_id) IS NOT NULL AS interview
  FROM (
    SELECT r_name AS cntry, CAST(year(o_orderdate) AS INTEGER) AS round,
      r_name || '-' || CAST(year(o_orderdate) AS VARCHAR) AS cntry_round,
      l_orderkey AS case_id,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
        l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS attempt,
      l_shipdate AS time, l_returnflag = 'R' AS done,
      CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Industry' ELSE 'Household' END AS seg,
      CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS site,
      CASE WHEN c_acctbal < 2500 THEN 'Barriers' ELSE 'No barriers' END AS barrier,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High'
        WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS prio,
      o_orderstatus AS status, c_mktsegment AS segment, o_totalprice AS price, c_acctbal AS balance
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  ) b
)"""

PROGRESS = ATTEMPTS + """,
sequenced AS (
  SELECT *, row_number() OVER (PARTITION BY cntry_round ORDER BY time, case_id, attempt) AS attempt_number,
    count(*) OVER (PARTITION BY cntry_round) AS n
  FROM attempts
),
progress AS MATERIALIZED (
  SELECT *, attempt_number / CAST(n AS DOUBLE) AS attempt_pct,
    attempt_number / CAST(n AS DOUBLE) < 0.5 AS attempt_first50pct,
    attempt_number / CAST(n AS DOUBLE) < 0.6 AS attempt_first60pct,
    attempt_number / CAST(n AS DOUBLE) < 0.7 AS attempt_first70pct,
    attempt_number / CAST(n AS DOUBLE) < 0.8 AS attempt_first80pct,
    coalesce(success <= attempt, false) AS status_final,
    coalesce(success <= attempt, false) AND attempt_number / CAST(n AS DOUBLE) < 0.7 AS status_70pct
  FROM sequenced
)"""

CASES = PROGRESS + """,
cases AS MATERIALIZED (
  SELECT l.*, CAST(coalesce(e.attempt, 0) AS INTEGER) AS attempt_number_70pct
  FROM (SELECT * FROM progress
        QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY time DESC, attempt) = 1) l
  LEFT JOIN (SELECT case_id, attempt FROM progress WHERE attempt_first70pct
        QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY time DESC, attempt) = 1) e
    USING (case_id)
)"""

PREVIOUS = """
previous AS (
  SELECT cntry, round, lag(round) OVER (PARTITION BY cntry ORDER BY round) AS previous
  FROM (SELECT DISTINCT cntry, round FROM cases)
)"""


def breaks(source: str, group: str, score: str, bins: int = 20) -> str:
    """CTEs ending in br(group, breaks): merged quantile edges at exact ranks (m - 1) i / bins."""
    h = f"CAST((m - 1) * i AS DOUBLE) / {bins}"
    return f"""
bo AS (SELECT {group}, {score} AS s, row_number() OVER (PARTITION BY {group} ORDER BY {score}) - 1 AS k,
  count(*) OVER (PARTITION BY {group}) AS m FROM {source} WHERE {score} IS NOT NULL),
be AS (SELECT {group}, i, max(CASE WHEN k = floor({h}) THEN s END) AS lo, max(CASE WHEN k = ceil({h}) THEN s END) AS hi,
  max({h} - floor({h})) AS frac FROM bo, range(0, {bins + 1}) t(i) GROUP BY {group}, i),
br AS (SELECT {group}, list_sort(list_distinct(list(lo + (hi - lo) * frac))) AS breaks FROM be GROUP BY {group})"""


def tie(seed: str, key: str = "case_id") -> str:
    """The random order of a case under a seed."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"


def columns(spec: ModelSpec) -> list[tuple[str, str]]:
    """(term, SQL) of the non-reference design columns, intercept first."""
    ref = {m.name: m.values[0] for m in spec.main}
    out = []
    for c in spec.coordinates():
        if c.kind == "intercept":
            out.append((c.term, "1.0"))
        elif c.kind == "numeric":
            out.append((c.term, f"CAST({c.names[0]} AS DOUBLE)"))
        elif all(ref[n] != v for n, v in zip(c.names, c.levels)):
            test = " AND ".join(f"{n} = '{v}'" for n, v in zip(c.names, c.levels))
            out.append((c.term, f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"))
    return out


def _h(i: int, j: int) -> str:
    return f"h{min(i, j)}_{max(i, j)}"


def _sweep(name: str, source: str, by: str, size: int, pivots: int) -> tuple[str, str]:
    """Sweep the first ``pivots`` pivots of a symmetric matrix kept as columns h<i>_<j>."""
    ctes, last = [], source
    for p in range(pivots):
        d = f"h{p}_{p}"
        cols = []
        for i in range(size):
            for j in range(i, size):
                if i == p and j == p:
                    e = f"-1.0 / {d}"
                elif i == p or j == p:
                    e = f"{_h(i, j)} / {d}"
                else:
                    e = f"{_h(i, j)} - {_h(i, p)} * {_h(j, p)} / {d}"
                cols.append(f"{e} AS {_h(i, j)}")
        step = f"{name}_s{p}"
        ctes.append(f"{step} AS (SELECT {by}, {', '.join(cols)} FROM {last})")
        last = step
    return ",\n".join(ctes), last


def newton(name: str, cells: str, by: str, spec: ModelSpec, steps: int = 9) -> str:
    """CTEs fitting a logistic model per group of ``cells`` (columns n, y, covariates).

    Leaves ``<name>``: by, b<i> and the covariance v<i>_<j> (i <= j); and
    ``<name>_x``: the cells with design columns x<i>.
    """
    cols = columns(spec)
    k = len(cols)
    x = ", ".join(f"{e} AS x{i}" for i, (_, e) in enumerate(cols))
    ctes = [f"{name}_x AS MATERIALIZED (SELECT *, {x} FROM {cells})"]
    zero = ", ".join(f"0.0 AS b{i}" for i in range(k))
    state = f"{name}_b0"
    ctes.append(f"{state} AS (SELECT DISTINCT {by}, {zero} FROM {cells})")
    for t in range(steps):
        eta = " + ".join(f"b{i} * x{i}" for i in range(k))
        ctes.append(
            f"{name}_m{t} AS (SELECT c.*, {', '.join(f'b{i}' for i in range(k))}, "
            f"1 / (1 + exp(-({eta}))) AS mu FROM {name}_x c JOIN {state} USING ({by}))"
        )
        sums = [
            f"sum(n * mu * (1 - mu) * x{i} * x{j}) AS {_h(i, j)}"
            for i in range(k) for j in range(i, k)
        ]
        sums += [f"sum((y - n * mu) * x{i}) AS {_h(i, k)}" for i in range(k)]
        betas = ", ".join(f"max(b{i}) AS b{i}" for i in range(k))
        agg = f"{name}_h{t}"
        ctes.append(
            f"{agg} AS MATERIALIZED (SELECT {by}, {betas}, {', '.join(sums)}, 0.0 AS {_h(k, k)} "
            f"FROM {name}_m{t} GROUP BY {by})"
        )
        swept, last = _sweep(f"{name}_{t}", agg, by, k + 1, k)
        ctes.append(swept)
        final = t == steps - 1
        state = name if final else f"{name}_b{t + 1}"
        out = [f"a.b{i} + {'0.0 * ' if final else ''}s.{_h(i, k)} AS b{i}" for i in range(k)]
        if final:
            out += [f"-s.{_h(i, j)} AS v{i}_{j}" for i in range(k) for j in range(i, k)]
        ctes.append(
            f"{state} AS MATERIALIZED (SELECT {by}, {', '.join(out)} "
            f"FROM {agg} a JOIN {last} s USING ({by}))"
        )
    return ",\n".join(ctes)


def _v(i: int, j: int) -> str:
    return f"v{min(i, j)}_{max(i, j)}"


def predicted(name: str, spec: ModelSpec) -> str:
    eta = " + ".join(f"b{i} * x{i}" for i in range(len(columns(spec))))
    return f"1 / (1 + exp(-({eta})))"


def quad(k: int, a: str) -> str:
    """a' V a for columns <a><i>."""
    return " + ".join(f"{a}{i} * {a}{j} * {_v(i, j)}" for i in range(k) for j in range(k))


def square(k: int, b: str) -> str:
    """tr(B V B V) for symmetric B with columns <b><i>_<j>; needs bv<i>_<j> (see bv)."""
    return " + ".join(f"bv{i}_{j} * bv{j}_{i}" for i in range(k) for j in range(k))


def bv(k: int, b: str) -> str:
    """Columns of the product B V."""
    return ", ".join(
        "(" + " + ".join(f"{b}{min(i, m)}_{max(i, m)} * {_v(m, j)}" for m in range(k)) + f") AS bv{i}_{j}"
        for i in range(k) for j in range(k)
    )


def indicator(
    name: str, cells: str, by: str, spec: ModelSpec, steps: int = 9, total: str = "",
) -> str:
    """CTEs ending in ``<name>_ind``: the indicators of cells.

    ``cells`` has n and y on the scale the model is fitted on.  With weights it
    also has w (sum of weights) and ``total`` names a table (by, vp, vq, rows)
    of design variances and row counts; without, w is n and both are zero.
    """
    k = len(columns(spec))
    w = "w" if total else "n"
    fit = newton(name, cells, by, spec, steps)
    z = ", ".join(f"p * (1 - p) * x{i} AS z{i}" for i in range(k))
    moments = [f"sum({w} * z{i}) / sum({w}) AS mz{i}" for i in range(k)]
    moments += [f"sum({w} * z{i} * (p - pm)) / sum({w}) AS a{i}" for i in range(k)]
    moments += [
        f"sum({w} * z{i} * z{j}) / sum({w}) AS m{i}_{j}" for i in range(k) for j in range(i, k)
    ]
    b = ", ".join(f"m{i}_{j} - mz{i} * mz{j} AS c{i}_{j}" for i in range(k) for j in range(i, k))
    lam = " + ".join(
        f"m{min(i, j)}_{max(i, j)} * {_v(i, j)}" for i in range(k) for j in range(k)
    )
    extra = f"JOIN {total} USING ({by})" if total else ""
    design = "vp, vq, rows" if total else "0.0 AS vp, 0.0 AS vq, pop AS rows"
    return f"""{fit},
{name}_p AS (SELECT *, {predicted(name, spec)} AS p FROM {name}_x JOIN {name} USING ({by})),
{name}_q AS MATERIALIZED (SELECT *, {z}, sum({w} * p) OVER (PARTITION BY {by}) / sum({w}) OVER (PARTITION BY {by}) AS pm FROM {name}_p),
""" + ("{TOTALS}" if total else "") + f"""{name}_mom AS MATERIALIZED (SELECT {by}, sum({w}) AS pop, max(pm) AS pm, sum({w} * (p - pm) * (p - pm)) AS ss,
  {', '.join(moments)} FROM {name}_q GROUP BY {by}),
{name}_cov AS MATERIALIZED (SELECT *, {b} FROM {name}_mom JOIN {name} USING ({by})),
{name}_bv AS MATERIALIZED (SELECT *, {bv(k, 'c')} FROM {name}_cov),
{name}_des AS (SELECT *, {design} FROM {name}_bv {extra}),
{name}_var AS (SELECT {by}, pop, rows, pm, ss / (pop - 1) AS s2, {lam} - vp / (pop * pop) AS bias,
  (4 * ({quad(k, 'a')}) + 2 * ({square(k, 'c')}) + vq / (pop * pop)) / (ss / pop) AS r_var FROM {name}_des),
{name}_ind AS (SELECT {by}, pop, rows, pm AS prop_mean, s2, r_var,
  CASE WHEN bias > s2 THEN 0.0 ELSE 1 - bias / s2 END AS bias_factor FROM {name}_var)"""


def indicator_columns() -> str:
    """Rounded public columns from an ``_ind`` table."""
    adj = "sqrt(s2 * bias_factor)"
    cv = f"{adj} / prop_mean"
    return (
        f"CAST(rows AS BIGINT) AS n_obs, round(prop_mean, 6) AS prop_mean, "
        f"round(1 - 2 * {adj}, 6) AS r, round(1 - 2 * sqrt(s2), 6) AS r_unadj, "
        f"round(sqrt(r_var), 6) AS r_se, round(bias_factor, 6) AS bias_factor, "
        f"round({cv}, 6) AS cv, round(sqrt(s2) / prop_mean, 6) AS cv_unadj, "
        f"round(sqrt(0.25 * r_var / pow(prop_mean, 2) + pow({cv}, 4) / rows), 6) AS cv_se"
    )


def one_factor(name: str, cells: str, by: str) -> str:
    """Closed form for a saturated model: ``cells`` has by, category, n, y; unit weights."""
    return f"""
{name}_c AS (SELECT {by}, category, n, y / n AS p, y / n * (1 - y / n) AS v,
  sum(n) OVER (PARTITION BY {by}) AS pop,
  sum(y) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by}) AS pm FROM {cells}),
{name}_s AS (SELECT {by}, max(pop) AS pop, max(pm) AS pm, sum(n * (p - pm) * (p - pm)) AS ss, sum(v) / max(pop) AS bias,
  4 * sum(n * v * (p - pm) * (p - pm)) / pow(max(pop), 2)
  + 2 * (sum(pow(v / pop, 2) * pow(1 - n / pop, 2)) + (pow(sum(n * v), 2) - sum(pow(n * v, 2))) / pow(max(pop), 4)) AS top
  FROM {name}_c GROUP BY {by}),
{name}_ind AS (SELECT {by}, pop, pop AS rows, pm AS prop_mean, ss / (pop - 1) AS s2, top / (ss / pop) AS r_var,
  CASE WHEN bias > ss / (pop - 1) THEN 0.0 ELSE 1 - bias / (ss / (pop - 1)) END AS bias_factor FROM {name}_s)"""


def conditional(name: str, by: str, spec: ModelSpec, variables: list[str]) -> str:
    """CTEs after ``indicator(name, ...)``: ``<name>_pc`` (by, variable, category, ss, se, pop)."""
    k = len(columns(spec))
    parts = []
    for t, v in enumerate(variables):
        others = ", ".join(o for o in spec.factors if o != v)
        peers = f"(PARTITION BY {by}{', ' + others if others else ''})"
        dz = ", ".join(
            f"z{i} - sum(n * z{i}) OVER {peers} / sum(n) OVER {peers} AS dz{i}" for i in range(k)
        )
        sums = [f"sum(n * d * dz{i}) AS da{i}" for i in range(k)]
        sums += [f"sum(n * dz{i} * dz{j}) AS db{i}_{j}" for i in range(k) for j in range(i, k)]
        ref = f"{name}_k{t}"
        parts.append(f"""
{ref}_d AS MATERIALIZED (SELECT {by}, {v} AS category, n,
  p - sum(n * p) OVER {peers} / sum(n) OVER {peers} AS d, {dz} FROM {name}_q),
{ref}_a AS MATERIALIZED (SELECT {by}, category, sum(n * d * d) AS ss, {', '.join(sums)} FROM {ref}_d GROUP BY {by}, category),
{ref}_v AS MATERIALIZED (SELECT * FROM {ref}_a JOIN {name} USING ({by})),
{ref}_b AS MATERIALIZED (SELECT *, {bv(k, 'db')} FROM {ref}_v),
{ref} AS (SELECT {by}, '{v}' AS variable, category, ss,
  0.25 * (4 * ({quad(k, 'da')}) + 2 * ({square(k, 'db')})) AS top FROM {ref}_b)""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_k{t}" for t in range(len(variables)))
    return ",".join(parts) + f""",
{name}_pc AS (SELECT u.*, pop, prop_mean, bias_factor, sqrt(top / (pop * ss)) AS se
  FROM ({union}) u JOIN {name}_ind USING ({by}))"""


def unconditional(name: str, by: str, variables: list[str]) -> str:
    """CTEs after ``indicator(name, ...)``: ``<name>_pu`` by category, ``<name>_puv`` by variable."""
    cats = "\nUNION ALL ".join(
        f"SELECT {by}, '{v}' AS variable, {v} AS category, sum(n) AS nk, sum(n * p) / sum(n) AS pk, "
        f"sum(y) AS yk, max(pm) AS pm FROM {name}_q GROUP BY {by}, {v}" for v in variables
    )
    return f"""
{name}_pu AS MATERIALIZED (SELECT u.*, pop, bias_factor, nk * (pk - pm) * (pk - pm) / pop AS part
  FROM ({cats}) u JOIN {name}_ind USING ({by})),
{name}_pk AS (SELECT {by} || '~' || variable AS bv, category, nk AS n, yk AS y FROM {name}_pu),
{one_factor(name + "_of", name + "_pk", "bv")},
{name}_puv AS (SELECT {by}, variable, max(prop_mean) AS prop_mean, sqrt(sum(part)) AS pu_unadj,
  sqrt(sum(part) * max(bias_factor)) AS pu, max(se) AS pu_se
  FROM (SELECT {name}_pu.*, i.prop_mean, 0.5 * sqrt(o.r_var) AS se FROM {name}_pu
    JOIN {name}_ind i USING ({by}) JOIN {name}_of_ind o ON o.bv = {by} || '~' || variable)
  GROUP BY {by}, variable)"""


def weighted_partials(name: str, by: str, spec: ModelSpec, variables: list[str], cases: str) -> str:
    """CTEs after a weighted ``indicator(name, ...)`` under stratified sampling.

    ``cases`` has one row per case: by, status (stratum), wt, the variables and
    the cell's p, pm and z<i>.  Leaves ``<name>_wp``, one row per category.
    """
    k = len(columns(spec))
    parts = []
    for t, v in enumerate(variables):
        others = ", ".join(o for o in spec.factors if o != v)
        peers = f"(PARTITION BY {by}, {others})"
        centred = ", ".join(
            f"z{i} - sum(wt * z{i}) OVER {peers} / sum(wt) OVER {peers} AS dz{i}" for i in range(k)
        )
        sums = [f"sum(wt * d * dz{i}) AS da{i}" for i in range(k)]
        sums += [f"sum(wt * dz{i} * dz{j}) AS db{i}_{j}" for i in range(k) for j in range(i, k)]
        ref = f"{name}_w{t}"
        here = f"{v} = category"
        parts.append(f"""
{ref}_d AS MATERIALIZED (SELECT {by}, status, {v}, wt, p, pm,
  p - sum(wt * p) OVER {peers} / sum(wt) OVER {peers} AS d, {centred} FROM {cases}),
{ref}_h AS (SELECT {by}, category, sum(nn * nn * (1 - n / nn) * v1 / n) AS t1,
    sum(nn * nn * (1 - n / nn) * v2 / n) AS t2, sum(nn * nn * (1 - n / nn) * v3 / n) AS t3
  FROM (SELECT {by}, category, status, sum(wt) AS nn, count(*) AS n,
      var_samp(CASE WHEN {here} THEN p ELSE 0 END) AS v1, var_samp(CASE WHEN {here} THEN 0 ELSE p END) AS v2,
      var_samp(CASE WHEN {here} THEN d * d ELSE 0 END) AS v3
    FROM {ref}_d, (SELECT DISTINCT {v} AS category FROM {ref}_d) GROUP BY {by}, category, status)
  GROUP BY {by}, category),
{ref}_a AS MATERIALIZED (SELECT {by}, {v} AS category, sum(wt) AS nk, sum(wt * p) / sum(wt) AS pk, max(pm) AS pm,
  sum(wt * d * d) AS ss, {', '.join(sums)} FROM {ref}_d GROUP BY {by}, {v}),
{ref}_b AS MATERIALIZED (SELECT *, {bv(k, 'db')} FROM {ref}_a JOIN {name} USING ({by})),
{ref} AS (SELECT {by}, '{v}' AS variable, category, sign(pk - pm) * sqrt(nk * pow(pk - pm, 2) / pop) AS pu,
    sqrt(nk / pop * (t1 * pow(1 / nk - 1 / pop, 2) + t2 / pow(pop, 2))) AS pu_se, sqrt(ss / pop) AS pc,
    CASE WHEN ss = 0 THEN 0.0 ELSE sqrt(0.25 * (4 * ({quad(k, 'da')}) + 2 * ({square(k, 'db')}) + t3) / (pop * ss)) END AS pc_se
  FROM {ref}_b JOIN {ref}_h USING ({by}, category) JOIN {name}_ind USING ({by}))""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_w{t}" for t in range(len(variables)))
    return ",".join(parts) + f",\n{name}_wp AS ({union})"
