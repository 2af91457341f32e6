"""The registered queries once more, as SQL for another engine.

Written independently of the DataFrame code above the derived tables: joins
where Spark uses windows, plain windows where Spark splits groups.
"""

from __future__ import annotations

from proofcast.functions import columns as C
from proofcast.plans import reports as R
from proofcast.plans.bindings import FOCAL_YEAR, ORDERS_PER_WEEK

CELL = "reference_datetime, variable, site_id, model_id, datetime"
SITE_CASE = (
    "CASE {key} % 7 WHEN 0 THEN 'TOOK' WHEN 1 THEN 'PRLA' WHEN 2 THEN 'PRPO' WHEN 3 THEN 'CRAM'"
    " WHEN 4 THEN 'LIRO' WHEN 5 THEN 'BARC' ELSE 'SUGG' END"
)
SITES = "('TOOK', 'PRLA', 'PRPO', 'CRAM', 'LIRO', 'BARC', 'SUGG')"
WINDOW = "horizon BETWEEN 1 AND 30 AND horizon <> 15"
HORIZON = "CAST(CAST(datetime AS DATE) - CAST(reference_datetime AS DATE) AS INT)"


def _horner(x: str, coefficients) -> str:
    text = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def _phi(z: str) -> str:
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2.0) * {_horner(a, C.TAIL_NUMERATOR)} / {_horner(a, C.TAIL_DENOMINATOR)}"
    far = f"exp(-{a} * {a} / 2.0) / ({a} + 1.0/({a} + 2.0/({a} + 3.0/({a} + 4.0/({a} + 0.65))))) / {C.TAIL_SCALE}"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {C.TAIL_SWITCH} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def _significant(value: str, scale: str) -> str:
    unit = f"power(10.0, floor(log10(greatest({scale}, 1.0))))"
    return f"round({value} / {unit}, 6) * {unit}"


def _logs(value: str, name: str) -> str:
    return f"{_significant(value, f'abs({value})')} AS {name}"


def _hex(digest: str, start: int) -> str:
    return f"CAST(CAST(concat('0x', substr({digest}, {start}, 8)) AS BIGINT) AS DOUBLE)"


def _normal_draw(key: str) -> str:
    d = f"md5({key})"
    return (
        f"sqrt(-2.0 * ln(({_hex(d, 1)} + 1.0) / 4294967297.0)) * cos(2.0 * pi() * {_hex(d, 9)} / 4294967296.0)"
    )


DRAW_KEY = f"concat_ws('|', '{R.SEED}', reference_datetime, variable, site_id, model_id, CAST(datetime AS VARCHAR), parameter)"
SHUFFLE_KEY = f"md5(concat_ws('|', '{R.SEED}', reference_datetime, variable, site_id, model_id, parameter))"

TABLES = {
    "fx_models": (
        (),
        """
SELECT CASE s_suppkey WHEN 0 THEN 'climatology' WHEN 1 THEN 'persistenceRW' ELSE concat('model_', CAST(s_suppkey AS VARCHAR)) END AS model_id,
  concat('Model ', CAST(s_suppkey AS VARCHAR)) AS manuscript_name,
  CASE WHEN s_suppkey < 2 THEN 'null' WHEN s_suppkey % 4 = 0 THEN 'process-based' WHEN s_suppkey % 4 = 1 THEN 'ML' WHEN s_suppkey % 4 = 2 THEN 'empirical' ELSE 'MME' END AS model_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'temperature' WHEN s_suppkey % 3 = 1 THEN 'temperature, oxygen' ELSE 'oxygen' END AS variable,
  CASE s_suppkey % 4 WHEN 0 THEN 'air_temperature, relative_humidity' WHEN 1 THEN 'air_temperature' WHEN 2 THEN 'precipitation_flux' END AS NOAA_var,
  CASE WHEN s_suppkey % 4 < 3 THEN 1 ELSE 0 END AS uses_NOAA,
  CAST(s_suppkey % 2 AS INT) AS unc_driver,
  CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE CAST(s_suppkey % 3 AS INT) END AS unc_process,
  CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS unc_initial,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS initial_cond,
  CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS updates_parameters,
  CASE WHEN s_suppkey % 10 = 7 THEN NULL ELSE 1 END AS dynamic
FROM supplier""",
    ),
    "fx_members": (
        (),
        f"""
SELECT CASE k WHEN 0 THEN 'climatology' WHEN 1 THEN 'persistenceRW' ELSE concat('model_', CAST(k AS VARCHAR)) END AS model_id,
  CAST(issued AS VARCHAR) AS reference_datetime,
  CAST(issued + CASE WHEN k <> 0 AND s = 0 AND days = 7 THEN 44 WHEN k = 0 AND s = 5 AND days = 9 THEN 45 ELSE days END AS DATE) AS datetime,
  {SITE_CASE.format(key='l_partkey')} AS site_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'oxygen' ELSE 'temperature' END AS variable, 'sample' AS family,
  CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN NULL
    ELSE 1.5 + 2.0 * ln(l_extendedprice / 900.0) + CASE WHEN k = 0 THEN 2.0 ELSE 0.4 * k - 0.5 END END AS prediction
FROM (SELECT *, l_suppkey % 10 AS k, l_partkey % 7 AS s, CAST(l_quantity AS INT) AS days,
  CAST(DATE '2023-01-01' + CAST((l_orderkey // {ORDERS_PER_WEEK}) * 7 AS INT) AS DATE) AS issued FROM lineitem) t""",
    ),
    "fx_forecasts": (
        ("fx_members",),
        """
SELECT model_id, reference_datetime, datetime, site_id, variable, family, prediction,
  ROW_NUMBER() OVER (PARTITION BY model_id, reference_datetime, datetime, site_id, variable ORDER BY prediction NULLS LAST) AS parameter
FROM fx_members""",
    ),
    "fx_observations": (
        (),
        f"""
SELECT datetime, site_id, variable, AVG(v) AS observation FROM (
  SELECT CAST(DATE '2023-01-01' + CAST((o_orderkey // {ORDERS_PER_WEEK}) * 7 + o_orderkey % 25 AS INT) AS DATE) AS datetime,
    {SITE_CASE.format(key='o_custkey')} AS site_id,
    CASE WHEN o_orderpriority < '3' THEN 'oxygen' ELSE 'temperature' END AS variable, sqrt(o_totalprice) / 60.0 AS v FROM orders) t
GROUP BY datetime, site_id, variable""",
    ),
    "fx_targets": (
        (),
        f"""
SELECT CAST(o_orderdate AS DATE) AS datetime, {SITE_CASE.format(key='o_custkey')} AS site_id,
  CASE WHEN o_orderpriority < '3' THEN 'oxygen' ELSE 'temperature' END AS variable,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE sqrt(o_totalprice) / 60.0 END AS observation FROM orders""",
    ),
    "fx_known": (("fx_targets",), " SELECT * FROM fx_targets WHERE observation IS NOT NULL"),
    "fx_scored": (
        ("fx_members", "fx_observations"),
        f"""
SELECT f.model_id, f.reference_datetime, f.site_id, f.datetime, f.variable, f.family, f.prediction, o.observation,
  ROW_NUMBER() OVER (PARTITION BY f.model_id, f.reference_datetime, f.site_id, f.datetime, f.variable ORDER BY f.prediction NULLS LAST) AS i,
  COUNT(f.prediction) OVER (PARTITION BY f.model_id, f.reference_datetime, f.site_id, f.datetime, f.variable) AS m
FROM fx_members f LEFT JOIN fx_observations o ON f.site_id = o.site_id AND f.variable = o.variable AND f.datetime = o.datetime""",
    ),
    "fx_scores": (
        ("fx_scored",),
        f"""
SELECT {CELL}, family, MAX(observation) AS observation,
  SUM(2.0 * (prediction - observation) * (m * CASE WHEN observation < prediction THEN 1 ELSE 0 END - i + 0.5)) / NULLIF(MAX(m) * MAX(m), 0) AS crps,
  AVG(prediction) AS mean, MEDIAN(prediction) AS median, STDDEV_SAMP(prediction) AS sd,
  QUANTILE_CONT(prediction, 0.025) AS q025, QUANTILE_CONT(prediction, 0.1) AS q10, QUANTILE_CONT(prediction, 0.9) AS q90, QUANTILE_CONT(prediction, 0.975) AS q975,
  QUANTILE_CONT(prediction, 0.25) AS q25, QUANTILE_CONT(prediction, 0.75) AS q75, COUNT(prediction) AS m
FROM fx_scored GROUP BY {CELL}, family""",
    ),
    "fx_logs": (
        ("fx_scored", "fx_scores"),
        f"""
SELECT {CELL}, -(MAX(top) + ln(SUM(exp(e - top)))) + ln(MAX(m)) + ln(MAX(bw)) + 0.5 * ln(2 * pi()) AS logs FROM (
  SELECT *, MAX(e) OVER (PARTITION BY {CELL}) AS top FROM (
    SELECT r.reference_datetime, r.variable, r.site_id, r.model_id, r.datetime, r.m, b.bw,
      -0.5 * ((r.observation - r.prediction) / b.bw) * ((r.observation - r.prediction) / b.bw) AS e
    FROM fx_scored r JOIN (
      SELECT {CELL}, 1.06 * LEAST(sd, (q75 - q25) / 1.34) * POWER(m, -0.2) AS bw FROM fx_scores WHERE sd IS NOT NULL AND observation IS NOT NULL) b
      USING ({CELL}) WHERE b.bw > 0 AND r.prediction IS NOT NULL) e1) e2
GROUP BY {CELL}""",
    ),
    "fx_full_scores": (("fx_scores", "fx_logs"), f" SELECT s.*, l.logs FROM fx_scores s LEFT JOIN fx_logs l USING ({CELL})"),
    "all_scores": (("fx_scores",), f" SELECT *, {HORIZON} AS horizon FROM fx_scores"),
    "t_scores": (
        ("fx_scores",),
        f" SELECT *, {HORIZON} AS horizon FROM fx_scores",
    ),
    "t_full": (
        ("fx_full_scores",),
        f" SELECT *, {HORIZON} AS horizon FROM fx_full_scores",
    ),
    "t_skill": (
        ("t_scores",),
        f"""
SELECT COALESCE(s.reference_datetime, b.reference_datetime) AS reference_datetime, COALESCE(s.datetime, b.datetime) AS datetime,
  COALESCE(s.site_id, b.site_id) AS site_id, COALESCE(s.variable, b.variable) AS variable, COALESCE(s.horizon, b.horizon) AS horizon,
  s.model_id, s.crps, b.crps AS crps_base, s.crps - b.crps AS skill_crps
FROM (SELECT * FROM t_scores WHERE model_id <> 'climatology') s
FULL JOIN (SELECT * FROM t_scores WHERE model_id = 'climatology') b
  ON s.reference_datetime = b.reference_datetime AND s.datetime = b.datetime AND s.site_id = b.site_id AND s.variable = b.variable
WHERE COALESCE(s.horizon, b.horizon) BETWEEN 1 AND 30 AND COALESCE(s.horizon, b.horizon) <> 15""",
    ),
    "t_full_skill": (
        ("t_full",),
        f"""
SELECT COALESCE(s.reference_datetime, b.reference_datetime) AS reference_datetime, COALESCE(s.datetime, b.datetime) AS datetime,
  COALESCE(s.site_id, b.site_id) AS site_id, COALESCE(s.variable, b.variable) AS variable, COALESCE(s.horizon, b.horizon) AS horizon,
  s.model_id, s.crps, s.logs, b.crps AS crps_base, b.logs AS logs_base, s.crps - b.crps AS skill_crps, s.logs - b.logs AS skill_logs
FROM (SELECT * FROM t_full WHERE model_id <> 'climatology') s
FULL JOIN (SELECT * FROM t_full WHERE model_id = 'climatology') b
  ON s.reference_datetime = b.reference_datetime AND s.datetime = b.datetime AND s.site_id = b.site_id AND s.variable = b.variable
WHERE COALESCE(s.horizon, b.horizon) BETWEEN 1 AND 30 AND COALESCE(s.horizon, b.horizon) <> 15""",
    ),
    "t_skill_rw": (
        ("t_scores",),
        """
SELECT s.model_id, COALESCE(s.variable, b.variable) AS variable, COALESCE(s.horizon, b.horizon) AS horizon, s.crps - b.crps AS skill_crps
FROM (SELECT * FROM t_scores WHERE model_id <> 'persistenceRW') s
FULL JOIN (SELECT * FROM t_scores WHERE model_id = 'persistenceRW') b
  ON s.reference_datetime = b.reference_datetime AND s.datetime = b.datetime AND s.site_id = b.site_id AND s.variable = b.variable
WHERE COALESCE(s.horizon, b.horizon) BETWEEN 1 AND 30 AND COALESCE(s.horizon, b.horizon) <> 15""",
    ),
    "leaders": (
        ("t_skill",),
        " SELECT variable, model_id, AVG(skill_crps) AS mean_crps FROM t_skill GROUP BY variable, model_id HAVING AVG(skill_crps) < 0",
    ),
    "board": (
        ("t_skill", "leaders", "fx_models"),
        """
SELECT COALESCE(t.variable, b.variable) AS variable, COALESCE(t.model_id, b.model_id) AS model_id, t.mean_crps, COALESCE(t.manuscript_name, b.manuscript_name) AS manuscript_name,
  COALESCE(t.model_type, b.model_type) AS model_type
FROM (SELECT l.variable, l.model_id, l.mean_crps, m.manuscript_name, m.model_type FROM leaders l LEFT JOIN fx_models m ON l.model_id = m.model_id) t
FULL JOIN (SELECT v.variable, m.model_id, m.manuscript_name, m.model_type FROM (SELECT DISTINCT variable FROM t_skill) v, fx_models m
  WHERE m.model_id IN ('climatology', 'persistenceRW')) b
  ON t.variable = b.variable AND t.model_id = b.model_id AND t.manuscript_name = b.manuscript_name AND t.model_type = b.model_type""",
    ),
    "class_site": (
        ("t_skill", "fx_models"),
        """
SELECT s.variable, m.model_type, s.model_id, s.site_id, AVG(s.skill_crps) AS mean_skill FROM t_skill s LEFT JOIN fx_models m ON s.model_id = m.model_id
WHERE m.model_type <> 'null' GROUP BY s.variable, m.model_type, s.model_id, s.site_id""",
    ),
    "period": (
        ("t_full_skill",),
        """
SELECT variable, MAX(f) AS first_date, MIN(l) AS last_date FROM (
  SELECT variable, site_id, MIN(datetime) AS f, MAX(datetime) AS l FROM t_full_skill
  WHERE site_id <> 'TOOK' AND model_id IS NOT NULL AND skill_crps IS NOT NULL AND skill_logs IS NOT NULL GROUP BY variable, site_id) p GROUP BY variable""",
    ),
    "rank_rows": (
        ("all_scores",),
        """
SELECT reference_datetime, variable, horizon, site_id, model_id, crps,
  CAST(ROW_NUMBER() OVER (PARTITION BY reference_datetime, variable, horizon, site_id ORDER BY crps, model_id) AS INT) AS rank
FROM all_scores WHERE horizon BETWEEN 1 AND 30 AND crps IS NOT NULL""",
    ),
    "rank_site": (
        ("rank_rows",),
        """
SELECT r.variable, r.rank, r.site_id, r.model_id, r.horizon, r.n_rank * 1.0 / t.n AS proportion
FROM (SELECT variable, horizon, site_id, model_id, rank, COUNT(*) AS n_rank FROM rank_rows GROUP BY variable, horizon, site_id, model_id, rank) r
JOIN (SELECT variable, horizon, site_id, model_id, COUNT(*) AS n FROM rank_rows GROUP BY variable, horizon, site_id, model_id) t USING (variable, horizon, site_id, model_id)""",
    ),
    "rank_site_full": (
        ("rank_site",),
        f"""
SELECT variable, rank, site_id, model_id, horizon, COALESCE(MAX(proportion), 0) AS proportion FROM (
  SELECT variable, rank, site_id, model_id, horizon, CAST(proportion AS DOUBLE) AS proportion FROM rank_site
  UNION ALL
  SELECT m.variable, CAST(g.r AS INT), s.site_id, m.model_id, CAST(h.h AS INT), NULL FROM (SELECT DISTINCT variable, model_id FROM rank_site) m,
    (SELECT UNNEST(range(1, {R.RANKS_PER_SITE + 1})) AS r) g, (SELECT UNNEST(range(1, 31)) AS h) h,
    (SELECT UNNEST(['TOOK', 'PRLA', 'PRPO', 'CRAM', 'LIRO', 'BARC', 'SUGG']) AS site_id) s) u
GROUP BY variable, rank, site_id, model_id, horizon""",
    ),
    "rank_all": (
        ("rank_rows",),
        """
SELECT r.variable, r.model_id, r.rank, r.n_rank, t.n, r.n_rank * 1.0 / t.n AS proportion
FROM (SELECT variable, model_id, rank, COUNT(*) AS n_rank FROM rank_rows GROUP BY variable, model_id, rank) r
JOIN (SELECT variable, model_id, COUNT(*) AS n FROM rank_rows GROUP BY variable, model_id) t USING (variable, model_id)""",
    ),
    "fx_normal": (
        ("fx_members",),
        f"""
SELECT {CELL}, AVG(prediction) AS mu, STDDEV_SAMP(prediction) AS sigma FROM fx_members GROUP BY {CELL}""",
    ),
    "normal_scored": (
        ("fx_normal", "fx_observations"),
        f"""
SELECT n.*, o.observation, (o.observation - n.mu) / n.sigma AS z FROM fx_normal n
LEFT JOIN fx_observations o ON n.site_id = o.site_id AND n.variable = o.variable AND n.datetime = o.datetime""",
    ),
    "usable": (
        ("fx_members",),
        f"""
SELECT reference_datetime, variable, site_id, model_id FROM fx_members WHERE datetime > CAST(reference_datetime AS DATE)
GROUP BY reference_datetime, variable, site_id, model_id
HAVING COUNT(*) = COUNT(prediction) AND MIN({HORIZON}) <= 30""",
    ),
    "t_pool": (
        ("fx_forecasts",),
        f"""
SELECT reference_datetime, variable, site_id, model_id, datetime, CAST(parameter AS VARCHAR) AS parameter, prediction FROM fx_forecasts
WHERE datetime > CAST(reference_datetime AS DATE) AND model_id NOT IN ('model_4')""",
    ),
    "mix_pool": (
        ("t_pool", "fx_normal"),
        f"""
SELECT reference_datetime, variable, site_id, model_id, datetime, parameter, prediction FROM t_pool WHERE model_id NOT IN ('model_3', 'model_6', 'model_9')
UNION ALL
SELECT reference_datetime, variable, site_id, model_id, datetime, parameter, mu + sigma * {_normal_draw(DRAW_KEY)} AS prediction FROM (
  SELECT n.*, CAST(d.d AS VARCHAR) AS parameter FROM fx_normal n, (SELECT UNNEST(range(1, 101)) AS d) d
  WHERE n.model_id IN ('model_3', 'model_6', 'model_9')) q""",
    ),
}


def _sampled(pool: str) -> str:
    """Members drawn from a pool: distinct names shuffled, then joined back."""
    return f"""
SELECT p.*, c.sample FROM {pool} p JOIN (
  SELECT d.reference_datetime, d.variable, d.site_id, d.model_id, d.parameter, k.sample FROM (
    SELECT reference_datetime, variable, site_id, model_id, parameter,
      ROW_NUMBER() OVER (PARTITION BY reference_datetime, variable, site_id, model_id ORDER BY {SHUFFLE_KEY}, parameter) AS place
    FROM (SELECT DISTINCT reference_datetime, variable, site_id, model_id, parameter FROM {pool} WHERE {HORIZON} <= 30) x) d
  JOIN (SELECT reference_datetime, variable, site_id, CAST(round_even({R.ENSEMBLE_SIZE}.0 / COUNT(*), 0) AS INT) AS sample
    FROM {pool}_usable GROUP BY reference_datetime, variable, site_id) k USING (reference_datetime, variable, site_id)
  JOIN {pool}_usable u USING (reference_datetime, variable, site_id, model_id)
  WHERE d.place <= k.sample) c USING (reference_datetime, variable, site_id, model_id, parameter)
WHERE {HORIZON} <= 30"""


for _pool in ("t_pool", "mix_pool"):
    TABLES[f"{_pool}_usable"] = (
        (_pool,),
        f"""
SELECT reference_datetime, variable, site_id, model_id FROM {_pool} GROUP BY reference_datetime, variable, site_id, model_id
HAVING COUNT(*) = COUNT(prediction) AND MIN({HORIZON}) <= 30""",
    )
    TABLES[f"{_pool}_sample"] = ((_pool, f"{_pool}_usable"), _sampled(_pool))

TABLES["mme"] = (
    ("mix_pool_sample",),
    f"""
SELECT '{R.ENSEMBLE}' AS model_id, reference_datetime, site_id, datetime, variable, prediction,
  CAST(ROW_NUMBER() OVER (PARTITION BY reference_datetime, variable, site_id, datetime ORDER BY model_id, parameter) AS INT) AS parameter
FROM mix_pool_sample""",
)


def _with(names: tuple[str, ...], body: str) -> str:
    """Prefix a query with the derived tables it needs, in order."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES[name][0]:
            visit(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in needed)
    return f"WITH {clauses}\n{body.strip()}"


def _reliability(low: str, high: str, where: str, keys: str = "variable, horizon, model_id", source: str = "t_scores") -> str:
    return f"""
SELECT {keys}, within_TRUE, within_FALSE, round(100.0 * within_TRUE / nullif(within_TRUE + within_FALSE, 0), 6) AS perc FROM (
  SELECT {keys}, COUNT(CASE WHEN observation >= {low} AND observation <= {high} THEN 1 END) AS within_TRUE,
    COUNT(CASE WHEN NOT (observation >= {low} AND observation <= {high}) THEN 1 END) AS within_FALSE
  FROM {source} WHERE observation IS NOT NULL AND {where} GROUP BY {keys}) c"""


def _rank_bins(most: int) -> str:
    edges = [-(-most * i // 10) for i in range(11)]
    cases = " ".join(f"WHEN rank > {edges[i]} AND rank <= {edges[i + 1]} THEN {i + 1}" for i in range(10))
    return f"CASE {cases} WHEN rank > {most} THEN 11 END"


RANKED = "('climatology', 'model_2', 'model_3', 'model_5', 'model_7')"
Z = "z"
CRPS_NORMAL = f"sigma * (z * (2.0 * {_phi(Z)} - 1.0) + 2.0 * exp(-z * z / 2.0) / sqrt(2 * pi()) - 1.0 / sqrt(pi()))"
LOGS_NORMAL = "z * z / 2.0 + ln(sigma) + 0.5 * ln(2 * pi())"
COVARIATES = ", ".join(f"contains(NOAA_var, '{v}') AS {v}" for v in C.WEATHER_COVARIATES)
COVARIATE_SUM = " + ".join(f"CAST(contains(NOAA_var, '{v}') AS INT)" for v in C.WEATHER_COVARIATES)

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_variable_sites": (
        ("fx_scores", "fx_models"),
        """SELECT model_id, reference_datetime, site_id, datetime, round(crps, 6) AS crps FROM fx_scores
WHERE variable = 'temperature' AND site_id IN ('BARC', 'CRAM', 'LIRO') AND model_id IN (SELECT model_id FROM fx_models)""",
    ),
    "available_models": (
        ("fx_members",),
        f"SELECT DISTINCT model_id, reference_datetime FROM fx_members WHERE reference_datetime = '{R.SLICE_DATE}' AND model_id NOT IN ('model_4')",
    ),
    "snapshot_anti": (
        ("fx_scores", "fx_models"),
        f"""SELECT model_id, reference_datetime, site_id, datetime, variable, round(crps, 6) AS crps FROM fx_scores
WHERE reference_datetime IN ('2023-01-01', '2023-01-08', '2023-01-15') AND variable IN ('temperature', 'oxygen') AND site_id IN {SITES}
  AND model_id IN (SELECT model_id FROM fx_models)
  AND NOT (model_id IN ('model_2', 'model_4', 'model_6') AND site_id = 'TOOK' AND variable = 'temperature')""",
    ),
    "horizon_days": (
        ("fx_members",),
        f"SELECT model_id, {HORIZON} AS horizon, COUNT(*) AS n FROM fx_members GROUP BY 1, 2",
    ),
    "horizon_fractional": (
        (),
        """SELECT l_orderkey, l_linenumber,
  round((epoch(l_shipdate) - epoch(o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL 1 HOUR)) / 86400.0, 6) AS horizon
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "eval_window": (
        ("fx_members",),
        f"SELECT horizon, variable, COUNT(*) AS n FROM (SELECT {HORIZON} AS horizon, variable FROM fx_members) t WHERE {WINDOW} GROUP BY 1, 2",
    ),
    "top_model_rows": (
        ("t_skill", "leaders"),
        "SELECT model_id, reference_datetime, datetime, site_id, variable, round(skill_crps, 6) AS skill_crps FROM t_skill WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders)",
    ),
    "other_model_rows": (
        ("t_skill", "leaders"),
        """SELECT model_id, reference_datetime, datetime, site_id, variable, round(skill_crps, 6) AS skill_crps FROM t_skill s
WHERE NOT EXISTS (SELECT 1 FROM leaders l WHERE l.model_id = s.model_id AND l.variable = s.variable)""",
    ),
    "complete_rows": (
        ("fx_known",),
        "SELECT datetime, site_id, variable, round(observation, 6) AS observation FROM fx_known",
    ),
    "flag_variables": (
        ("fx_models",),
        """SELECT model_id, contains(variable, 'temperature') AS tw, contains(variable, 'oxygen') AS "do",
  contains(NOAA_var, 'air_temperature') AS uses_AT, CASE uses_NOAA WHEN 1 THEN 'yes' ELSE 'no' END AS uses_NOAA FROM fx_models""",
    ),
    "covariate_matrix": (("fx_models",), f"SELECT model_id, {COVARIATES} FROM fx_models"),
    "uncertainty_count_hist": (
        ("fx_models",),
        "SELECT unc_driver + unc_process + unc_initial AS unc_n, COUNT(*) AS n FROM fx_models WHERE contains(variable, 'temperature') GROUP BY 1",
    ),
    "baseline_outcome": (
        ("t_skill", "t_skill_rw", "leaders", "fx_models"),
        """SELECT variable, model_id, horizon, manuscript_name, round(d, 6) AS mean_crpsDOY, round(r, 6) AS mean_crpsRW,
  CASE WHEN d < 0 AND r < 0 THEN 'Both' WHEN d > 0 AND r < 0 THEN 'Persistence' WHEN d < 0 AND r > 0 THEN 'Day-of-year' ELSE 'Neither' END AS beats,
  CASE WHEN d < 0 AND r < 0 THEN 4 WHEN d > 0 AND r < 0 THEN 2 WHEN d < 0 AND r > 0 THEN 3 ELSE 1 END AS beats_order
FROM (SELECT variable, model_id, horizon, AVG(skill_crps) AS d FROM t_skill WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) GROUP BY 1, 2, 3) a
FULL JOIN (SELECT variable, model_id, horizon, AVG(skill_crps) AS r FROM t_skill_rw WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) AND model_id <> 'climatology' GROUP BY 1, 2, 3) b
  USING (variable, model_id, horizon)
LEFT JOIN (SELECT model_id, manuscript_name FROM fx_models) m USING (model_id)
WHERE d IS NOT NULL AND r IS NOT NULL AND manuscript_name IS NOT NULL""",
    ),
    "observation_seasonality": (
        ("fx_targets",),
        f"""SELECT site_id, datetime, CAST(year(datetime) AS INT) AS year, CAST(month(datetime) AS INT) AS month,
  CAST(dayofyear(datetime) AS INT) AS doy, CASE WHEN year(datetime) = {FOCAL_YEAR} THEN 'focal' ELSE 'historic' END AS period,
  round(observation, 6) AS observation FROM fx_targets WHERE variable = 'temperature' AND site_id IN {SITES}""",
    ),
    "overlap_fixed_dates": (
        ("t_skill", "fx_models"),
        """SELECT s.variable, m.model_type, s.model_id, s.site_id, round(AVG(s.skill_crps), 6) AS mean_skill FROM t_skill s JOIN fx_models m ON s.model_id = m.model_id
WHERE m.model_type <> 'null' AND CAST(reference_datetime AS DATE) > DATE '2023-01-01' AND CAST(reference_datetime AS DATE) < DATE '2023-01-29'
GROUP BY 1, 2, 3, 4""",
    ),
    "split_site_depth": (
        ("fx_scores",),
        f"""SELECT model_id, reference_datetime, datetime, variable, split_part(tag, '-', 1) AS site_id,
  TRY_CAST(nullif(split_part(tag, '-', 2), '') AS DOUBLE) AS depth
FROM (SELECT *, CASE WHEN {HORIZON} % 2 = 0 THEN concat(site_id, '-0.5') ELSE site_id END AS tag FROM fx_scores) t""",
    ),
    "forecasts_by_variable": (
        ("fx_members",),
        """SELECT variable, COUNT(*) AS n, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent
FROM (SELECT DISTINCT model_id, site_id, variable, reference_datetime FROM fx_members) d GROUP BY variable""",
    ),
    "pending_dates": (
        ("fx_members",),
        """SELECT CAST(d AS DATE) AS reference_datetime FROM (SELECT UNNEST(generate_series(DATE '2023-01-01', (SELECT MAX(CAST(reference_datetime AS DATE)) FROM fx_members), INTERVAL 1 DAY)) AS d) s
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(reference_datetime AS DATE) FROM fx_members)""",
    ),
    "skill_vs_climatology": (
        ("t_full_skill",),
        f"""SELECT reference_datetime, datetime, site_id, variable, horizon, model_id, round(crps, 6) AS crps, {_logs('logs', 'logs')},
  round(crps_base, 6) AS crps_base, {_logs('logs_base', 'logs_base')}, round(skill_crps, 6) AS skill_crps,
  {_significant('skill_logs', 'abs(logs) + abs(logs_base)')} AS skill_logs FROM t_full_skill""",
    ),
    "skill_vs_persistence": (
        ("fx_full_scores",),
        f"""SELECT s.reference_datetime, s.datetime, s.site_id, s.variable, CAST(s.datetime - CAST(s.reference_datetime AS DATE) AS INT) AS horizon, s.model_id,
  round(s.crps, 6) AS crps, {_logs('s.logs', 'logs')}, round(b.crps, 6) AS crps_base, {_logs('b.logs', 'logs_base')},
  round(b.crps - s.crps, 6) AS skill_crps, {_significant('(b.logs - s.logs)', 'abs(s.logs) + abs(b.logs)')} AS skill_logs
FROM fx_full_scores s LEFT JOIN (SELECT * FROM fx_full_scores WHERE model_id = 'persistenceRW') b
  ON s.reference_datetime = b.reference_datetime AND s.datetime = b.datetime AND s.site_id = b.site_id AND s.variable = b.variable
WHERE s.model_id <> 'persistenceRW' AND CAST(s.datetime - CAST(s.reference_datetime AS DATE) AS INT) BETWEEN 1 AND 30""",
    ),
    "forecast_obs_join": (
        ("fx_members", "fx_observations"),
        """SELECT f.model_id, f.variable, COUNT(*) AS n, COUNT(o.observation) AS n_observed, round(SUM(o.observation), 6) AS total_observed
FROM fx_members f LEFT JOIN fx_observations o ON f.site_id = o.site_id AND f.datetime = o.datetime AND f.variable = o.variable GROUP BY 1, 2""",
    ),
    "overlap_period_skill": (
        ("t_full_skill", "period", "fx_models"),
        """SELECT s.variable, m.model_type, s.model_id, s.site_id, round(AVG(s.skill_crps), 6) AS mean_skill FROM t_full_skill s
JOIN fx_models m ON s.model_id = m.model_id JOIN period p ON s.variable = p.variable
WHERE m.model_type <> 'null' AND s.datetime >= p.first_date AND s.datetime <= p.last_date GROUP BY 1, 2, 3, 4""",
    ),
    "overlap_period_curves": (
        ("t_full_skill", "period", "leaders"),
        """SELECT s.variable, site_id, horizon, round(AVG(skill_crps), 6) AS mean_crps FROM t_full_skill s JOIN period p ON s.variable = p.variable
WHERE (s.variable, model_id) IN (SELECT variable, model_id FROM leaders) AND datetime >= p.first_date AND datetime <= p.last_date GROUP BY 1, 2, 3""",
    ),
    "leaderboard_with_baselines": (
        ("board",),
        "SELECT variable, model_id, round(mean_crps, 6) AS mean_crps, manuscript_name, model_type FROM board",
    ),
    "mean_skill_by_model": (
        ("t_skill", "fx_models"),
        """SELECT a.variable, a.model_id, round(a.v, 6) AS mean_crps, manuscript_name, model_type,
  CASE WHEN uses_NOAA = 1 THEN 'yes' WHEN uses_NOAA = 0 THEN 'no' END AS uses_NOAA, contains(NOAA_var, 'air_temperature') AS uses_AT
FROM (SELECT variable, model_id, AVG(skill_crps) AS v FROM t_skill GROUP BY 1, 2) a LEFT JOIN fx_models m ON a.model_id = m.model_id""",
    ),
    "top_models": (("leaders",), "SELECT variable, model_id, round(mean_crps, 6) AS mean_crps FROM leaders"),
    "skill_by_horizon": (
        ("t_skill", "leaders", "fx_models"),
        """SELECT a.variable, a.model_id, horizon, round(v, 6) AS mean_crps, manuscript_name FROM (
  SELECT variable, model_id, horizon, AVG(skill_crps) AS v FROM t_skill WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) AND model_id <> 'persistenceRW' GROUP BY 1, 2, 3) a
LEFT JOIN fx_models m ON a.model_id = m.model_id""",
    ),
    "skill_by_horizon_others": (
        ("t_skill", "leaders", "fx_models"),
        """SELECT a.variable, a.model_id, horizon, round(v, 6) AS mean_crps, manuscript_name FROM (
  SELECT variable, model_id, horizon, AVG(skill_crps) AS v FROM t_skill s
  WHERE NOT EXISTS (SELECT 1 FROM leaders l WHERE l.model_id = s.model_id AND l.variable = s.variable) GROUP BY 1, 2, 3) a
LEFT JOIN fx_models m ON a.model_id = m.model_id""",
    ),
    "persistence_skill_by_horizon": (
        ("t_skill_rw", "leaders"),
        """SELECT variable, model_id, horizon, round(AVG(skill_crps), 6) AS mean_crps FROM t_skill_rw
WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) AND model_id <> 'climatology' GROUP BY 1, 2, 3""",
    ),
    "skill_by_site_horizon": (
        ("t_skill", "leaders"),
        "SELECT variable, site_id, horizon, round(AVG(skill_crps), 6) AS mean_crps FROM t_skill WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) GROUP BY 1, 2, 3",
    ),
    "skill_by_class_site": (
        ("class_site",),
        "SELECT variable, model_type, model_id, site_id, round(mean_skill, 6) AS mean_skill FROM class_site",
    ),
    "skill_boxplot": (
        ("class_site",),
        """WITH_NEXT hinges AS (SELECT variable, model_type, site_id, QUANTILE_CONT(mean_skill, 0.25) AS lower, MEDIAN(mean_skill) AS middle,
    QUANTILE_CONT(mean_skill, 0.75) AS upper, COUNT(mean_skill) AS n FROM class_site WHERE mean_skill IS NOT NULL GROUP BY 1, 2, 3)
SELECT h.variable, h.model_type, h.site_id, round(h.lower, 6) AS lower, round(h.middle, 6) AS middle, round(h.upper, 6) AS upper, h.n,
  round(MIN(CASE WHEN mean_skill BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower) THEN mean_skill END), 6) AS whisker_low,
  round(MAX(CASE WHEN mean_skill BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower) THEN mean_skill END), 6) AS whisker_high,
  COUNT(CASE WHEN NOT (mean_skill BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower)) THEN 1 END) AS outliers
FROM class_site c JOIN hinges h ON c.variable = h.variable AND c.model_type = h.model_type AND c.site_id = h.site_id WHERE mean_skill IS NOT NULL
GROUP BY h.variable, h.model_type, h.site_id, h.lower, h.middle, h.upper, h.n""",
    ),
    "crps_profile": (
        ("t_scores", "t_skill", "fx_models"),
        """WITH_NEXT means AS (SELECT variable, model_id, AVG(skill_crps) AS v FROM t_skill GROUP BY 1, 2),
best AS (SELECT variable, model_id FROM (SELECT variable, model_id, rank() OVER (PARTITION BY variable ORDER BY v) AS r FROM means WHERE v IS NOT NULL) q WHERE r <= 10)
SELECT s.variable, m.model_type, s.site_id, round(QUANTILE_CONT(crps, 0.05), 6) AS p05, round(QUANTILE_CONT(crps, 0.25), 6) AS p25, round(MEDIAN(crps), 6) AS p50,
  round(QUANTILE_CONT(crps, 0.75), 6) AS p75, round(QUANTILE_CONT(crps, 0.95), 6) AS p95, COUNT(*) AS n
FROM t_scores s JOIN fx_models m ON s.model_id = m.model_id WHERE crps IS NOT NULL AND (s.variable, s.model_id) IN (SELECT variable, model_id FROM best) GROUP BY 1, 2, 3""",
    ),
    "baseline_crps_by_horizon": (
        ("fx_scores",),
        f"""SELECT variable, CASE model_id WHEN 'climatology' THEN 'day-of-year' ELSE 'persistence' END AS model_id, horizon, round(AVG(crps), 6) AS mean_crps
FROM (SELECT *, {HORIZON} AS horizon FROM fx_scores WHERE model_id IN ('climatology', 'persistenceRW')) t WHERE {WINDOW} GROUP BY 1, 2, 3""",
    ),
    "baseline_median_by_site": (
        ("t_scores",),
        f"SELECT variable, horizon, site_id, round(MEDIAN(crps), 6) AS median_crps FROM t_scores WHERE model_id = 'climatology' AND {WINDOW} GROUP BY 1, 2, 3",
    ),
    "spread_by_horizon": (
        ("t_scores", "leaders"),
        f"""SELECT variable, model_id, horizon, round(AVG(sd), 6) AS mean_sd FROM t_scores
WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) AND model_id <> 'persistenceRW' AND {WINDOW} GROUP BY 1, 2, 3""",
    ),
    "bias_by_horizon": (
        ("t_scores", "leaders"),
        f"""SELECT variable, model_id, horizon, round(AVG(abs(mean - observation)), 6) AS mean_abs_bias FROM t_scores
WHERE (variable, model_id) IN (SELECT variable, model_id FROM leaders) AND model_id <> 'persistenceRW' AND {WINDOW} GROUP BY 1, 2, 3""",
    ),
    "reliability_80": (
        ("t_scores", "board"),
        f"SELECT c.*, manuscript_name FROM ({_reliability('q10', 'q90', WINDOW)}) c JOIN board b ON c.variable = b.variable AND c.model_id = b.model_id",
    ),
    "reliability_95": (
        ("t_scores", "board"),
        f"SELECT c.*, manuscript_name FROM ({_reliability('q025', 'q975', WINDOW)}) c JOIN board b ON c.variable = b.variable AND c.model_id = b.model_id",
    ),
    "reliability_others": (
        ("t_scores", "board", "fx_models"),
        f"""SELECT c.*, manuscript_name FROM ({_reliability('q10', 'q90', WINDOW)}) c JOIN fx_models b ON c.model_id = b.model_id
WHERE (c.variable, c.model_id) NOT IN (SELECT variable, model_id FROM board)""",
    ),
    "reliability_by_site": (
        ("t_scores",),
        _reliability("q10", "q90", "horizon BETWEEN 1 AND 30", "variable, horizon, model_id, site_id"),
    ),
    "models_by_class": (
        ("fx_models",),
        """SELECT model_type, COUNT(*) AS n, 'temperature' AS target FROM fx_models WHERE contains(variable, 'temperature') GROUP BY 1
UNION ALL SELECT model_type, COUNT(*), 'oxygen' FROM fx_models WHERE contains(variable, 'oxygen') GROUP BY 1
UNION ALL SELECT variable, COUNT(*), 'listing' FROM fx_models GROUP BY 1""",
    ),
    "flag_totals": (
        ("fx_models",),
        "SELECT "
        + ", ".join(
            f'CAST(COALESCE(SUM({value}), 0) AS BIGINT) AS "{name}"'
            for name, value in {
                "tw": "CAST(contains(variable, 'temperature') AS INT)",
                "do": "CAST(contains(variable, 'oxygen') AS INT)",
                "unc_driver": "unc_driver",
                "unc_process": "unc_process",
                "unc_initial": "unc_initial",
                "initial_cond": "initial_cond",
                "updates_parameters": "updates_parameters",
                "dynamic": "dynamic",
            }.items()
        )
        + " FROM fx_models",
    ),
    "covariate_count_hist": (
        ("fx_models",),
        f"SELECT {COVARIATE_SUM} AS vars_n, COUNT(*) AS n_models FROM fx_models GROUP BY 1",
    ),
    "sites_per_model_hist": (
        ("fx_scores",),
        "SELECT site_n, COUNT(*) AS n_models FROM (SELECT model_id, COUNT(DISTINCT site_id) AS site_n FROM fx_scores GROUP BY 1) t GROUP BY 1",
    ),
    "variables_per_model_hist": (
        ("fx_scores",),
        "SELECT variable_n, COUNT(*) AS n_models FROM (SELECT model_id, COUNT(DISTINCT variable) AS variable_n FROM fx_scores GROUP BY 1) t GROUP BY 1",
    ),
    "scored_models_per_class": (
        ("t_skill", "fx_models"),
        """SELECT s.variable, model_type, COUNT(*) AS n FROM (SELECT DISTINCT variable, model_id FROM t_skill) s JOIN fx_models m ON s.model_id = m.model_id
WHERE model_type <> 'null' GROUP BY 1, 2""",
    ),
    "common_period": (
        ("t_full_skill", "period"),
        """SELECT variable, MAX(f) AS first_date, MIN(l) AS last_date, 'all' AS sites FROM (
  SELECT variable, site_id, MIN(datetime) AS f, MAX(datetime) AS l FROM t_full_skill
  WHERE model_id IS NOT NULL AND skill_crps IS NOT NULL AND skill_logs IS NOT NULL GROUP BY variable, site_id) p GROUP BY variable
UNION ALL SELECT variable, first_date, last_date, 'without TOOK' FROM period""",
    ),
    "monthly_mean_focal": (
        ("fx_known",),
        f"""SELECT CAST(month(datetime) AS INT) AS month, site_id, CASE WHEN COUNT(*) >= 18 THEN round(AVG(observation), 6) END AS mean_obs, COUNT(*) AS n
FROM fx_known WHERE variable = 'temperature' AND site_id IN {SITES} AND year(datetime) = {FOCAL_YEAR} GROUP BY 1, 2""",
    ),
    "seasonal_anomaly": (
        ("fx_known",),
        f"""SELECT CAST(make_date({FOCAL_YEAR}, month, 1) AS DATE) AS month, site_id, round(focal, 6) AS focal, round(historic, 6) AS historic,
  round(focal - historic, 6) AS delta FROM (
  SELECT CAST(month(datetime) AS INT) AS month, site_id,
    CASE WHEN COUNT(*) FILTER (year(datetime) = {FOCAL_YEAR}) >= 18 THEN MEDIAN(observation) FILTER (year(datetime) = {FOCAL_YEAR}) END AS focal,
    CASE WHEN COUNT(*) FILTER (year(datetime) <> {FOCAL_YEAR}) >= 18 THEN MEDIAN(observation) FILTER (year(datetime) <> {FOCAL_YEAR}) END AS historic
  FROM fx_known WHERE variable = 'temperature' AND site_id IN {SITES} GROUP BY 1, 2) t""",
    ),
    "observation_cv": (
        ("fx_known",),
        f"""SELECT site_id, CAST(year(datetime) AS INT) AS year, variable, round(STDDEV_SAMP(observation) / AVG(observation), 6) AS cv
FROM fx_known WHERE variable = 'temperature' AND site_id IN {SITES} AND year(datetime) < 2002 GROUP BY 1, 2, 3""",
    ),
    "climatology_by_site": (
        ("t_scores",),
        "SELECT variable, site_id, round(AVG(crps), 6) AS mean_score FROM t_scores WHERE model_id = 'climatology' GROUP BY 1, 2",
    ),
    "crps_by_horizon_model_site": (
        ("t_scores",),
        """WITH_NEXT best AS (SELECT variable, model_id FROM (SELECT variable, model_id, rank() OVER (PARTITION BY variable ORDER BY AVG(crps)) AS r FROM t_scores GROUP BY variable, model_id HAVING AVG(crps) IS NOT NULL) q WHERE r <= 10)
SELECT variable, horizon, model_id, site_id, round(AVG(crps), 6) AS mean_crps FROM t_scores
WHERE horizon BETWEEN 0 AND 30 AND (variable, model_id) IN (SELECT variable, model_id FROM best) GROUP BY 1, 2, 3, 4""",
    ),
    "driver_skill": (
        ("fx_scores",),
        f"SELECT site_id, variable, {HORIZON} AS horizon, round(AVG(crps), 6) AS crps FROM fx_scores WHERE {HORIZON} <= 30 GROUP BY 1, 2, 3",
    ),
    "median_skill_by_model": (
        ("fx_scores",),
        f"""SELECT variable, model_id, median_crps FROM (SELECT variable, model_id, round(v, 6) AS median_crps, rank() OVER (PARTITION BY variable ORDER BY v DESC) AS r FROM (
  SELECT s.variable, s.model_id, MEDIAN(b.crps - s.crps) AS v FROM fx_scores s
  LEFT JOIN (SELECT * FROM fx_scores WHERE model_id = 'climatology') b
    ON s.reference_datetime = b.reference_datetime AND s.datetime = b.datetime AND s.site_id = b.site_id AND s.variable = b.variable
  WHERE s.model_id <> 'climatology' AND CAST(s.datetime - CAST(s.reference_datetime AS DATE) AS INT) BETWEEN 1 AND 30
  GROUP BY 1, 2) a WHERE v IS NOT NULL) q WHERE r <= 10""",
    ),
    "rank_distribution": (
        ("rank_all",),
        "SELECT variable, model_id, rank, n_rank, n, round(proportion, 6) AS proportion FROM rank_all",
    ),
    "rank_deciles": (
        ("rank_all",),
        f"""SELECT group_rank, variable, model_id, round(SUM(proportion), 6) AS proportion FROM (
  SELECT CAST({_rank_bins(R.RANKS_OVERALL)} AS INT) AS group_rank, variable, model_id, proportion FROM (
    SELECT variable, model_id, rank, CAST(proportion AS DOUBLE) AS proportion FROM rank_all UNION ALL
    SELECT m.variable, m.model_id, g.r, 0.0 FROM (SELECT DISTINCT variable, model_id FROM rank_all) m, (SELECT UNNEST(range(1, {R.RANKS_OVERALL + 1})) AS r) g) u
  WHERE model_id IN {RANKED}) t WHERE group_rank IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    "rank_distribution_site": (
        ("rank_site_full",),
        "SELECT variable, rank, site_id, model_id, horizon, round(proportion, 6) AS proportion FROM rank_site_full",
    ),
    "rank_deciles_site": (
        ("rank_site_full",),
        f"""SELECT CAST({_rank_bins(R.RANKS_PER_SITE)} AS INT) AS group_rank, variable, site_id, model_id, horizon, round(SUM(proportion), 6) AS proportion
FROM rank_site_full WHERE model_id IN {RANKED} GROUP BY 1, 2, 3, 4, 5""",
    ),
    "latest_scored": (
        ("fx_scores",),
        "SELECT model_id, MAX(datetime) AS latest FROM fx_scores WHERE observation IS NOT NULL GROUP BY 1",
    ),
    "ensemble_quota": (
        ("usable",),
        f"""SELECT reference_datetime, variable, site_id, COUNT(*) AS n_models, CAST(round_even({R.ENSEMBLE_SIZE}.0 / COUNT(*), 0) AS INT) AS sample
FROM usable GROUP BY 1, 2, 3""",
    ),
    "observation_coverage": (
        ("fx_known",),
        f"SELECT site_id, variable, datetime, COUNT(*) AS n FROM fx_known WHERE year(datetime) < {FOCAL_YEAR} AND site_id IN {SITES} GROUP BY 1, 2, 3",
    ),
    "forecast_ranks": (
        ("rank_rows",),
        "SELECT reference_datetime, variable, horizon, site_id, model_id, round(crps, 6) AS crps, rank FROM rank_rows",
    ),
    "top10_models": (
        ("t_scores",),
        """SELECT variable, model_id, mean_skill FROM (SELECT variable, model_id, round(v, 6) AS mean_skill, rank() OVER (PARTITION BY variable ORDER BY v DESC) AS r FROM (
  SELECT variable, s.model_id, AVG(b.crps - s.crps) AS v FROM t_scores s LEFT JOIN (SELECT * FROM t_scores WHERE model_id = 'climatology') b
    USING (reference_datetime, datetime, site_id, variable) WHERE s.model_id <> 'climatology' AND s.horizon BETWEEN 1 AND 30 GROUP BY 1, 2) a WHERE v IS NOT NULL) q WHERE r <= 10""",
    ),
    "top5_per_site": (
        ("t_scores",),
        """SELECT variable, model_id, site_id, mean_crps FROM (SELECT variable, model_id, site_id, round(v, 6) AS mean_crps, rank() OVER (PARTITION BY variable, site_id ORDER BY v DESC) AS r FROM (
  SELECT variable, s.model_id, site_id, AVG(b.crps - s.crps) AS v FROM t_scores s LEFT JOIN (SELECT * FROM t_scores WHERE model_id = 'climatology') b
    USING (reference_datetime, datetime, site_id, variable) WHERE s.model_id <> 'climatology' AND s.horizon BETWEEN 1 AND 30 GROUP BY 1, 2, 3) a WHERE v IS NOT NULL) q WHERE r <= 5""",
    ),
    "sites_without_gaps": (
        ("usable",),
        "SELECT reference_datetime, variable, site_id, model_id FROM usable",
    ),
    "ensemble_members": (
        ("mme",),
        "SELECT reference_datetime, site_id, datetime, variable, parameter, round(prediction, 6) AS prediction FROM mme",
    ),
    "ensemble_sample": (
        ("t_pool_sample",),
        "SELECT DISTINCT reference_datetime, variable, site_id, model_id, parameter, sample FROM t_pool_sample",
    ),
    "model_order": (
        ("t_skill",),
        """SELECT variable, model_id, round(v, 6) AS mean_crps, CAST(ROW_NUMBER() OVER (PARTITION BY variable ORDER BY v DESC NULLS LAST, model_id NULLS LAST) AS INT) AS model_order
FROM (SELECT variable, model_id, AVG(skill_crps) AS v FROM t_skill GROUP BY 1, 2) a""",
    ),
    "model_order_within_site": (
        ("t_skill",),
        """SELECT variable, model_id, site_id, round(v, 6) AS mean_crps,
  CAST(ROW_NUMBER() OVER (PARTITION BY variable, site_id ORDER BY v NULLS LAST, model_id NULLS LAST) AS INT) AS model_order
FROM (SELECT variable, model_id, site_id, AVG(skill_crps) AS v FROM t_skill GROUP BY 1, 2, 3) a""",
    ),
    "site_order": (
        ("t_skill", "leaders"),
        """SELECT variable, site_id, round(v, 6) AS mean_crps, CAST(ROW_NUMBER() OVER (PARTITION BY variable ORDER BY v DESC NULLS LAST, site_id) AS INT) AS site_order
FROM (SELECT variable, site_id, AVG(skill_crps) AS v FROM t_skill WHERE horizon = 30 AND (variable, model_id) IN (SELECT variable, model_id FROM leaders) GROUP BY 1, 2) a""",
    ),
    "covariate_usage": (
        ("fx_models",),
        " UNION ALL ".join(
            f"SELECT '{v}' AS NOAA_vars, CAST(COALESCE(SUM(CAST(contains(NOAA_var, '{v}') AS INT)), 0) AS BIGINT) AS n_models FROM fx_models"
            for v in C.WEATHER_COVARIATES
        ),
    ),
    "union_forecasts": (
        ("fx_members", "fx_normal"),
        """SELECT model_id, family, parameter, COUNT(*) AS n, round(AVG(prediction), 6) AS mean_prediction FROM (
  SELECT model_id, family, NULL AS parameter, prediction FROM fx_members UNION ALL
  SELECT model_id, 'normal', 'mu', mu FROM fx_normal UNION ALL SELECT model_id, 'normal', 'sigma', sigma FROM fx_normal) u GROUP BY 1, 2, 3""",
    ),
    "pivot_baselines": (
        ("t_full",),
        f"""SELECT reference_datetime, datetime, site_id, variable, round(c.crps, 6) AS crps_climatology, round(p.crps, 6) AS crps_persistenceRW,
  {_logs('c.logs', 'logs_climatology')}, {_logs('p.logs', 'logs_persistenceRW')}
FROM (SELECT * FROM t_full WHERE model_id = 'climatology') c FULL JOIN (SELECT * FROM t_full WHERE model_id = 'persistenceRW') p
  USING (reference_datetime, datetime, site_id, variable)""",
    ),
    "normal_params": (("fx_normal",), f"SELECT {CELL}, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM fx_normal"),
    "gap_expansion": (
        ("t_scores",),
        """WITH_NEXT grid AS (SELECT DISTINCT reference_datetime, horizon, model_id, variable FROM t_scores WHERE horizon <= 30),
sites AS (SELECT UNNEST(['TOOK', 'PRLA', 'PRPO', 'CRAM', 'LIRO', 'BARC', 'SUGG']) AS site_id)
SELECT g.model_id, g.variable, s.site_id, g.horizon, round(AVG(t.crps), 6) AS mean_crps, COUNT(*) AS n
FROM grid g CROSS JOIN sites s LEFT JOIN t_scores t ON t.reference_datetime = g.reference_datetime AND t.horizon = g.horizon AND t.model_id = g.model_id AND t.variable = g.variable AND t.site_id = s.site_id
WHERE CAST(g.reference_datetime AS DATE) > DATE '2022-12-31' AND CAST(g.reference_datetime AS DATE) < DATE '2024-01-01' GROUP BY 1, 2, 3, 4""",
    ),
    "usable_forecasts": (
        ("fx_forecasts", "usable"),
        f"""SELECT f.model_id, f.reference_datetime, f.datetime, f.site_id, f.variable, f.family, round(f.prediction, 6) AS prediction, f.parameter
FROM fx_forecasts f JOIN usable u USING (reference_datetime, variable, site_id, model_id) WHERE {HORIZON} <= 30 AND {HORIZON} > 0""",
    ),
    "normal_to_ensemble": (
        ("fx_normal",),
        f"""SELECT {CELL}, COUNT(parameter) AS n_draws, round(MIN(v), 6) AS lowest, round(MAX(v), 6) AS highest,
  round(AVG(v), 6) AS mean_draw FROM (
  SELECT *, mu + sigma * {_normal_draw(DRAW_KEY)} AS v FROM (
    SELECT n.*, CAST(d.d AS VARCHAR) AS parameter FROM fx_normal n, (SELECT UNNEST(range(1, 101)) AS d) d) t) u GROUP BY {CELL}""",
    ),
    "multi_model_ensemble": (
        ("mme", "fx_observations"),
        """WITH_NEXT r AS (SELECT e.*, o.observation, ROW_NUMBER() OVER (PARTITION BY e.reference_datetime, e.variable, e.site_id, e.datetime ORDER BY e.prediction) AS i,
  COUNT(*) OVER (PARTITION BY e.reference_datetime, e.variable, e.site_id, e.datetime) AS m
  FROM mme e LEFT JOIN fx_observations o ON e.site_id = o.site_id AND e.datetime = o.datetime AND e.variable = o.variable)
SELECT model_id, reference_datetime, variable, site_id, datetime, COUNT(*) AS m, round(AVG(prediction), 6) AS mean, round(MEDIAN(prediction), 6) AS median,
  round(SUM(2.0 * (prediction - observation) * (m * CASE WHEN observation < prediction THEN 1 ELSE 0 END - i + 0.5)) / (MAX(m) * MAX(m)), 6) AS crps
FROM r GROUP BY model_id, reference_datetime, variable, site_id, datetime""",
    ),
    "crps_sample": (("fx_scores",), f"SELECT {CELL}, m, round(crps, 6) AS crps FROM fx_scores"),
    "crps_normal": (("normal_scored",), f"SELECT {CELL}, round({CRPS_NORMAL}, 6) AS crps FROM normal_scored"),
    "logs_normal": (("normal_scored",), f"SELECT {CELL}, {_logs('logs', 'logs')} FROM (SELECT {CELL}, {LOGS_NORMAL} AS logs FROM normal_scored) n"),
    "logs_sample": (("fx_full_scores",), f"SELECT {CELL}, m, {_logs('logs', 'logs')} FROM fx_full_scores"),
    "forecast_summary": (
        ("fx_members",),
        f"""SELECT {CELL}, round(AVG(prediction), 6) AS mean, round(MEDIAN(prediction), 6) AS median, round(STDDEV_SAMP(prediction), 6) AS sd,
  round(QUANTILE_CONT(prediction, 0.025), 6) AS q025, round(QUANTILE_CONT(prediction, 0.975), 6) AS q975,
  round(QUANTILE_CONT(prediction, 0.05), 6) AS q10, round(QUANTILE_CONT(prediction, 0.95), 6) AS q90
FROM fx_members GROUP BY {CELL}""",
    ),
    "score_forecasts": (
        ("fx_full_scores", "normal_scored"),
        f"""SELECT {CELL}, family, round(observation, 6) AS observation, round(crps, 6) AS crps, {_logs('logs', 'logs')}, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(q025, 6) AS q025, round(q10, 6) AS q10, round(q90, 6) AS q90, round(q975, 6) AS q975,
  CAST({HORIZON} AS DOUBLE) AS horizon, CAST(NULL AS DOUBLE) AS depth, CAST(datetime AS VARCHAR) AS date FROM fx_full_scores
UNION ALL
SELECT reference_datetime, variable, site_id, concat(model_id, '_normal'), datetime, 'normal', round(observation, 6), round({CRPS_NORMAL}, 6), {_significant(f'({LOGS_NORMAL})', f'abs({LOGS_NORMAL})')}, round(mu, 6), round(sigma, 6),
  round(mu - sigma * {C.Z_975}, 6), round(mu - sigma * {C.Z_900}, 6), round(mu + sigma * {C.Z_900}, 6), round(mu + sigma * {C.Z_975}, 6),
  CAST({HORIZON} AS DOUBLE), CAST(NULL AS DOUBLE), CAST(datetime AS VARCHAR) FROM normal_scored""",
    ),
    "validation_report": (
        ("fx_forecasts",),
        f"""SELECT rule, n_rows, n_rows = 0 AS passed FROM (
  SELECT 'unknown_family' AS rule, COUNT(*) FILTER (family NOT IN ('sample', 'ensemble', 'normal')) AS n_rows FROM fx_forecasts
  UNION ALL SELECT 'missing_prediction', COUNT(*) FILTER (prediction IS NULL) FROM fx_forecasts
  UNION ALL SELECT 'not_after_issue_date', COUNT(*) FILTER (datetime <= CAST(reference_datetime AS DATE)) FROM fx_forecasts
  UNION ALL SELECT 'duplicate_member', COUNT(*) - COUNT(DISTINCT (model_id, reference_datetime, site_id, datetime, variable, parameter)) FROM fx_forecasts
  UNION ALL SELECT 'incomplete_normal', COUNT(*) FILTER (family = 'normal') FROM fx_forecasts) t""",
    ),
    "forecast_slice": (
        ("t_scores",),
        f"""SELECT variable, model_id, site_id, datetime, horizon, round(mean, 6) AS mean, round(observation, 6) AS observation FROM t_scores
WHERE reference_datetime = '{R.SLICE_DATE}' AND horizon BETWEEN 1 AND 30 AND model_id IN ('climatology', 'model_2', 'model_3')""",
    ),
    "rescore_candidates": (
        ("fx_scores", "fx_observations"),
        f"""SELECT {CELL} FROM fx_scores s WHERE observation IS NULL AND EXISTS (
  SELECT 1 FROM fx_observations o WHERE o.site_id = s.site_id AND o.variable = s.variable AND CAST(o.datetime + 7 AS DATE) = s.datetime)""",
    ),
    "structure_report": (
        ("fx_forecasts",),
        """WITH_NEXT d AS (SELECT model_id, reference_datetime, site_id, variable, datetime, list_sort(list(parameter)) AS names
  FROM fx_forecasts GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT COUNT(DISTINCT names) > 1 AS unequal, MAX(datetime) - MIN(datetime) + 1 <> COUNT(*) AS gap FROM d GROUP BY model_id, reference_datetime, site_id, variable)
SELECT rule, n_rows, n_rows = 0 AS passed FROM (SELECT 'unequal_members' AS rule, COUNT(*) FILTER (unequal) AS n_rows FROM s
  UNION ALL SELECT 'gap_in_dates', COUNT(*) FILTER (gap) FROM s UNION ALL SELECT 'partition_mismatch', 0) t""",
    ),
    "quantile_report": (
        ("fx_scores",),
        """SELECT 'quantiles_out_of_order' AS rule, n AS n_rows, n = 0 AS passed FROM (
  SELECT COUNT(*) FILTER (q025 > q10 OR q10 > median OR median > q90 OR q90 > q975) AS n FROM fx_scores) t""",
    ),
    "stored_scores": (
        ("fx_scores",),
        f"SELECT {CELL}, round(observation, 6) AS observation, round(crps, 6) AS crps FROM fx_scores",
    ),
    "stored_targets": (
        ("fx_known",),
        "SELECT datetime, site_id, variable, round(observation, 6) AS observation FROM fx_known",
    ),
    "stored_models": (
        ("fx_models",),
        "SELECT model_id, manuscript_name, model_type, variable, NOAA_var, uses_NOAA, unc_driver, unc_process, dynamic FROM fx_models",
    ),
    "stored_csv": (
        ("fx_members",),
        """SELECT concat('lakes-', reference_datetime, '-', model_id) AS forecast, site_id, variable, COUNT(*) AS n, round(SUM(prediction), 6) AS total
FROM fx_members GROUP BY 1, 2, 3""",
    ),
    "stored_partitions": (
        ("fx_members",),
        "SELECT DISTINCT model_id, reference_datetime, datetime AS date FROM fx_members",
    ),
    "sound_forecasts": (
        ("fx_members",),
        f"""SELECT model_id, reference_datetime, datetime AS date, COUNT(*) AS n, round(SUM(prediction), 6) AS total FROM fx_members
WHERE NOT (model_id = '{R.BROKEN[0]}' AND reference_datetime = '{R.BROKEN[1]}' AND datetime = DATE '{R.BROKEN[2]}') GROUP BY 1, 2, 3""",
    ),
    "renamed_columns": (("fx_scores",), f"SELECT {CELL}, m, round(crps, 6) AS crps FROM fx_scores"),
    "first_skill_rows": (
        ("t_skill",),
        """SELECT reference_datetime, variable, site_id, model_id, datetime, horizon, round(skill_crps, 6) AS skill_crps FROM t_skill
ORDER BY reference_datetime NULLS LAST, site_id NULLS LAST, datetime NULLS LAST, model_id NULLS LAST, variable NULLS LAST LIMIT 6""",
    ),
    "incremental_ensemble": (
        ("mme",),
        "SELECT reference_datetime, site_id, datetime, variable, parameter, round(prediction, 6) AS prediction FROM mme",
    ),
    "incremental_scores": (("fx_scores",), f"SELECT {CELL}, m, round(crps, 6) AS crps FROM fx_scores"),
    "late_scores": (
        ("fx_scores",),
        f"SELECT {CELL}, round(observation, 6) AS observation, round(crps, 6) AS crps FROM fx_scores",
    ),
}


def oracle_sql() -> dict[str, str]:
    """Query name to SQL text."""
    out = {}
    for name, (tables, body) in SQL.items():
        text = _with(tables, body) if tables else body
        # a body with tables of its own continues the list of derived tables
        out[name] = text.replace(")\nWITH_NEXT ", "),\n")
    return out
