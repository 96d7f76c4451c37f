"""SQL twins of the bootstrap: the same counter-based draws, told as a recursion over the cells."""

from __future__ import annotations

from collections.abc import Sequence

from labelops.operators import bootstrap as BS


def _double(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def _horner(coefficients: Sequence[float], x: str) -> str:
    out = _double(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_double(c)})"
    return out


def drawn(source: str, keys: Sequence[str], cell: Sequence[str], n_bootstrap: int = BS.N_BOOTSTRAP, seed: int = BS.SEED,
          min_rows: int = BS.MIN_ROWS) -> list[str]:
    """CTEs ``numbered``, ``draws`` and ``drawn`` (keys, replicate, cell columns, n) over a CTE of cells. They need WITH RECURSIVE."""
    k = "".join(f"{x}, " for x in keys)
    on = "".join(f" AND d.{x} = c.{x}" for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    order = ", ".join(f"{x} NULLS FIRST" for x in cell)
    tail = "sqrt(-2 * ln(least(u, 1 - u)))"
    far = f"{_horner(BS.NORMAL_TAIL[0], 'tail')} / {_horner(BS.NORMAL_TAIL[1], 'tail')}"
    square = "((u - 0.5::DOUBLE) * (u - 0.5::DOUBLE))"
    centre = f"{_horner(BS.NORMAL_CENTRE[0], square)} * (u - 0.5::DOUBLE) / {_horner(BS.NORMAL_CENTRE[1], square)}"
    low = _double(BS.NORMAL_BREAK)
    return [
        f"""numbered AS (SELECT {k}{', '.join(cell)}, n::BIGINT AS n,
  row_number() OVER ({part}ORDER BY {order}) AS i, (sum(n) OVER ({part}))::BIGINT AS total,
  (sum(n) OVER ({part}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM {source})""",
        f"""draws AS (
  SELECT {k}r AS replicate, 0::BIGINT AS i, total AS left_, 0::BIGINT AS x
  FROM (SELECT DISTINCT {k}total FROM numbered WHERE total >= {min_rows}), range({n_bootstrap}) t(r)
  UNION ALL
  SELECT {k}replicate, i, left_ - x, x FROM (
    SELECT {k}replicate, i, left_, CASE WHEN n >= rest THEN left_ WHEN p > 0.5 THEN left_ - y ELSE y END AS x FROM (
      SELECT *, CASE WHEN var < {BS.EXACT_VARIANCE} THEN least(left_, list_reduce(
          list_prepend({{'term': exp(left_ * ln(1 - q)), 's': 0::DOUBLE, 'x': 0::BIGINT}},
            list_transform(range(0, least(left_, ceil(mean + 12 * sqrt(var) + 20)::BIGINT) + 1), lambda e: {{'term': 0::DOUBLE, 's': 0::DOUBLE, 'x': e}})),
          lambda a, b: {{'term': a.term * (left_ - b.x) / (b.x + 1) * (q / (1 - q)), 's': a.s + a.term,
                         'x': a.x + CASE WHEN a.s + a.term < u THEN 1 ELSE 0 END}}).x)
        ELSE least(left_, greatest(0, floor(mean + sqrt(var) * z + (1 - 2 * q) * (z * z - 1) / 6 + 0.5)::BIGINT)) END AS y
      FROM (SELECT *, left_ * q AS mean, left_ * q * (1 - q) AS var,
              CASE WHEN u < {low} THEN {far} WHEN u > 1 - {low} THEN -({far}) ELSE {centre} END AS z
            FROM (SELECT *, least(p, 1 - p) AS q, {tail} AS tail
                  FROM (SELECT {''.join(f'd.{x}, ' for x in keys)}d.replicate, c.i, d.left_, c.n, c.rest, c.n::DOUBLE / c.rest AS p,
                          (('0x' || substr(md5('{seed}|' || d.replicate || '|' || (c.i - 1)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
                        FROM draws d JOIN numbered c ON c.i = d.i + 1{on}))))))""",
        f"""drawn AS (SELECT {''.join(f'd.{x}, ' for x in keys)}d.replicate, {', '.join(f'c.{x}' for x in cell)}, d.x AS n
  FROM draws d JOIN numbered c ON c.i = d.i{on} WHERE d.x > 0)""",
    ]


#: accuracy, macro F1, weighted F1 and kappa of a CTE ``drawn`` (model, replicate, truth, pred, n)
MEASURES = [
    """sides AS (SELECT model, replicate, truth AS label, n AS support, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, 0 AS predicted FROM drawn
  UNION ALL SELECT model, replicate, pred, 0, 0, n FROM drawn)""",
    """labels_ AS (SELECT model, replicate, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted,
  2 * sum(tp)::DOUBLE / (sum(support) + sum(predicted)) AS f1 FROM sides WHERE label IS NOT NULL GROUP BY ALL)""",
    """measured AS (SELECT model, replicate, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1_macro,
  sum(f1 * support) / sum(support) AS f1_weighted, sum(support)::DOUBLE AS total, sum(tp)::DOUBLE AS hits,
  sum(support::DOUBLE * predicted::DOUBLE) AS chance FROM labels_ GROUP BY ALL)""",
]
KAPPA = "CASE WHEN chance / (total * total) < 1 THEN (hits / total - chance / (total * total)) / (1 - chance / (total * total)) END"


def summary(value: str, metric: str, source: str = "measured", keys: Sequence[str] = ("model",), level: float = BS.LEVEL, digits: int = 6) -> str:
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    of = f"SELECT {', '.join(keys)}, replicate, {value} AS value FROM {source}"
    return f"""SELECT {', '.join(keys)}, '{metric}' AS metric, round(avg(value), {digits}) AS mean, round(stddev_pop(value), {digits}) AS std,
  round(quantile_cont(value, {lo!r}), {digits}) AS ci_lower, round(quantile_cont(value, {hi!r}), {digits}) AS ci_upper,
  count(value) AS replicates FROM ({of}) GROUP BY ALL"""
