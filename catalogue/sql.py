"""Building blocks of the checking SQL, written independently of the DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from thinjoin.functions.hashing import PRIME, Draws
from thinjoin.functions.rates import Rates

EVENTS = "(SELECT event_id, user_id, event_type, round(value * 100) AS cents FROM events)"
MOMENTS = {
    "ab": "a*b", "a2b": "a*a*b", "ab2": "a*b*b", "a2b2": "a*a*b*b",
    "xb": "x*b", "x2b": "x*x*b", "xb2": "x*b*b", "x2b2": "x*x*b*b",
    "sb": "s*b", "sb2": "s*b*b", "s2b": "s*s*b", "s2b2": "s*s*b*b",
    "qb": "q*b", "qb2": "q*b*b", "xsb": "x*s*b", "xsb2": "x*s*b*b",
}


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n"


def stats(source: str, key: str, measure: str, by: Sequence[str] = (), where: str = "true") -> str:
    group = ", ".join([*by, key])
    picked = ", ".join([*by, f"{key} AS key"])
    return (
        f"SELECT {picked}, CAST(count(*) AS DOUBLE) AS a, CAST(count({measure}) AS DOUBLE) AS x, "
        f"coalesce(sum({measure}), 0.0) AS s, coalesce(sum({measure}*{measure}), 0.0) AS q "
        f"FROM {source} WHERE {key} IS NOT NULL AND {where} GROUP BY {group}"
    )


def counts(source: str, key: str, name: str = "b", where: str = "true") -> str:
    return f"SELECT {key} AS key, CAST(count(*) AS DOUBLE) AS {name} FROM {source} WHERE {key} IS NOT NULL AND {where} GROUP BY {key}"


def moments(left: str = "ls", right: str = "rc", by: Sequence[str] = (), extra: str = "") -> str:
    sums = ", ".join(f"coalesce(sum({e}), 0.0) AS {n}" for n, e in MOMENTS.items())
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"SELECT {keys}{sums} FROM {left} JOIN {right} USING (key){extra}{group}"


def objective(agg: str, e1: float, e2: float) -> tuple[str, str]:
    if agg == "count":
        return f"{e1}::DOUBLE*{e2}::DOUBLE*(a2b2 - a2b - ab2 + ab)", "ab"
    if agg == "sum":
        return f"{e1}::DOUBLE*{e2}::DOUBLE*(s2b2 - s2b - qb2 + qb)", "qb"
    val1 = (
        "(qb + s2b2 - s2b - qb2)/(sb*sb) - 2*(1.0::DOUBLE/xb + (xsb2 - xsb - sb2)/(xb*sb)) "
        "+ (xb + x2b2 - x2b - xb2)/(xb*xb)"
    )
    return val1, f"(qb/(sb*sb) - 1.0::DOUBLE/xb)/({e1}::DOUBLE*{e2}::DOUBLE)"


def best(val1: str, val2: str, e1: float, e2: float) -> str:
    low = f"{max(e1, e2)}::DOUBLE"
    return (
        f"CASE WHEN {val1} <= 0 AND {val2} > 0 THEN {low} WHEN {val1} > 0 AND {val2} <= 0 THEN 1.0::DOUBLE "
        f"WHEN {val1} > 0 AND {val2} > 0 THEN least(1.0::DOUBLE, greatest({low}, sqrt({val1}/{val2}))) "
        f"WHEN {val1}/{low} + {val2}*{low} < {val1} + {val2} THEN {low} ELSE 1.0::DOUBLE END"
    )


def rates(moments_name: str, agg: str, e1: float, e2: float, keep: str = "") -> str:
    val1, val2 = objective(agg, e1, e2)
    return rates_from(f"SELECT {keep}{val1} AS val1, {val2} AS val2 FROM {moments_name}", e1, e2)


def rates_from(values: str, e1: float, e2: float) -> str:
    return (
        f"SELECT *, {e1}::DOUBLE/p AS q1, {e2}::DOUBLE/p AS q2 FROM "
        f"(SELECT *, {best('val1', 'val2', e1, e2)} AS p FROM ({values}))"
    )


def variance(agg: str, p: str, e1: str, e2: str) -> str:
    w = (f"(1.0/{p} - 1)", f"(1.0/{e2} - 1.0/{p})", f"(1.0/{e1} - 1.0/{p})",
         f"({p}/({e1}*{e2}) - 1.0/{e1} - 1.0/{e2} + 1.0/{p})")

    def form(*names: str) -> str:
        return "(" + " + ".join(f"{a}*{b}" for a, b in zip(w, names, strict=True)) + ")"

    if agg == "count":
        return form("a2b2", "a2b", "ab2", "ab")
    sums = form("s2b2", "s2b", "qb2", "qb")
    if agg == "sum":
        return sums
    cross, cnt = form("xsb2", "xsb", "sb2", "sb"), form("x2b2", "x2b", "xb2", "xb")
    return f"(sb/xb)*(sb/xb)*({sums}/(sb*sb) - 2*{cross}/(sb*xb) + {cnt}/(xb*xb))"


def draws(d: Draws) -> str:
    """The draws' numbers as a table."""
    rows = d.rows()
    body = ", ".join("(" + ", ".join(_literal(k, v) for k, v in row.items()) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(rows[0])})"


def _literal(name: str, value) -> str:
    if name in ("preset", "replicate"):
        return f"{value}::INTEGER"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else f"{value}::BIGINT"


def hashed(columns: Sequence[str], role: str) -> str:
    parts = []
    for c in columns:
        parts += [f"({c}::BIGINT & {PRIME})", f"(({c}::BIGINT >> 31) & {PRIME})"]
    value = f"{role}_3"
    for i in (2, 1, 0):
        value = f"(({value}*{parts[0]} + {role}_{i}) % {PRIME})"
    for i, part in enumerate(parts[1:]):
        value = f"(({value} + {role}_{4 + i}*{part}) % {PRIME})"
    return value


def below(columns: Sequence[str], role: str, rate: str) -> str:
    return f"{hashed(columns, role)} < ({rate})*{float(PRIME)!r}::DOUBLE"


def sample(source: str, key: str, ids: Sequence[str], role: str, p: str, q: str, columns: str, draw: str = "draws") -> str:
    return (
        f"SELECT preset, replicate, {columns} FROM {source} CROSS JOIN {draw} "
        f"WHERE {below([key], 'key', p)} AND {below(ids, role, q)}"
    )


def totals(left: str, right: str, left_key: str, right_key: str, measure: str, by: Sequence[str] = (), where: str = "true") -> str:
    """Unscaled joined rows and sums per draw, by joining the sample rows."""
    keys = ", ".join(["l.preset", "l.replicate", *[f"l.{b}" for b in by]])
    return (
        f"SELECT {keys}, CAST(count(*) AS DOUBLE) AS n_join, CAST(count(l.{measure}) AS DOUBLE) AS x_join, "
        f"sum(l.{measure}) AS s_join FROM {left} l JOIN {right} r ON l.preset = r.preset AND l.replicate = r.replicate "
        f"AND l.{left_key} = r.{right_key} WHERE {where} GROUP BY {keys}"
    )


def estimates(totals_name: str, scale: str, draw: str = "draws", keep: str = "") -> str:
    return (
        f"SELECT d.preset, d.replicate, {keep}coalesce(n_join*({scale}), 0.0) AS count_estimate, "
        f"coalesce(s_join*({scale}), 0.0) AS sum_estimate, coalesce(s_join/x_join, 0.0) AS avg_estimate "
        f"FROM {draw} d LEFT JOIN {totals_name} t ON d.preset = t.preset AND d.replicate = t.replicate"
    )


def scale(r: Rates) -> str:
    return repr(1.0 / (r.p * r.q1 * r.q2)) + "::DOUBLE"


NUDGE = 1.0 + 2.0**-40


def significant(sql: str, names: Sequence[str]) -> str:
    """Round doubles to ten significant digits, as the DataFrame side does.

    Values that lie exactly between two roundings, as variances of two whole numbers often do, are rounded up by one
    engine and to even by the other; a push of one part in 10^12 takes them off the middle on both sides.
    """
    if not names:
        return sql
    body = ", ".join(f"CAST(printf('%.9e', {n}*{NUDGE!r}::DOUBLE) AS DOUBLE) AS {n}" for n in names)
    return f"SELECT * REPLACE ({body}) FROM ({sql})"
