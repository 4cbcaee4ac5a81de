"""Builders of the SQL that the queries are compared with: set-oriented, on whole tables, by other means."""

from __future__ import annotations

import numpy as np

LATTICE_2D = "pts AS (SELECT CAST(l_quantity AS BIGINT) AS x0, CAST(round(l_discount * 100) AS BIGINT) AS x1, count(*) AS w, CAST(l_quantity AS BIGINT) * 1000 + CAST(round(l_discount * 100) AS BIGINT) AS id FROM lineitem GROUP BY 1, 2)"
LATTICE_3D = "pts AS (SELECT CAST(l_quantity AS BIGINT) AS x0, CAST(round(l_discount * 100) AS BIGINT) AS x1, CAST(round(l_tax * 100) AS BIGINT) AS x2, count(*) AS w, (CAST(l_quantity AS BIGINT) * 1000 + CAST(round(l_discount * 100) AS BIGINT)) * 1000 + CAST(round(l_tax * 100) AS BIGINT) AS id FROM lineitem GROUP BY 1, 2, 3)"


def values(name: str, c: np.ndarray) -> str:
    rows = ", ".join(f"({j}, {', '.join(f'CAST({v!r} AS DOUBLE)' for v in row)})" for j, row in enumerate(c.tolist()))
    return f"{name}(j, {', '.join(f'c{t}' for t in range(c.shape[1]))}) AS (VALUES {rows})"


def gap(one: str, other: str, d: int, left: str = "x", right: str = "c") -> str:
    return "sqrt(" + " + ".join(f"({one}.{left}{t} - {other}.{right}{t}) * ({one}.{left}{t} - {other}.{right}{t})" for t in range(d)) + ")"


def first_assignment(d: int, points: str = "pts", centroids: str = "c0", name: str = "a0") -> str:
    return f"{name} AS (SELECT * EXCLUDE (r, j), j AS a FROM (SELECT p.*, c.j, {gap('p', 'c', d)} AS d, row_number() OVER (PARTITION BY p.id ORDER BY {gap('p', 'c', d)}, c.j) AS r FROM {points} p, {centroids} c) WHERE r = 1)"


def lloyd(points: str, c: np.ndarray, rounds: int) -> str:
    """CTEs pts, c0, a0, c1, a1 ... with labels a and whether they changed."""
    d = c.shape[1]
    parts = [points, values("c0", c), f"a0 AS MATERIALIZED (SELECT * EXCLUDE (r, j), j AS a, 0 AS ch FROM (SELECT p.*, c.j, row_number() OVER (PARTITION BY p.id ORDER BY {gap('p', 'c', d)}, c.j) AS r FROM pts p, c0 c) WHERE r = 1)"]
    for i in range(1, rounds + 1):
        means = ", ".join(f"CAST(sum(w * x{t}) AS DOUBLE) / sum(w) AS m{t}" for t in range(d))
        parts.append(f"c{i} AS MATERIALIZED (SELECT j, {', '.join(f'coalesce(m{t}, c{t}) AS c{t}' for t in range(d))} FROM c{i - 1} LEFT JOIN (SELECT a, {means} FROM a{i - 1} GROUP BY a) ON a = j)")
        axes = ", ".join(f"p.x{t}" for t in range(d))
        order = f"{gap('p', 'c', d)}, CAST(c.j <> p.a AS INTEGER), c.j"
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, w, {axes.replace('p.', '')}, j AS a, CAST(j <> old AS INTEGER) AS ch FROM (SELECT p.id, p.w, {axes}, p.a AS old, c.j, row_number() OVER (PARTITION BY p.id ORDER BY {order}) AS r FROM a{i - 1} p, c{i} c) WHERE r = 1)")
    return ", ".join(parts)


def sizes(d: int, state: str) -> str:
    return "CAST(a AS INTEGER) AS cluster, CAST(sum(w) AS BIGINT) AS n_points, " + ", ".join(f"CAST(sum(w * x{t}) AS DOUBLE) AS sum_{t}" for t in range(d)) + f" FROM {state} GROUP BY a"


def full_run(points: str, c: np.ndarray, rounds: int) -> str:
    """Final sizes and the number of iterations: the first round without a change."""
    changes = " UNION ALL ".join(f"SELECT {i} AS i, sum(ch) AS ch FROM a{i}" for i in range(1, rounds + 1))
    return f"WITH {lloyd(points, c, rounds)} SELECT (SELECT CAST(min(i) AS INTEGER) FROM ({changes}) WHERE ch = 0) AS iterations, {sizes(c.shape[1], f'a{rounds}')}"


def nearest_of(d: int, points: str, centroids: str, current: str | None = None) -> str:
    """(id, x0 ..., old, a): the nearest centroid of each point; the current one, then the lowest number goes before equally near ones."""
    axes = ", ".join(f"any_value(p.x{t}) AS x{t}" for t in range(d))
    stays = f"c.j <> p.{current}" if current else "true"
    return f"SELECT p.id, {axes}, {f'any_value(p.{current})' if current else 'NULL'} AS old, CAST(min(ROW({gap('p', 'c', d)}, {stays}, c.j)) AS STRUCT(d DOUBLE, s BOOLEAN, j BIGINT)).j AS a FROM {points} p, {centroids} c GROUP BY p.id"


def means(d: int, labels: str, centroids: str) -> str:
    columns = ", ".join(f"CAST(sum(x{t}) AS DOUBLE) / count(*) AS m{t}" for t in range(d))
    return f"SELECT j, {', '.join(f'coalesce(m{t}, c{t}) AS c{t}' for t in range(d))} FROM {centroids} LEFT JOIN (SELECT a, {columns} FROM {labels} GROUP BY a) ON a = j"


def rounds_from(start: str, d: int, rounds: int) -> str:
    """CTEs of ``start`` (pts, c0), then a0, c1, a1 ..."""
    parts = [start, f"a0 AS MATERIALIZED ({nearest_of(d, 'pts', 'c0')})"]
    for i in range(1, rounds + 1):
        parts += [f"c{i} AS MATERIALIZED ({means(d, f'a{i - 1}', f'c{i - 1}')})", f"a{i} AS MATERIALIZED ({nearest_of(d, f'a{i - 1}', f'c{i}', 'a')})"]
    return ", ".join(parts)


def first_still(rounds: int) -> str:
    """The first round without a change."""
    changes = " UNION ALL ".join(f"SELECT {i} AS i, count(*) FILTER (a <> old) AS ch FROM a{i}" for i in range(1, rounds + 1))
    return f"(SELECT CAST(min(i) AS INTEGER) FROM ({changes}) WHERE ch = 0)"


def cluster_sizes(d: int, labels: str) -> str:
    return "CAST(a AS INTEGER) AS cluster, count(*) AS n_points, " + ", ".join(f"CAST(sum(x{t}) AS DOUBLE) AS sum_{t}" for t in range(d)) + f" FROM {labels} GROUP BY a"


def _minor(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    terms = [f"{'-' if i % 2 else '+'} {x} * ({_minor([r[:i] + r[i + 1 :] for r in rows[1:]])})" for i, x in enumerate(rows[0])]
    return " ".join(terms).removeprefix("+ ")


def empty_spheres(d: int, points: str, name: str = "e", group: str = "0") -> str:
    """CTE e (g, j, h): edges of the simplices of ``points`` (j, c0 ...; within a ``group``) whose sphere holds no other point, in whole numbers."""
    names = "uvwxy"[: d + 1]
    lift = ", ".join(f"CAST(c{t} AS HUGEINT) AS c{t}" for t in range(d))
    square = " + ".join(f"CAST(c{t} AS HUGEINT) * CAST(c{t} AS HUGEINT)" for t in range(d))
    rows = [[f"({n}.c{t} - u.c{t})" for t in range(d)] + [f"({n}.q - u.q)"] for n in names[1:]]
    flat = [f"({'-' if (i + d) % 2 else ''}({_minor([r[:i] + r[i + 1 :] for r in rows])})) AS n{i}" for i in range(d + 1)]
    inside = " + ".join([f"s.n{t} * (p.c{t} - s.b{t})" for t in range(d)] + [f"s.n{d} * (p.q - s.bq)"])
    edges = " UNION ".join(f"SELECT g, {a} AS j, {b} AS h FROM {name}_empty" for a in names for b in names if a != b)
    joins = " ".join(f"JOIN {name}_lifted {b} ON {b}.g = {a}.g AND {b}.j > {a}.j" for a, b in zip(names, names[1:]))
    return (
        f"{name}_lifted AS MATERIALIZED (SELECT {group} AS g, j, {lift}, {square} AS q FROM {points}), "
        f"{name}_simplices AS MATERIALIZED (SELECT u.g, {', '.join(f'{n}.j AS {n}' for n in names)}, {', '.join(f'u.c{t} AS b{t}' for t in range(d))}, u.q AS bq, {', '.join(flat)} FROM {name}_lifted u {joins}), "
        f"{name}_empty AS MATERIALIZED (SELECT * FROM {name}_simplices s WHERE s.n{d} <> 0 AND NOT EXISTS (SELECT 1 FROM {name}_lifted p WHERE p.g = s.g AND p.j NOT IN ({', '.join(f's.{n}' for n in names)}) AND ({inside}) * sign(s.n{d}) < 0)), "
        f"{name} AS MATERIALIZED (SELECT DISTINCT g, CAST(j AS INTEGER) AS j, CAST(h AS INTEGER) AS h FROM ({edges}))"
    )
