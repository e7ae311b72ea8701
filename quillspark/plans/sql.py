"""SQL for iterated fits: each iteration or tree level is one more common table expression."""

from __future__ import annotations

from collections.abc import Sequence


def kmeans(source: str, features: Sequence[str], init: Sequence[Sequence[float]] | str, iterations: int) -> str:
    """CTEs c0..cN (id, x0..) and a_k; empty clusters go to the origin. `init` are centroids, or CTEs that end in c0."""
    d = len(features)
    xs = ", ".join(f"x{j}" for j in range(d))
    out = [f"pts AS (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS x{j}' for j, f in enumerate(features))} FROM {source})"]
    out.append(init if isinstance(init, str) else f"c0(id, {xs}) AS (VALUES {', '.join('(' + ', '.join([str(i), *(f'CAST({x!r} AS DOUBLE)' for x in c)]) + ')' for i, c in enumerate(init))})")
    for t in range(1, iterations + 1):
        distance = " + ".join(f"(p.x{j} - c.x{j}) * (p.x{j} - c.x{j})" for j in range(d))
        best = f"(SELECT list_min(list({{'d': {distance}, 'i': c.id}})) FROM c{t - 1} c)"
        out.append(f"a{t} AS (SELECT p.*, {best}.i AS cl FROM pts p)")
        means = ", ".join(f"avg(x{j}) AS x{j}" for j in range(d))
        out.append(f"m{t} AS (SELECT cl, {means} FROM a{t} GROUP BY cl)")
        out.append(f"c{t} AS (SELECT c.id, {', '.join(f'coalesce(m.x{j}, 0.0) AS x{j}' for j in range(d))} FROM c{t - 1} c LEFT JOIN m{t} m ON m.cl = c.id)")
    return ",\n".join(out)


def kmeans_seeds(source: str, key: str, features: Sequence[str], k: int, draws: int, rounds: int = 2, seed: int = 42) -> str:
    """CTEs that end in c0 (id, x0..): seeds of rows whose id is `key`, from rounds of about `draws` draws."""
    d = len(features)
    xs = [f"x{j}" for j in range(d)]
    names = ", ".join(xs)
    away = lambda a, b: " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in xs)
    unit = lambda step: f"((('0x' || substr(md5('{seed}:{step}:' || own::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    out = [f"own AS (SELECT {key} AS own, {', '.join(f'CAST({f} AS DOUBLE) AS {x}' for f, x in zip(features, xs, strict=True))} FROM {source})", f"drawn0 AS (SELECT -1 AS round, * FROM own ORDER BY {unit('first')}, own LIMIT 1)"]
    for r in range(rounds):
        out.append(f"far{r} AS (SELECT p.*, (SELECT min({away('p', 'c')}) FROM drawn{r} c) AS d FROM own p)")
        fresh = f"SELECT {r} AS round, own, {names} FROM far{r}, (SELECT sum(d) AS whole FROM far{r}) WHERE d > 0 AND {unit(f'draw{r}')} < d * ({draws} / whole) QUALIFY row_number() OVER (PARTITION BY {names} ORDER BY own) = 1"
        out.append(f"drawn{r + 1} AS (SELECT * FROM drawn{r} UNION ALL {fresh})")
    out.append(f"ranked AS (SELECT *, row_number() OVER (ORDER BY round, own) - 1 AS i FROM drawn{rounds})")
    out.append(f"near AS (SELECT (SELECT list_min(list({{'d': {away('p', 'c')}, 'i': c.i}})) FROM ranked c).i AS i FROM own p)")
    out.append("left0 AS (SELECT r.*, w.n AS mass, CAST('inf' AS DOUBLE) AS d FROM ranked r JOIN (SELECT i, count(*) AS n FROM near GROUP BY i) w USING (i))")
    for step in range(k):
        mass = "mass" if step == 0 else "mass * d"
        out.append(f"best{step} AS (SELECT * FROM left{step} ORDER BY CASE WHEN {mass} > 0 THEN ln({unit(f'seed{step}')}) / ({mass}) END DESC NULLS LAST, i LIMIT 1)")
        out.append(f"left{step + 1} AS (SELECT l.* REPLACE (least(l.d, {away('l', 'b')}) AS d) FROM left{step} l, best{step} b)")
    out.append("c0 AS (" + " UNION ALL ".join(f"SELECT {step} AS id, {names} FROM best{step}" for step in range(k)) + ")")
    return ",\n".join(out)


def kmeans_query(source: str, features: Sequence[str], init: Sequence[Sequence[float]] | str, iterations: int) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST(id AS INTEGER) AS cluster, CAST({j} AS INTEGER) AS dimension, round(x{j}, 6) AS value FROM c{iterations}" for j in range(len(features)))
    return f"WITH {kmeans(source, features, init, iterations)}\n{rows}"


def logistic(source: str, features: Sequence[str], label: str, epochs: int, rate: float, l2: float) -> str:
    """CTEs xs (x0.., y) and w0..wN (w0.., b)."""
    d = len(features)
    out = [f"xs AS (SELECT {', '.join(f'{f} AS x{j}' for j, f in enumerate(features))}, {label} AS y FROM {source})", f"w0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS w{j}' for j in range(d))}, CAST(0 AS DOUBLE) AS b)"]
    for t in range(epochs):
        z = " + ".join(f"x{j} * w{j}" for j in range(d)) + " + b"
        out.append(f"p{t} AS (SELECT xs.*, CASE WHEN {z} > 20 THEN 1.0 WHEN {z} < -20 THEN 0.0 ELSE 1.0 / (1.0 + exp(-({z}))) END - CASE WHEN y > 0.5 THEN 1.0 ELSE 0.0 END AS off FROM xs, w{t})")
        out.append(f"g{t} AS (SELECT avg(off) AS gb, {', '.join(f'avg(off * x{j}) AS g{j}' for j in range(d))} FROM p{t})")
        step = rate / (1 + 0.01 * t)
        out.append(f"w{t + 1} AS (SELECT {', '.join(f'w{j} - CAST({step!r} AS DOUBLE) * (g{j} + CAST({l2!r} AS DOUBLE) * w{j}) AS w{j}' for j in range(d))}, b - CAST({step!r} AS DOUBLE) * gb AS b FROM w{t}, g{t})")
    return ",\n".join(out)


def _gini(n: str, p: str) -> str:
    return f"(1.0 - ({p} / {n}) * ({p} / {n}) - (1.0 - {p} / {n}) * (1.0 - {p} / {n}))"


def split(name: str, source: str, d: int) -> str:
    """CTE <name> (f, t, gain): the best split of `source` (pos, y, f0..), no row if there is none. Helpers carry its name."""
    values = " UNION ALL ".join(f"SELECT {i} AS f, rk, f{i} AS t FROM {name}_r, {name}_s WHERE rk % greatest(1, n // 32) = 0" for i in range(d))
    pick = "CASE c.f " + " ".join(f"WHEN {i} THEN r.f{i}" for i in range(d)) + " END"
    gain = f"{_gini('n', 'p')} - (nl / n) * {_gini('nl', 'pl')} - ((n - nl) / n) * {_gini('(n - nl)', '(p - pl)')}"
    return ",\n".join(
        [
            f"{name}_r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rk FROM {source})",
            f"{name}_s AS (SELECT count(*) AS n, coalesce(sum(y), 0) AS p FROM {source})",
            f"{name}_c AS ({values})",
            f"{name}_k AS (SELECT c.f, c.rk, c.t, CAST(sum(CASE WHEN {pick} <= c.t THEN 1 ELSE 0 END) AS DOUBLE) AS nl, CAST(sum(CASE WHEN {pick} <= c.t THEN r.y ELSE 0 END) AS DOUBLE) AS pl FROM {name}_c c, {name}_r r GROUP BY c.f, c.rk, c.t)",
            f"{name}_g AS (SELECT f, rk, t, {gain} AS gain FROM (SELECT k.*, CAST(s.n AS DOUBLE) AS n, CAST(s.p AS DOUBLE) AS p FROM {name}_k k, {name}_s s WHERE s.n >= 2 AND s.p > 0 AND s.p < s.n) WHERE nl > 0 AND nl < n)",
            f"{name} AS (SELECT f, t, gain FROM {name}_g WHERE gain > 1e-6 ORDER BY gain DESC, f, rk LIMIT 1)",
        ]
    )


def side(name: str, source: str, splits: str, d: int, left: bool) -> str:
    """CTE of the rows of `source` that go to one side of a split."""
    pick = "CASE s.f " + " ".join(f"WHEN {i} THEN r.f{i}" for i in range(d)) + " END"
    return f"{name} AS (SELECT r.* FROM {source} r, {splits} s WHERE {'' if left else 'NOT '}({pick} <= s.t))"


def tree(name: str, source: str, d: int, depth: int) -> str:
    """CTE <name> (node, f, t, value) of a tree of `source`: nodes numbered as in a heap, f null in leaves."""
    out, nodes = [], []
    for i in range(2 ** (depth + 1) - 1):
        rows = f"{name}_rows{i}" if i else source
        if i:
            out.append(side(rows, f"{name}_rows{(i - 1) // 2}" if i > 2 else source, f"{name}_at{(i - 1) // 2}", d, i % 2 == 1))
        inner = i < 2**depth - 1
        if inner:
            out.append(split(f"{name}_at{i}", rows, d))
        leaf = f"(SELECT CASE WHEN 2 * sum(y) >= count(*) THEN 1.0::DOUBLE WHEN count(*) > 0 THEN 0.0::DOUBLE END FROM {rows})"
        found = f"(SELECT {{}} FROM {name}_at{i})" if inner else "NULL"
        nodes.append(f"SELECT {i} AS node, {found.format('f')} AS f, {found.format('t')} AS t, {leaf} AS value")
    return ",\n".join([*out, f"{name} AS ({' UNION ALL '.join(nodes)})"])


def routed(name: str, source: str, splits: str, d: int, depth: int) -> str:
    """CTE <name>: the rows of `source` with `value`, what the tree `splits` gives them."""
    pick = "CASE s.f " + " ".join(f"WHEN {i} THEN r.f{i}" for i in range(d)) + " END"
    out = [f"{name}_0 AS (SELECT *, 0 AS node FROM {source})"]
    for k in range(depth):
        out.append(f"{name}_{k + 1} AS (SELECT r.* REPLACE (CASE WHEN s.f IS NULL THEN r.node WHEN {pick} <= s.t THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node) FROM {name}_{k} r JOIN {splits} s USING (node))")
    return ",\n".join([*out, f"{name} AS (SELECT r.*, s.value FROM {name}_{depth} r JOIN {splits} s USING (node))"])
