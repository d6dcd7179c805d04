"""SQL twins: DuckDB text for the queries that SQL can express."""

from __future__ import annotations

PX = "px AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"
QX = "qx AS (SELECT *, least(greatest(floor((v + 1) / 2.0 * 255.5), 0), 255)::INT AS q FROM px)"


def _at(axis: str, mode: str) -> str:
    i = f"(p.{axis} + d{axis})"
    if mode == "reflect":
        return f"CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} > 7 THEN 15 - {i} ELSE {i} END"
    if mode == "mirror":
        return f"CASE WHEN {i} < 0 THEN -{i} WHEN {i} > 7 THEN 14 - {i} ELSE {i} END"
    if mode == "nearest":
        return f"least(greatest({i}, 0), 7)"
    if mode == "wrap":
        return f"(({i} + 64) % 8)"
    return i  # constant 0 drops the tap


def step(source: str, name: str, taps: list[tuple[int, int, float]], value: str = "sum(w * q.v)", mode: str = "reflect") -> str:
    """A CTE ``name``: each pixel's aggregate over its taps in ``source``."""
    rows = ", ".join(f"({a}, {b}, {float(w)!r}::DOUBLE)" for a, b, w in taps)
    return f"{name} AS (SELECT p.image_id, p.y, p.x, {value} AS v FROM {source} p CROSS JOIN (VALUES {rows}) AS t(dy, dx, w) JOIN {source} q ON q.image_id = p.image_id AND q.y = {_at('y', mode)} AND q.x = {_at('x', mode)} GROUP BY p.image_id, p.y, p.x)"


def pixels(*ctes: str, value: str = "v", source: str | None = None) -> str:
    last = source or ctes[-1].split(" AS ")[0]
    return f"WITH {', '.join([PX, *ctes])} SELECT image_id, y, x, round({value}, 6) + 0.0 AS v FROM {last}"


BOX = [(a, b, 1 / 9) for a in (-1, 0, 1) for b in (-1, 0, 1)]
ONE = [(a, b, 1) for a, b, _ in BOX]
CROSS = [(0, 0, 1), (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)]


def outer(a: list[tuple[int, float]], b: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    return [(i, j, u * w) for i, u in a for j, w in b if u * w]


def odd(values) -> list[tuple[int, float]]:
    r = len(values) // 2
    return [(k - r, v) for k, v in enumerate(values)]


def linear(taps, mode: str = "reflect") -> str:
    value = "sum(w * q.v)" if mode != "constant" else "coalesce(sum(w * q.v), 0)"
    return pixels(step("px", "f", taps, value, mode))


def chain(*aggs: str, taps=ONE) -> str:
    """Aggregates over the 3x3 window, one after another."""
    ctes, source = [], "px"
    for k, agg in enumerate(aggs):
        ctes.append(step(source, f"s{k}", taps, f"{agg}(q.v)"))
        source = f"s{k}"
    return pixels(*ctes)


def two(first: str, second: str, combine: str) -> str:
    """Combines two stages (CTEs a and b) and the image p pixel by pixel."""
    return f"WITH {PX}, {first}, {second} SELECT p.image_id, p.y, p.x, round({combine}, 6) + 0.0 AS v FROM px p JOIN a USING (image_id, y, x) JOIN b USING (image_id, y, x)"
