"""SQL of one-to-one assignment: edges taken one by one within groups that share no rows."""


def walk(name: str, edges: str, group: str, left: str, right: str, order: str) -> str:
    """CTEs whose last, ``{name}``, has the pairs (left, right) that serial greedy takes."""
    used = f"list_contains(ls, e.{left}) OR list_contains(rs, e.{right})"
    return f"""{name}_e AS (SELECT {left}, {right}, g, row_number() OVER (PARTITION BY g ORDER BY {order}) AS n FROM (SELECT *, {group} AS g FROM ({edges}))),
{name}_w AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs FROM {name}_e
  UNION ALL SELECT w.g, e.n, CASE WHEN {used} THEN ls ELSE list_append(ls, e.{left}) END, CASE WHEN {used} THEN rs ELSE list_append(rs, e.{right}) END
  FROM {name}_w AS w JOIN {name}_e AS e ON e.g = w.g AND e.n = w.n + 1),
{name} AS (SELECT unnest(ls) AS {left}, unnest(rs) AS {right} FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC) AS last FROM {name}_w) WHERE last = 1)"""
