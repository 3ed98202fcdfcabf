"""Plain-SQL statements of the operators, for checking against DuckDB.

Each builder returns SQL text over the views ``events``, ``orders`` and
``lineitem``. The statements are written the straightforward way (window
ranks, unrolled k-core rounds, a full user x item score table, one CTE per
coordinate of a half-step), which is exactly what the Spark plans avoid at
scale; they are brute-force references for small inputs.
"""

from __future__ import annotations

from ..config import ModelConfig

EV_SQL = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS item_id,
         epoch_us(ts) AS ts
  FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL
    AND json_extract_string(props, '$.k') IS NOT NULL)"""

OL_SQL = """ol AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_partkey AS VARCHAR) AS item_id,
         epoch_us(o.o_orderdate) AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_custkey IS NOT NULL AND l.l_partkey IS NOT NULL AND o.o_orderdate IS NOT NULL)"""


def r(expr: str, places: int) -> str:
    return f"(round({expr}, {places}) + 0.0)"


def dedup_cte(src: str, name: str = "dd") -> str:
    return f"{name} AS (SELECT user_id, item_id, max(ts) AS ts FROM {src} GROUP BY user_id, item_id)"


def min_count_cte(src: str, key: str, k: int, name: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT * FROM {src} WHERE {key} IN "
            f"(SELECT {key} FROM {src} GROUP BY {key} HAVING count(*) >= {k}))")


def kcore_ctes(src: str, ku: int, ki: int, rounds: int = 12, name: str = "kc") -> list[str]:
    """Unrolled rounds (users, then items); extra rounds past the fixpoint are
    no-ops. The statement fails if the last round still removes a row."""
    ctes = []
    prev = src
    for i in range(1, rounds + 1):
        ctes.append(min_count_cte(prev, "user_id", ku, f"kc{i}u"))
        ctes.append(min_count_cte(f"kc{i}u", "item_id", ki, f"kc{i}"))
        prev = f"kc{i}"
    ctes.append(
        f"{name} AS (SELECT * FROM {prev} WHERE CASE WHEN (SELECT count(*) FROM {prev}) = "
        f"(SELECT count(*) FROM kc{rounds - 1}) THEN true "
        f"ELSE error('k-core not reached in {rounds} rounds') END)")
    return ctes


def index_ctes(src: str) -> list[str]:
    return [
        f"uix AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) "
        f"AS user_idx FROM (SELECT DISTINCT user_id FROM {src}) t)",
        f"iix AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) "
        f"AS item_idx FROM (SELECT DISTINCT item_id FROM {src}) t)",
        f"ix AS (SELECT u.user_idx, i.item_idx, s.ts FROM {src} s "
        f"JOIN uix u ON u.user_id = s.user_id JOIN iix i ON i.item_id = s.item_id)",
    ]


def split_ctes() -> list[str]:
    return [
        "ranked AS (SELECT user_idx, item_idx, ts, row_number() OVER (PARTITION BY user_idx "
        "ORDER BY ts DESC, item_idx DESC) AS rn, count(*) OVER (PARTITION BY user_idx) AS n "
        "FROM ix)",
        "test AS (SELECT user_idx, item_idx AS test_item_idx, CAST(n - 1 AS BIGINT) AS n_train "
        "FROM ranked WHERE rn = 1)",
        "train AS (SELECT user_idx, item_idx FROM ranked WHERE rn > 1)",
    ]


def weight_ctes(c0: float, alpha: float) -> list[str]:
    return [
        "cnt AS (SELECT item_idx, count(*) AS n FROM train GROUP BY item_idx)",
        f"wt AS (SELECT item_idx, {float(c0)!r} * pow(CAST(n AS DOUBLE), {float(alpha)!r}) / "
        f"(SELECT sum(pow(CAST(n AS DOUBLE), {float(alpha)!r})) FROM cnt) AS c FROM cnt)",
        "hist AS (SELECT t.user_idx, t.item_idx, w.c FROM train t JOIN wt w "
        "ON w.item_idx = t.item_idx)",
    ]


def prepared_ctes(source: str, m: ModelConfig) -> list[str]:
    """ev/ol -> dedup -> k-core -> index -> split -> weights -> hist."""
    src_cte, src = (EV_SQL, "ev") if source == "ev" else (OL_SQL, "ol")
    return ([src_cte, dedup_cte(src)]
            + kcore_ctes("dd", m.min_user_interactions, m.min_item_interactions)
            + index_ctes("kc") + split_ctes() + weight_ctes(m.c0, m.alpha))


def _normal_expr(seed: int, tag: str, idx: str, f: int, mean: float, std: float) -> str:
    key = f"md5(concat_ws(':', '{seed}', '{tag}', CAST({idx} AS VARCHAR), '{f}'))"
    h1 = f"CAST(CAST(('0x' || substr({key}, 1, 8)) AS BIGINT) AS DOUBLE)"
    h2 = f"CAST(CAST(('0x' || substr({key}, 9, 8)) AS BIGINT) AS DOUBLE)"
    u1 = f"(({h1} + 1.0) / 4294967297.0)"
    u2 = f"({h2} / 4294967296.0)"
    z = f"(sqrt(-2.0 * ln({u1})) * cos((2.0 * pi()) * {u2}))"
    return f"({float(mean)!r} + {float(std)!r} * {z})"


def xs(k: int, alias: str = "") -> list[str]:
    pre = f"{alias}." if alias else ""
    return [f"{pre}x{f}" for f in range(k)]


def init_ctes(m: ModelConfig) -> list[str]:
    k = m.factors
    pu = ", ".join(_normal_expr(m.random_seed, "user", "user_idx", f, m.init_mean, m.init_std)
                   + f" AS x{f}" for f in range(k))
    qi = ", ".join(_normal_expr(m.random_seed, "item", "item_idx", f, m.init_mean, m.init_std)
                   + f" AS x{f}" for f in range(k))
    return [f"p0 AS MATERIALIZED (SELECT user_idx AS idx, {pu} FROM uix)",
            f"q0 AS MATERIALIZED (SELECT item_idx AS idx, {qi} FROM iix)"]


def gram_cte(name: str, vecs: str, k: int, weighted: bool) -> str:
    w = "coalesce(w.c, 0.0) * " if weighted else ""
    cols = ", ".join(f"sum({w}v.x{f} * v.x{g}) AS s{f}_{g}" for f in range(k) for g in range(k))
    join = " LEFT JOIN wt w ON w.item_idx = v.idx" if weighted else ""
    return f"{name} AS (SELECT {cols} FROM {vecs} v{join})"


def gram_long(name: str, k: int, places: int = 9) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({f} AS BIGINT) AS f, CAST({g} AS BIGINT) AS g, {r(f's{f}_{g}', places)} "
        f"AS v FROM {name}" for f in range(k) for g in range(k))


def half_step_ctes(prefix: str, side: str, cur: str, other: str, gram: str,
                   m: ModelConfig) -> tuple[list[str], str]:
    """One coordinate sweep, one CTE per coordinate; returns (ctes, final name)."""
    k = m.factors
    w, rv, lam = float(m.observed_weight), float(m.observed_value), float(m.reg_lambda)
    e_col, o_col = ("user_idx", "item_idx") if side == "user" else ("item_idx", "user_idx")
    ctes = [f"{prefix}0 AS (SELECT idx, {', '.join(xs(k))} FROM {cur})"]
    for f in range(k):
        prev = f"{prefix}{f}"
        rhat = " + ".join(f"x.x{j} * y.x{j}" for j in range(k))
        agg = (f"SELECT h.{e_col} AS idx, "
               f"sum(({w!r} * {rv!r} - ({w!r} - h.c) * (({rhat}) - x.x{f} * y.x{f})) * y.x{f}) "
               f"AS num, sum(({w!r} - h.c) * y.x{f} * y.x{f}) AS den, max(h.c) AS m "
               f"FROM hist h JOIN {prev} x ON x.idx = h.{e_col} JOIN {other} y ON y.idx = h.{o_col} "
               f"GROUP BY h.{e_col}")
        cache = " + ".join(f"x.x{j} * s.s{j}_{f}" for j in range(k) if j != f) or "0.0"
        mult = "1.0" if side == "user" else "a.m"
        new = (f"CASE WHEN a.idx IS NULL THEN x.x{f} ELSE (a.num - {mult} * ({cache})) / "
               f"(a.den + {mult} * s.s{f}_{f} + {lam!r}) END AS x{f}")
        cols = [new if j == f else f"x.x{j}" for j in range(k)]
        ctes.append(f"{prefix}{f + 1} AS MATERIALIZED (SELECT x.idx, {', '.join(cols)} "
                    f"FROM {prev} x CROSS JOIN {gram} s LEFT JOIN ({agg}) a ON a.idx = x.idx)")
    return ctes, f"{prefix}{k}"


def vec_long(name: str, k: int, places: int, side: str | None = None) -> str:
    side_col = f"'{side}' AS side, " if side else ""
    return " UNION ALL ".join(
        f"SELECT {side_col}idx, CAST({f} AS BIGINT) AS f, {r(f'x{f}', places)} AS v FROM {name}"
        for f in range(k))


def train_one_iteration_ctes(m: ModelConfig) -> tuple[list[str], str, str]:
    k = m.factors
    ctes = init_ctes(m) + [gram_cte("sq", "q0", k, True)]
    uc, p1 = half_step_ctes("pu", "user", "p0", "q0", "sq", m)
    ctes += uc + [gram_cte("sp", p1, k, False)]
    ic, q1 = half_step_ctes("qi", "item", "q0", p1, "sp", m)
    return ctes + ic, p1, q1


def score_ctes(p: str, q: str, k: int) -> list[str]:
    dotp = " + ".join(f"p.x{f} * q.x{f}" for f in range(k))
    return [
        f"sc AS MATERIALIZED (SELECT p.idx AS user_idx, q.idx AS item_idx, {dotp} AS s "
        f"FROM {p} p CROSS JOIN {q} q)",
        "cand AS (SELECT sc.* FROM sc LEFT JOIN train t ON t.user_idx = sc.user_idx "
        "AND t.item_idx = sc.item_idx WHERE t.user_idx IS NULL)",
    ]


def rank_ctes() -> list[str]:
    return [
        "tsc AS (SELECT t.user_idx, t.test_item_idx, s.s FROM test t JOIN sc s "
        "ON s.user_idx = t.user_idx AND s.item_idx = t.test_item_idx)",
        "rk AS (SELECT tsc.user_idx, tsc.test_item_idx, CAST(1 + count(c.item_idx) AS BIGINT) "
        "AS rank FROM tsc LEFT JOIN cand c ON c.user_idx = tsc.user_idx "
        "AND c.item_idx <> tsc.test_item_idx AND (c.s > tsc.s OR (c.s = tsc.s AND "
        "c.item_idx < tsc.test_item_idx)) GROUP BY tsc.user_idx, tsc.test_item_idx)",
    ]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
