"""SQL fragments for the check queries: tagged pairs, cells, divergences, ECDFs."""

from __future__ import annotations

LINEITEM = ("lineitem", "l_orderkey % 10 >= 7", ["l_returnflag", "l_linestatus"],
            ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
ORDERS = ("orders", "o_orderkey % 10 >= 7", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
PART = ("part", "p_partkey % 10 >= 7", ["p_brand", "p_type"], ["p_size", "p_retailprice"])
CUSTOMER = ("customer", "c_custkey % 10 >= 7", ["c_mktsegment"], ["c_nationkey", "c_acctbal"])


def tagged(source: str, flag: str, name: str = "t") -> str:
    return f"{name} AS (SELECT *, ({flag}) AS syn FROM {source})"


def cells(columns, source: str = "t", name: str = "cells") -> str:
    """("column", value, n_real, n_syn) per category."""
    parts = [
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value,
            COUNT(*) FILTER (WHERE NOT syn) AS n_real, COUNT(*) FILTER (WHERE syn) AS n_syn
            FROM {source} WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR)"""
        for c in columns
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    g = f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {bins}), {bins - 1})"
    step = f"(({hi} - {lo}) / {float(bins)})"
    return f"""CASE WHEN {hi} > {lo} THEN
        CASE WHEN {x} < {lo} + {g} * {step} THEN {g} - 1
             WHEN {x} >= {lo} + ({g} + 1) * {step} AND {g} < {bins - 1} THEN {g} + 1
             ELSE {g} END
        ELSE {bins - 1} END"""


def bin_cells(columns, bins: int, source: str = "t", name: str = "bincells") -> str:
    """The same per equal-width bin over the pooled range."""
    parts = [
        f"""SELECT '{c}' AS "column", CAST(b AS VARCHAR) AS value,
            COUNT(*) FILTER (WHERE NOT syn) AS n_real, COUNT(*) FILTER (WHERE syn) AS n_syn
            FROM (SELECT syn, {bin_sql('x', 'lo', 'hi', bins)} AS b FROM
                (SELECT syn, CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL) v,
                (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}) w) u
            GROUP BY b"""
        for c in columns
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def jsd_of(source: str, smoothing: str, k: int | None = None) -> str:
    """SELECT "column", jsd over a cell table."""
    s = "1.0 / (greatest(tr, ts) * 10)" if smoothing == "relative" else "1e-10"
    return f"""SELECT "column", greatest(sum(0.5 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 0.0) AS jsd
        FROM (SELECT "column", (n_real * 1.0 / tr + s) / (1 + k * s) AS p, (n_syn * 1.0 / ts + s) / (1 + k * s) AS q
              FROM (SELECT c.*, tr, ts, {k if k is not None else 'kk'} AS k, CAST({s} AS DOUBLE) AS s
                    FROM (SELECT "column", value, CAST(n_real AS DOUBLE) AS n_real, CAST(n_syn AS DOUBLE) AS n_syn FROM {source}) c
                    JOIN (SELECT "column", CAST(sum(n_real) AS DOUBLE) AS tr, CAST(sum(n_syn) AS DOUBLE) AS ts, count(*) AS kk
                          FROM {source} GROUP BY "column") z USING ("column")) a) b
        GROUP BY "column" """


def jsd_all(pair, bins: int = 20, smoothing: str = "relative", flag_source: str | None = None) -> str:
    """CTEs ending in jsd("column", jsd) for a pair."""
    source, flag, cats, nums = pair
    parts, ctes = [], [tagged(flag_source or source, flag)]
    if cats:
        ctes.append(cells(cats))
        parts.append(jsd_of("cells", smoothing))
    if nums:
        ctes.append(bin_cells(nums, bins))
        parts.append(jsd_of("bincells", smoothing, bins))
    ctes.append(f"jsd AS ({' UNION ALL '.join(parts)})")
    return ", ".join(ctes)


def ks_cte(columns, source: str = "t", name: str = "ks") -> str:
    """ks("column", d, n, m)."""
    parts = [
        f"""SELECT '{c}' AS "column", max(abs(cr / n - cs / m)) AS d, max(n) AS n, max(m) AS m FROM (
            SELECT sum(nr) OVER (ORDER BY x) AS cr, sum(ns) OVER (ORDER BY x) AS cs,
                   CAST(sum(nr) OVER () AS DOUBLE) AS n, CAST(sum(ns) OVER () AS DOUBLE) AS m
            FROM (SELECT CAST({c} AS DOUBLE) AS x, CAST(COUNT(*) FILTER (WHERE NOT syn) AS DOUBLE) AS nr,
                         CAST(COUNT(*) FILTER (WHERE syn) AS DOUBLE) AS ns
                  FROM {source} WHERE {c} IS NOT NULL GROUP BY x) f) g"""
        for c in columns
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


P_VALUE = """CASE WHEN sqrt(n * m / (n + m)) * d < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
    (SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * (n * m / (n + m)) * d * d))
     FROM range(1, 101) z(k)))) END"""


def ordinal(column: str, words) -> str:
    whens = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(words))
    return f"CASE {column} {whens} END"


def literal_rows(rows) -> str:
    """VALUES list from Python tuples."""
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
