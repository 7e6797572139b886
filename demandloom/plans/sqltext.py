"""Fragments shared by the SQL texts."""


def r(expr: str, digits: int) -> str:
    """Half-to-even rounding of a double; + 0.0 clears a negative zero."""
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale} + CAST(0 AS DOUBLE))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str, digits: int = 4) -> str:
    return r(f"{div(a, b)} * 100", digits)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def week(d: str) -> str:
    return f"CAST(date_trunc('week', CAST({d} AS DATE) - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)"



def ci(cond: str) -> str:
    return f"CAST(COALESCE(count_if({cond}), 0) AS BIGINT)"
