"""Small helpers for the check SQL of the registered queries."""

from __future__ import annotations


def quote(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def case(expression: str, table: dict, otherwise: str) -> str:
    """A fixed table as a CASE expression; ``otherwise`` is SQL."""
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expression} {arms} ELSE {otherwise} END"


def rounded(expression: str, digits: int) -> str:
    """The exact binary value to ``digits`` decimals, ties to even."""
    return f"(CAST(printf('%.{digits}f', CAST({expression} AS DOUBLE)) AS DOUBLE) + 0)"
