"""Registration of queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL twin if it has one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_choose(values: tuple[str, ...], index: str) -> str:
    return f"list_extract({sql_list(values)}, CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def sql_round(x: str, digits: int) -> str:
    """Exact half-even rounding of a double column, spelled out in SQL."""
    scale = float(10**digits)

    def d(v: float) -> str:
        return f"CAST({v!r} AS DOUBLE)"

    spread = f"(({x}) * {d(134217729.0)})"
    high = f"({spread} - ({spread} - ({x})))"
    low = f"(({x}) - {high})"
    below = f"floor(({x}) * {d(scale)})"
    past = f"(({high} * {d(2 * scale)} - (2 * {below} + 1)) + {low} * {d(2 * scale)})"
    up = f"CASE WHEN {past} > 0 OR ({past} = 0 AND {below} % 2 <> 0) THEN 1 ELSE 0 END"
    return f"(({below} + {up}) / {d(scale)})"


WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WHITESPACE}+|{WHITESPACE}+\z', '', 'g')"


def sql_sanitize(x: str) -> str:
    unmarked = rf"regexp_replace({sql_strip(x)}, '^\x{{feff}}+', '')"
    safe = rf"regexp_replace({unmarked}, '[^\p{{L}}\p{{N}}_.\-+]', '_', 'g')"
    return rf"regexp_replace({safe}, '^_+|_+\z', '', 'g')"


def sql_seed(text: str) -> str:
    return f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT) % 2147483647"
