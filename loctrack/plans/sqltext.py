"""DuckDB SQL text for the oracle side: the same rules as the column functions,
written once more in plain SQL so the check is an independent derivation."""

from __future__ import annotations


def uuid_cut(h: str) -> str:
    return f"regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def is_valid_uuid(x: str) -> str:
    overflow = "(^|-)\\+?0*([1-9a-fA-F][0-9a-fA-F]{16,}|[89a-fA-F][0-9a-fA-F]{15})(-|$)"
    return (f"coalesce(regexp_full_match({x}, '\\+?[0-9A-Fa-f]+(-\\+?[0-9A-Fa-f]+){{4}}') "
            f"AND length({x}) <= 36 AND NOT regexp_matches({x}, '{overflow}'), false)")


def in_range(x: str, lo: float, hi: float) -> str:
    return f"coalesce(NOT isnan({x}) AND {x} >= {lo!r} AND {x} <= {hi!r}, false)"


def floor_div(a: str, b) -> str:
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def ceil_div(a: str, b) -> str:
    return f"(-{floor_div(f'-({a})', b)})"


def grid_floor(ts: str, origin: int, every: int) -> str:
    return f"({origin} + {floor_div(f'{ts} - {origin}', every)} * {every})"


def grid_ceil(ts: str, origin: int, every: int) -> str:
    return f"({origin} + {ceil_div(f'{ts} - {origin}', every)} * {every})"


def ms_of(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000)"


def ts_of(ms: str) -> str:
    return f"make_timestamp(({ms}) * 1000)"


def with_views(defs: dict[str, str], names: list[str], order: list[str]) -> str:
    """WITH clause holding the named stand-in views (in dependency order)."""
    picked = [n for n in order if n in names]
    return "WITH " + ",\n".join(f"{n} AS (\n{defs[n]}\n)" for n in picked) + "\n"
