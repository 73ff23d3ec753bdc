"""DuckDB spellings of the text helpers, for the oracle SQL only."""

from __future__ import annotations

from tunedata.functions.text import WS_RUN


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RUN}|{WS_RUN}$', '', 'g')"


def missing(x: str) -> str:
    return f"({x} IS NULL OR {strip(f'CAST({x} AS VARCHAR)')} = '')"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS_RUN}'), lambda t: t <> '')"


def est(x: str) -> str:
    n = f"len({toks(x)})"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, CAST(floor({n} * 13 / 10) AS BIGINT)) END)"


def rnd(x: str, d: int) -> str:
    """Python's ``round(x, d)``; see ``functions.text.round_exact``."""
    s, v, split = f"CAST({10 ** d} AS DOUBLE)", f"CAST({x} AS DOUBLE)", "CAST(134217729 AS DOUBLE)"
    low, head = f"floor({v} * {s})", f"({v} * {split} - ({v} * {split} - {v}))"
    error = f"(({head} * {s} - {v} * {s}) + ({v} - {head}) * {s})"
    up = (f"CASE WHEN {v} * {s} - {low} > 0.5 THEN 1 WHEN {v} * {s} - {low} < 0.5 THEN 0 "
          f"WHEN {error} > 0 THEN 1 WHEN {error} < 0 THEN 0 ELSE abs({low} % 2) END")
    return f"(({low} + ({up})) / {s})"


def rouge_toks(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '),"
            f" lambda t: t <> '')")


def lcs(a: str, b: str) -> str:
    """LCS length of two token lists in DuckDB SQL: the same bit-parallel algorithm as the
    Spark UDF, over 32-bit words held in BIGINTs with an explicit carry between words.
    Since U = V & M is a submask of V, V - U is V xor U (no borrow)."""
    m = f"len({a})"
    words = f"CAST(ceil({m} / 32.0) AS BIGINT)"
    full = (f"(CASE WHEN {m} - 32 * lk >= 32 THEN 4294967295 "
            f"ELSE (CAST(1 AS BIGINT) << greatest({m} - 32 * lk, 0)) - 1 END)")
    v0 = f"list_transform(range({words}), lambda lk: {full})"
    mask = (f"coalesce(list_sum(list_transform(range(32 * lk, least(32 * lk + 32, {m})), "
            f"lambda li: CASE WHEN {a}[li + 1] = ly THEN CAST(1 AS BIGINT) << (li - 32 * lk) "
            f"ELSE CAST(0 AS BIGINT) END)), 0)")
    u = f"(lv[lk + 1] & {mask})"
    s = f"(lv[lk + 1] + {u} + lacc.c)"
    step = (f"list_reduce(range({words}), lambda lacc, lk: {{'c': {s} >> 32, "
            f"'o': list_append(lacc.o, (({s} & 4294967295) | xor(lv[lk + 1], {u})) & {full})}}, "
            f"{{'c': CAST(0 AS BIGINT), 'o': CAST([] AS BIGINT[])}}).o")
    final = f"list_reduce({b}, lambda lv, ly: {step}, {v0})"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE "
            f"{m} - CAST(list_sum(list_transform({final}, lambda lw: bit_count(lw))) AS BIGINT) END)")
