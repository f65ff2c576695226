"""XXH64 and CRC-32 written out in DuckDB SQL, which has neither, so that queries that use them can be held against SQL."""

from __future__ import annotations

# The five primes and the rotations of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_MASK = "18446744073709551615::UHUGEINT"


def _int(x: int) -> str:
    return f"{x % (1 << 64)}::UHUGEINT"


def _cut(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _turned(x: str, by: int) -> str:
    """x rotated left; x has 64 bits."""
    return f"(((({x}) << {by}) & {_MASK}) | (({x}) >> {64 - by}))"


def _lane(at: str, size: int) -> str:
    """Little-endian number of `size` bytes from byte number `at` (from 0) of the hexadecimal text hx."""
    digits = " || ".join(f"hx[2 * ({at}) + {2 * k + 1}:2 * ({at}) + {2 * k + 2}]" for k in reversed(range(size)))
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def xxh64(table: str, text: str, seed: int = 42) -> str:
    """SQL of a query: the distinct texts of a table's column, as `s`, with their XXH64 as UBIGINT, as `h`."""
    p1, p2, p3, p4, p5 = map(_int, PRIMES)
    start = [_int(seed + PRIMES[0] + PRIMES[1]), _int(seed + PRIMES[1]), _int(seed), _int(seed - PRIMES[0])]

    def mixed(lane: str) -> str:
        turned = _turned(_cut(f"({lane}) * {p2}"), 31)
        return _cut(f"{turned} * {p1}")

    lanes = [f"list_reduce(list_transform(range(n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)}), lambda v, x: {_cut(_turned(_cut(f'v + x * {p2} & {_MASK}'), 31) + f' * {p1}')}, {start[k]})" for k in range(4)]
    steps = ["j AS g0"] + [f"{_cut(f'xor(g{k}, {mixed(f"v{k}")}) * {p1} & {_MASK}')} AS m{k}, {_cut(f'm{k} + {p4}')} AS g{k + 1}" for k in range(4)]
    return f"""
SELECT s, h::UBIGINT AS h FROM (
  SELECT s, {_cut(f"xor(e, e >> 33) * {p2}")} AS e1, {_cut(f"xor(e1, e1 >> 29) * {p3}")} AS e2, xor(e2, e2 >> 32) AS h FROM (
    SELECT s, CASE WHEN n % 8 >= 4 THEN {_cut(_turned(f"xor(d, {_cut(f'{_lane("n - n % 8", 4)} * {p1}')})", 23) + f" * {p2} & {_MASK}")} + {p3} ELSE d END & {_MASK} AS d4,
           list_reduce(list_transform(range(n - n % 4, n), lambda i: {_lane("i", 1)}), lambda a, x: {_cut(_turned(f"xor(a, {_cut(f'x * {p5}')})", 11) + f" * {p1}")}, d4) AS e FROM (
      SELECT s, n, hx, list_reduce(list_transform(range(n // 32 * 4, n // 8), lambda i: {mixed(_lane("8 * i", 8))}),
             lambda a, x: {_cut(f"({_cut(_turned('xor(a, x)', 27) + f' * {p1}')}) + {p4}")}, {_cut("b + n::UHUGEINT")}) AS d FROM (
        SELECT s, n, hx, CASE WHEN n >= 32 THEN g4 ELSE {_int(seed + PRIMES[4])} END AS b FROM (
          SELECT *, {_cut(" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))} AS j, {", ".join(steps)} FROM (
            SELECT *, {", ".join(f"{x} AS v{k}" for k, x in enumerate(lanes))} FROM (
              SELECT s, hex(encode(s)) AS hx, strlen(s) AS n FROM (SELECT DISTINCT {text} AS s FROM {table}) t0) t1) t2) t3) t4) t5) t6) t7"""


def crc32(table: str, text: str) -> str:
    """SQL of a query: the distinct texts of a table's column, as `s`, with their CRC-32 as BIGINT, as `crc`."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rounds = ", ".join(f"{step.format(f'c{k}')} AS c{k + 1}" for k in range(8))
    return f"""
SELECT s, xor(list_reduce(list_transform(range(strlen(s)), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT),
       lambda c, b: xor(c >> 8, turns[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
FROM (SELECT s, hex(encode(s)) AS hx FROM (SELECT DISTINCT {text} AS s FROM {table}) u),
     (SELECT list(c8 ORDER BY i) AS turns FROM (SELECT i, i::BIGINT AS c0, {rounds} FROM range(256) r(i)) t) v"""
