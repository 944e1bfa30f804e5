"""A computed permutation of ``range(n)``: any place can be worked out alone, so a shuffle needs no sort.

Numbers are laid out on a grid of ``a`` by ``b`` cells, little more than ``n``. Each Feistel round adds a keyed hash of one
coordinate to the other, which can be undone; a number that leaves ``range(n)`` is permuted again until it is back in it.
All steps are sums, products and remainders below 2**63, so SQL engines compute the same.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

ROUNDS = 6
#: A prime below 2**31, so that products fit 64 bits. Fixed value.
PRIME = 2_147_483_647
SHIFT = 1 << 16


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """(factor, summand) of each round, below `PRIME`."""
    keys = []
    for r in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()
        keys.append((int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME))
    return keys


def _hash(x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    h = (x * key[0] + key[1]) % PRIME
    return h * h // SHIFT


def _once(x: np.ndarray, a: int, b: int, keys: list[tuple[int, int]]) -> np.ndarray:
    left, right = x // b, x % b
    for r, key in enumerate(keys):
        if r % 2 == 0:
            left = (left + _hash(right, key)) % a
        else:
            right = (right + _hash(left, key)) % b
    return left * b + right


def _back(x: np.ndarray, a: int, b: int, keys: list[tuple[int, int]]) -> np.ndarray:
    left, right = x // b, x % b
    for r, key in reversed(list(enumerate(keys))):
        if r % 2 == 0:
            left = (left - _hash(right, key)) % a
        else:
            right = (right - _hash(left, key)) % b
    return left * b + right


def _walk(step, x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    (a, b), keys = grid(n), round_keys(seed, epoch)
    if max(a, b) >= PRIME:
        raise ValueError(f"{n} is too large to permute")
    out = step(np.asarray(x, np.int64), a, b, keys)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = step(out[outside], a, b, keys)
    return out


def permuted(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Where each of ``x`` in ``range(n)`` goes."""
    return _walk(_once, x, n, seed, epoch)


def place_of(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """What goes to each of ``x``: the inverse of `permuted`."""
    return _walk(_back, x, n, seed, epoch)


def permuted_sql(n: str, epoch: str, rounds: str) -> str:
    """CTEs ``walk`` and ``permuted`` (epoch, place, block_id) over a table ``places`` (epoch, place).

    ``n`` is a query for the count; ``rounds`` names a table (epoch, r, f, s) of the rounds' keys.
    """
    fold = "list_reduce(list_prepend({'r': 0, 'f': 0::BIGINT, 's': 0::BIGINT, 'x': v // b, 'y': v % b}, keys), lambda z, k: {'r': k.r, 'f': k.f, 's': k.s, " \
        f"'x': CASE WHEN k.r % 2 = 0 THEN (z.x + power_of(z.y, k.f, k.s)) % a ELSE z.x END, 'y': CASE WHEN k.r % 2 = 1 THEN (z.y + power_of(z.x, k.f, k.s)) % b ELSE z.y END}})"  # fmt: skip
    hashed = lambda v: f"(((({v}) * k.f + k.s) % {PRIME}) * ((({v}) * k.f + k.s) % {PRIME}) // {SHIFT})"
    fold = fold.replace("power_of(z.y, k.f, k.s)", hashed("z.y")).replace("power_of(z.x, k.f, k.s)", hashed("z.x"))
    return f"""
grid AS (SELECT n, a, greatest(1, (n + a - 1) // a)::BIGINT AS b FROM (SELECT n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM ({n}))),
keys AS (SELECT epoch, list({{'r': r, 'f': f, 's': s, 'x': 0::BIGINT, 'y': 0::BIGINT}} ORDER BY r) AS keys FROM {rounds} GROUP BY epoch),
walk AS (
    SELECT epoch, place, place AS v, 0 AS i FROM places
    UNION ALL
    SELECT epoch, place, (z.x * b + z.y)::BIGINT, i + 1 FROM (SELECT epoch, place, i, a, b, {fold} AS z FROM walk JOIN keys USING (epoch), grid WHERE i = 0 OR v >= n)
),
permuted AS (SELECT epoch, place, v AS block_id FROM walk, grid WHERE i > 0 AND v < n)"""
