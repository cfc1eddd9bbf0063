"""Prime sizes, e.g. for a fixed number of buckets."""

from __future__ import annotations

_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)  # fixed values: enough for every number under 3.3e24


def is_prime(n: int) -> bool:
    """Deterministic strong-pseudoprime test."""
    if n < 2 or any(n % p == 0 for p in _BASES):
        return n in _BASES
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    odd = (n - 1) >> twos
    return all((x := pow(a, odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for a in _BASES)


def next_prime(n: int) -> int:
    """The lowest prime that is at least n."""
    n = max(n, 2)
    while not is_prime(n):
        n += 1
    return n
