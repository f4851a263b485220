"""Polynomial hashes of action sequences, from which the hash of any spliced sequence follows by arithmetic.

A sequence x0 x1 x2 ... has the value x0 + x1*B + x2*B^2 + ... modulo a prime, in four lanes of 31 bits. With the value of
what stands before a place, of what stands after it, and B to the power of the place, every edit at that place has its
value after a few multiplications, whatever the length of the sequence. Products stay below 2^62.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1220703125, 1597463007, 1812433253)
#: Sequences have fewer than 64^4 items: powers are looked up by digits of six bits.
DIGITS = 4

Lanes = list[Column]


def item(text: Column) -> Lanes:
    """Value of one item; null is an item like any other."""
    x, y = F.xxhash64(text, F.lit(11)), F.xxhash64(text, F.lit(23))
    parts = [part for value in (x, y) for part in (value.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(value, 33))]
    return [part % prime for part, prime in zip(parts, PRIMES, strict=True)]


def power(count: Column, inverse: bool = False) -> Lanes:
    """B (or its inverse) to the power of a column: one table look-up and one multiplication per digit."""
    out = []
    for base, prime in zip(BASES, PRIMES, strict=True):
        factor = pow(base, -1, prime) if inverse else base
        value = None
        for digit in range(DIGITS):
            table = ",".join(f"{pow(factor, n << 6 * digit, prime)}L" for n in range(64))
            found = F.get(F.expr(f"array({table})"), F.shiftright(count, 6 * digit).bitwiseAND(F.lit(63)))
            value = found if value is None else value * found % prime
        out.append(value)
    return out


def plus(a: Lanes, b: Lanes) -> Lanes:
    return [(x + y) % prime for x, y, prime in zip(a, b, PRIMES, strict=True)]


def minus(a: Lanes, b: Lanes) -> Lanes:
    return [(x + prime - y) % prime for x, y, prime in zip(a, b, PRIMES, strict=True)]


def times(a: Lanes, b: Lanes) -> Lanes:
    return [x * y % prime for x, y, prime in zip(a, b, PRIMES, strict=True)]


def shifted(a: Lanes) -> Lanes:
    """The value one place further on."""
    return [x * base % prime for x, base, prime in zip(a, BASES, PRIMES, strict=True)]


def sequence(items: Column) -> Column:
    """Array of the lanes of a whole (short) array, by Horner's rule from its end."""
    start = F.array(*[F.lit(0).cast("long")] * len(PRIMES))

    def step(held: Column, text: Column) -> Column:
        return F.array(*plus(item(text), shifted(lanes(held))))

    return F.aggregate(F.reverse(items), start, step)


def lanes(array: Column) -> Lanes:
    return [F.get(array, lane) for lane in range(len(PRIMES))]


def packed(value: Lanes, names: tuple[str, str] = ("hash_a", "hash_b")) -> list[Column]:
    """Two columns of 62 bits."""
    return [
        F.shiftleft(value[at], 31).bitwiseOR(value[at + 1]).alias(name) for at, name in zip((0, 2), names, strict=True)
    ]
