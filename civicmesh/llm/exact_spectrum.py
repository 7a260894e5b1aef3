"""Exact characteristic polynomials of integer matrices, their real roots and eigenvectors.

All of it works on Python integers or on residues: a matrix of d x d entries, which does not grow with any table's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, gcd, isqrt

import numpy as np

#: Bits of the primes (products of two residues fit 64 bits) and spare bits of every high-precision step.
PRIME_BITS, GUARD = 31, 80
#: Bases that make the Miller-Rabin test exact below 2 ** 32.
WITNESSES = (2, 3, 5, 7)


def _is_prime(n: int) -> bool:
    if n < 2 or any(n % p == 0 for p in WITNESSES):
        return n in WITNESSES
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in WITNESSES:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """The largest primes of PRIME_BITS bits, as many as make a product over ``bound``."""
    out, product, candidate = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(candidate):
            out.append(candidate)
            product *= candidate
        candidate -= 2
    return out


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of a positive semidefinite matrix' polynomial is larger: elementary symmetric functions of roots
    with a given sum are largest if all roots are equal."""
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // max(d, 1))
    return max(comb(d, k) * mean**k for k in range(d + 1))


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, highest power first: reduction to Hessenberg form by row and column
    operations over the field, then the recurrence over its leading minors."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(d, d)
    for c in range(d - 2):
        below = np.flatnonzero(h[c + 1 :, c])
        if not len(below):
            continue
        pivot = c + 1 + int(below[0])
        if pivot != c + 1:
            h[[c + 1, pivot]] = h[[pivot, c + 1]]
            h[:, [c + 1, pivot]] = h[:, [pivot, c + 1]]
        by = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2 :] = (h[c + 2 :] - by[:, None] * h[c + 1] % p) % p
        for r in np.flatnonzero(by):  # the inverse operation on columns
            h[:, c + 1] = (h[:, c + 1] + by[r] * h[:, c + 2 + r] % p) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: minor of size k, lowest power first
    minors[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, dtype=np.int64)
        new[1:] = minors[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * minors[k - 1] % p) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            new = (new - int(h[i - 1, k - 1]) * product % p * minors[i - 1] % p) % p
        minors[k] = new
    return minors[d, ::-1].tolist()


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The integers nearest to zero with these residues (a list of coefficients for each prime)."""
    values, product = [0] * len(residues[0]), 1
    for row, p in zip(residues, primes, strict=True):
        inverse = pow(product % p, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, row, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def _value(poly: list[int], num: int, shift: int) -> int:
    """2 ** (shift * degree) times the polynomial's value at num / 2 ** shift."""
    out, scale = 0, 0
    for c in poly:
        out = out * num + (c << scale)
        scale += shift
    return out


def roots_above(poly: list[int], num: int, shift: int) -> int:
    """How many roots, with multiplicities, are over num / 2 ** shift. For polynomials with real roots only, the sign
    changes of the coefficients around a point (Descartes) are this number exactly."""
    d = len(poly) - 1
    c = [v << (shift * i) for i, v in enumerate(poly)]
    for i in range(d):  # Taylor shift by Horner's scheme
        for j in range(1, d + 1 - i):
            c[j] += c[j - 1] * num
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _primitive(p: list[int]) -> list[int]:
    g = gcd(*p) or 1
    return [v // g for v in p]


def _common(a: list[int], b: list[int]) -> list[int]:
    """The greatest common divisor of two polynomials, by pseudo-remainders without content."""
    a, b = _primitive(a), _primitive(b)
    while len(b) > 1 or b[0]:
        r = a
        while len(r) >= len(b) and any(r):
            lead = r[0]
            r = [v * b[0] for v in r]
            for i, v in enumerate(b):
                r[i] -= lead * v
            r = r[1:]
        while len(r) > 1 and not r[0]:
            r = r[1:]
        a, b = b, _primitive(r or [0])
    return a


def _divided(a: list[int], b: list[int]) -> list[int]:
    """a / b for a monic a with the factor b, which is made monic."""
    if b[0] < 0:
        b = [-v for v in b]
    b, a, out = [v // b[0] for v in b], list(a), []
    for i in range(len(a) - len(b) + 1):
        out.append(a[i])
        for j, v in enumerate(b):
            a[i + j] -= out[-1] * v
    return out


def _prime_to_derivative(p: list[int], modulus: int = (1 << 61) - 1) -> bool:
    """Whether p and p' have no common factor modulo a prime, which proves that a monic p has no repeated root."""
    d = len(p) - 1
    a, b = [v % modulus for v in p], [v * (d - i) % modulus for i, v in enumerate(p[:-1])]
    while any(b):
        while not b[0]:
            b = b[1:]
        inverse = pow(b[0], -1, modulus)
        b = [v * inverse % modulus for v in b]
        while len(a) >= len(b):
            lead = a[0]
            a = [(v - lead * b[i]) % modulus if i < len(b) else v for i, v in enumerate(a)][1:]
        a, b = b, a or [0]
    return len(a) == 1


def square_free(p: list[int]) -> list[int]:
    """The monic polynomial with each root of a monic p once."""
    if len(p) < 3 or _prime_to_derivative(p):
        return p
    d = len(p) - 1
    return _divided(p, _common(p, [v * (d - i) for i, v in enumerate(p[:-1])]))


Root = tuple[int, int, int, int]  # low, high (a root in (low, high]), shift (both over 2 ** shift), multiplicity


def isolated(poly: list[int], count: int) -> tuple[list[Root], list[int]]:
    """Intervals of the largest roots over zero, largest first, until ``count`` with multiplicities are there, and the
    polynomial without repeated roots and zeros.

    ``poly`` is monic with real roots, none negative. Intervals are halved while they hold two different roots."""
    p = list(poly)
    while len(p) > 1 and p[-1] == 0:
        p.pop()
    q = square_free(p)
    if len(q) < 2:
        return [], q
    top = 1 << max(1, (-q[1]).bit_length())
    out: list[Root] = []
    waiting = [(0, top, 0, len(q) - 1, 0)]
    got = 0
    while waiting and got < count:
        low, high, shift, n_low, n_high = waiting.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1:
            times = 1 if len(q) == len(p) else roots_above(p, low, shift) - roots_above(p, high, shift)
            out.append((low, high, shift, times))
            got += times
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        n = roots_above(q, middle, shift)
        waiting += [(low, middle, shift, n_low, n), (middle, high, shift, n, n_high)]
    return out, q


def refined(q: list[int], root: Root, bits: int) -> tuple[int, int]:
    """low and shift: the root is in (low, low + 1] / 2 ** shift, with that width at most 2 ** -bits of its size."""
    low, high, shift, _ = root
    if _value(q, high, shift) == 0:
        return (high << bits) - 1, shift + bits
    sign = _value(q, high, shift) > 0
    while high - low > 1 or high.bit_length() < bits:
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        v = _value(q, middle, shift)
        if v == 0:
            return (middle << bits) - 1, shift + bits
        low, high = (low, middle) if (v > 0) == sign else (middle, high)
    return low, shift


def separation(roots: list[Root], q: list[int], i: int) -> Fraction:
    """A lower bound of the distance from root i to every other root and to zero."""
    bits = 24
    while True:
        def bounds(j: int) -> tuple[Fraction, Fraction]:
            low, shift = refined(q, roots[j], bits)
            return Fraction(low, 1 << shift), Fraction(low + 1, 1 << shift)

        low, high = bounds(i)
        gaps = [low] + ([bounds(i - 1)[0] - high] if i else []) + ([low - bounds(i + 1)[1]] if i + 1 < len(roots) else [])
        # what comes below the last root of the list is below that root's first interval
        if i + 1 == len(roots):
            gaps.append(low - Fraction(roots[i][0], 1 << roots[i][2]))
        if min(gaps) > 2 * (high - low):
            return min(gaps)
        bits *= 2


def eigenvectors(matrix: list[list[int]], q: list[int], roots: list[Root], i: int) -> tuple[Fraction, list[list[float]]]:
    """Root i and as many orthonormal vectors as its multiplicity, to double precision.

    Inverse iteration on the null space: elimination with full pivots of matrix - root in integers of as many bits as
    the distance to the other roots asks for; of the last pivots, as many as the multiplicity, are set to one unit."""
    d, m = len(matrix), roots[i][3]
    trace = sum(matrix[k][k] for k in range(d))
    ratio = int(trace / separation(roots, q, i)) + 1
    bits = 2 * ratio.bit_length() + 64 + GUARD + d.bit_length() * 2
    low, shift = refined(q, roots[i], bits)
    root = Fraction(2 * low + 1, 1 << (shift + 1))
    unit = max(0, bits - trace.bit_length() + 64)
    scaled = (root.numerator << unit) // root.denominator
    a = np.array([[v << unit for v in row] for row in matrix], dtype=object).reshape(d, d)
    for k in range(d):
        a[k, k] -= scaled
    rows, columns = list(range(d)), list(range(d))
    for k in range(d - m):
        size = np.abs(a[k:, k:])
        at = int(np.argmax(size))
        r, c = k + at // (d - k), k + at % (d - k)
        a[[k, r]] = a[[r, k]]
        a[:, [k, c]] = a[:, [c, k]]
        rows[k], rows[r] = rows[r], rows[k]
        columns[k], columns[c] = columns[c], columns[k]
        by = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k + 1 :] -= (by[:, None] * a[k, k + 1 :][None, :]) >> bits
        a[k + 1 :, k] = by  # the multipliers stay below the diagonal
    a[d - m :, d - m :] = 0
    for k in range(d - m, d):
        a[k, k] = 1

    def solved(b: list[int]) -> list[int]:
        y = np.array([b[r] for r in rows], dtype=object)
        for k in range(d - m):
            y[k + 1 :] -= (a[k + 1 :, k] * y[k]) >> bits
        x = np.zeros(d, dtype=object)
        for k in range(d - 1, -1, -1):
            x[k] = ((int(y[k]) << bits) - int(sum(a[k, k + 1 :] * x[k + 1 :]))) // int(a[k, k])
        out = [0] * d
        for k, c in enumerate(columns):
            out[c] = int(x[k])
        return out

    def whole(v: list[int]) -> list[int]:
        """The vector with a length of 2 ** bits."""
        length = isqrt(sum(x * x for x in v)) or 1
        return [(x << bits) // length for x in v]

    vectors = [[(((k + 2) * (j + 3) * 7919 + 104729 * j) % 1009 - 504) << bits for k in range(d)] for j in range(m)]
    for _ in range(2):
        done: list[list[int]] = []
        for v in vectors:
            v = whole(solved(v))
            for _ in range(2):
                for u in done:
                    along = sum(x * y for x, y in zip(u, v, strict=True)) >> bits
                    v = [y - ((x * along) >> bits) for x, y in zip(u, v, strict=True)]
                v = whole(v)
            done.append(v)
        vectors = done
    return root, [[x / (1 << bits) for x in v] for v in vectors]


def components(matrix: list[list[int]], q: list[int], roots: list[Root], which: Iterator[int], most: int) -> Iterator[tuple[int, float, list[float]]]:
    """number (from 1), root and vector of the components that belong to the roots ``which``, up to number ``most``."""
    for i in which:
        before = sum(r[3] for r in roots[:i])
        if before < most:
            root, vectors = eigenvectors(matrix, q, roots, i)
            for j, v in enumerate(vectors[: most - before]):
                yield before + j + 1, root, v
