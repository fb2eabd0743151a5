"""Eigenvalues and eigenvectors of a positive semidefinite integer matrix, exactly enough for any gap.

The characteristic polynomial is exact: modulo many 31-bit primes the matrix is brought to Hessenberg form, the
polynomial of that form is read off, and the residues are joined by Chinese remaindering (a bound on the
coefficients says how many primes are needed). All roots are real, so the sign changes of the
shifted coefficients count the roots above a point exactly; halving isolates them. A root is refined to ``BITS`` bits
below the trace, and its vector comes from inverse iteration in integers of that many bits.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np

BITS = 256                          # of a root, counted from the leading bit of the trace
SAME = 128                          # roots that agree in so many of them count as one multiple root


def primes() -> Iterator[int]:
    """31-bit primes, largest first."""
    for p in range((1 << 31) - 1, 1 << 30, -2):
        if _is_prime(p):
            yield p


def _is_prime(p: int) -> bool:
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):          # enough below 3,215,031,751
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        for _ in range(s - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_for(matrix: Sequence[Sequence[int]]) -> list[int]:
    """Primes whose product is over twice any coefficient: e_k <= C(d, k) (trace / d)^k for non-negative roots."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = 2 * max(comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1)) + 1
    out, product = [], 1
    for p in primes():
        out.append(p)
        product *= p
        if product > bound:
            return out
    raise ValueError("the entries are too large")


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, power, e = np.ones_like(a), a.copy(), p - 2
    while e.any():
        out = np.where(e & 1, out * power % p, out)
        power, e = power * power % p, e >> 1
    return out


def polynomials(matrix: Sequence[Sequence[int]], moduli: Sequence[int]) -> np.ndarray:
    """det(t - matrix) modulo each prime, one row a prime, coefficients from t^d down."""
    d, p = len(matrix), np.array(moduli, dtype=np.int64)
    h = np.array([[[x % q for x in row] for row in matrix] for q in moduli], dtype=np.int64)
    at, p2, p3 = np.arange(len(p)), p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        pivot = np.argmax(below, axis=1) + m
        h[at, pivot], h[:, m] = h[:, m].copy(), h[at, pivot].copy()
        h[at, :, pivot], h[:, :, m] = h[:, :, m].copy(), h[at, :, pivot].copy()
        u = h[:, m + 1:, m - 1] * _inverse(h[:, m, m - 1], p)[:, None] % p2
        h[:, m + 1:] = (h[:, m + 1:] - u[:, :, None] * h[:, m:m + 1] % p3) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1:] * u[:, None] % p3).sum(axis=2)) % p2
    poly = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)     # poly[m]: of the leading m x m block, from t^0 up
    poly[0, :, 0] = 1
    for m in range(1, d + 1):
        new = (p2 - h[:, m - 1, m - 1, None]) * poly[m - 1] % p2
        new[:, 1:] += poly[m - 1, :, :-1]
        chain = np.ones(len(p), dtype=np.int64)
        for i in range(m - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % p
            new += (p - chain * h[:, i - 1, m - 1] % p)[:, None] * poly[i - 1] % p2
        poly[m] = new % p2
    return poly[d, :, ::-1]


def remainder(residues: Sequence[Sequence[int]], moduli: Sequence[int]) -> list[int]:
    """The integers of least size with these residues (one row a prime)."""
    whole = 1
    for p in moduli:
        whole *= p
    parts = [(whole // p) * pow(whole // p, -1, p) for p in moduli]
    out = [sum(int(r[k]) * part for r, part in zip(residues, parts)) % whole for k in range(len(residues[0]))]
    return [c - whole if 2 * c > whole else c for c in out]


def roots_above(poly: Sequence[int], m: int, e: int) -> int:
    """Roots over m * 2^e, with multiplicity; exact as all roots are real."""
    a, c = (m << e, list(poly)) if e >= 0 else (m, [x << -e * k for k, x in enumerate(poly)])
    for end in range(len(c) - 1, 0, -1):
        for k in range(1, end + 1):
            c[k] += a * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def fraction_bits(trace: int) -> int:
    return max(0, BITS - trace.bit_length())


def isolate(poly: Sequence[int], trace: int, most: int) -> list[tuple[int, int, int]]:
    """(m, e, roots) of intervals (m 2^e, (m + 1) 2^e], largest first, until ``most`` positive roots are held. Each holds
    one root, or roots too near to tell apart."""
    top = trace.bit_length()
    least = max(-fraction_bits(trace), top - SAME)
    todo, out, found = [(0, top, roots_above(poly, 0, 0), 0)], [], 0
    while todo and found < most:
        m, e, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1 or e <= least:
            out.append((m, e, inside))
            found += inside
            continue
        middle = roots_above(poly, 2 * m + 1, e - 1)
        todo += [(2 * m, e - 1, above_low, middle), (2 * m + 1, e - 1, middle, above_high)]
    return out


def refine(poly: Sequence[int], m: int, e: int, inside: int, bits: int) -> int:
    """The root in (m 2^e, (m + 1) 2^e], in units of 2^-bits. The interval is cut into pieces, and the one in which
    the secant meets zero is tried first: a hit squares the number of pieces, a miss halves the interval."""
    c = [x << bits * k for k, x in enumerate(poly)]

    def at(y: int) -> int:
        v = 0
        for x in c:
            v = v * y + x
        return v
    low, high = m << (e + bits), (m + 1) << (e + bits)
    if inside > 1:
        return (low + high) // 2
    f_low, f_high, pieces = at(low), at(high), 4
    if f_high == 0:
        return high
    while high - low > 1:
        width = high - low
        step, half = max(1, width // pieces), low + width // 2
        guess = low + abs(f_low) * width // (abs(f_low) + abs(f_high)) // step * step
        for y in (guess, guess + step, half):
            if not low < y < high or y == half and high - low <= step:
                continue
            if (f := at(y)) == 0:
                return y
            if (f > 0) == (f_high > 0):
                high, f_high = y, f
            else:
                low, f_low = y, f
        pieces = min(pieces * pieces, 1 << 64) if high - low <= step else 4
    return low


def null_vectors(matrix: Sequence[Sequence[int]], root: int, bits: int, many: int) -> np.ndarray:
    """``many`` orthonormal vectors (rows) that matrix - root * 2^-bits sends (nearly) to zero, by inverse iteration."""
    d = len(matrix)
    a = np.array([[x << bits for x in row] for row in matrix], dtype=object).reshape(d, d)
    a[np.diag_indices(d)] -= root
    lift, order = BITS, np.arange(d)              # factors are kept in units of 2^-lift
    lower = np.zeros((d, d), dtype=object)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], lower[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], lower[[pivot, k]], order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1:, k] << lift) // a[k, k]
            lower[k + 1:, k] = factor
            a[k + 1:, k + 1:] -= (factor[:, None] * a[k, k + 1:]) >> lift

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order]
        for k in range(d - 1):
            y[k + 1:] -= (lower[k + 1:, k] * y[k]) >> lift
        for k in range(d - 1, -1, -1):
            y[k] = ((y[k] << lift) - int((a[k, k + 1:] * y[k + 1:]).sum() if k + 1 < d else 0)) // a[k, k]
        return y

    def shrunk(v: np.ndarray) -> np.ndarray:
        """Largest entry to about BITS bits."""
        size = max(int(abs(x)).bit_length() for x in v) - BITS
        return v >> size if size > 0 else v << -size

    out = []
    start = np.random.default_rng(1)
    for _ in range(many):
        v = np.array([int(x) for x in start.integers(1 << 40, 1 << 41, d)], dtype=object)
        for _ in range(3):
            for u in out:                         # off the vectors already found
                v = (v << BITS) - ((int((v * u).sum()) * u) // int((u * u).sum() >> BITS))
            v = shrunk(solve(shrunk(v)))
        out.append(v)
    vectors = np.array([[float(x / (1 << BITS)) for x in v] for v in out])
    unit, _ = np.linalg.qr((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T)
    unit = unit.T
    return unit * np.sign(unit[np.arange(many), np.abs(unit).argmax(axis=1)])[:, None]
