"""Plain Python models of the operators, as a second opinion."""

import math
import struct


def compare(op, a, b):
    if a is None or b is None:
        return False
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def exact(op, a, b):
    return {"add": a + b, "sub": a - b, "mul": a * b}[op]


def wrap(value, kind):
    return (value - kind.least) % (1 << kind.bits) + kind.least


def clamp(value, kind):
    return min(max(value, kind.least), kind.greatest)


def minimum(values, kind, largest=False):
    values = [v for v in values if v is not None]
    if not values:
        return kind.least if largest else kind.greatest
    if any(isinstance(v, float) and math.isnan(v) for v in values):
        return math.nan
    return max(values) if largest else min(values)


def mix(x):
    mask = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & mask
    return x ^ x >> 33


def key(value, kind):
    if kind.floating:
        value = 0.0 if value == 0 else value
        return int.from_bytes(struct.pack("<f" if kind.bits == 32 else "<d", value), "little")
    return value % (1 << kind.bits)


def hash64(bits, seed):
    return mix(bits ^ (seed + 0x9E3779B97F4A7C15) % (1 << 64))


def combine(a, b):
    return mix(a ^ (b + 0x9E3779B97F4A7C15 + (a << 6) + (a >> 2)) % (1 << 64))


def pack(values, width):
    bits = sum(v << i * width for i, v in enumerate(values))
    return bits.to_bytes(-(-len(values) * width // 8), "little")
