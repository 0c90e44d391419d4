"""Seeded SplitMix64 keys computed in generated JVM code.

Spark's ANSI mode raises on 64-bit overflow, so products modulo 2**64 are formed
from 22-bit limbs that cannot overflow a long.  Each step has its own name: the
optimizer keeps a projection apart when its column is read more than once, so
the expression stays linear in size.  The result passes through a one-element
``explode``, which stops later filters on the key from being rewritten through
all those projections (where every reference would be expanded again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The SplitMix64 increment and multipliers.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIER_A = 0xBF58476D1CE4E5B9
MULTIPLIER_B = 0x94D049BB133111EB
MASK64 = (1 << 64) - 1

LIMB = (1 << 22) - 1
LOW_WORD = (1 << 32) - 1
SIGN_BIT = -(1 << 63)


def splitmix64(value: int, seed: int) -> int:
    """Scalar key as an unsigned integer, for driver-side seed derivation."""
    z = (value + seed + GAMMA) & MASK64
    z = ((z ^ (z >> 30)) * MULTIPLIER_A) & MASK64
    z = ((z ^ (z >> 27)) * MULTIPLIER_B) & MASK64
    return z ^ (z >> 31)


def derive_seed(seed: int, purpose: int) -> int:
    """Independent seed per purpose.

    The key adds id and seed before mixing, so neighbouring seeds give shifted
    copies of one stream; hashing the purpose number removes that relation.
    """
    return splitmix64(purpose, seed)


def with_splitmix64(df: DataFrame, out: str, id_col: str, seed: int) -> DataFrame:
    """Add ``out``: the 64-bit key of a non-negative id, as a signed long.

    The steps are one select whose columns refer to earlier ones by alias; the
    analyzer stacks them into projections.
    """
    if not 0 <= seed <= MASK64:
        raise ValueError("seed must be an unsigned 64-bit value")
    start = (seed + GAMMA) & MASK64
    row = f"CAST(`{id_col}` AS BIGINT)"
    steps = [
        f"IF({row} < 0, CAST(raise_error('{id_col} must be non-negative') AS BIGINT), {row}) AS _id",
        f"(_id & {LOW_WORD}L) + {start & LOW_WORD}L AS _lo",
        f"shiftrightunsigned(_id, 32) + {start >> 32}L + shiftrightunsigned(_lo, 32) AS _hi",
        f"shiftleft(_hi, 32) | (_lo & {LOW_WORD}L) AS _z0",
        "_z0 ^ shiftrightunsigned(_z0, 30) AS _y0",
        *_multiply("_y0", MULTIPLIER_A, "_a", "_z1"),
        "_z1 ^ shiftrightunsigned(_z1, 27) AS _y1",
        *_multiply("_y1", MULTIPLIER_B, "_b", "_z2"),
    ]
    key = F.expr("explode(array(_z2 ^ shiftrightunsigned(_z2, 31)))").alias(out)
    return df.selectExpr("*", *steps).select(*df.columns, key)


def _multiply(z: str, factor: int, name: str, out: str) -> list[str]:
    """Columns computing ``z * factor`` modulo 2**64 from 22-bit limbs."""
    b0, b1, b2 = factor & LIMB, (factor >> 22) & LIMB, factor >> 44
    a0, a1, a2, low, middle, high = (f"{name}_{part}" for part in ("0", "1", "2", "low", "mid", "high"))
    return [
        f"{z} & {LIMB}L AS {a0}",
        f"shiftrightunsigned({z}, 22) & {LIMB}L AS {a1}",
        f"shiftrightunsigned({z}, 44) AS {a2}",
        f"{a0} * {b0}L AS {low}",
        f"{a0} * {b1}L + {a1} * {b0}L + shiftrightunsigned({low}, 22) AS {middle}",
        f"{a0} * {b2}L + {a1} * {b1}L + {a2} * {b0}L + shiftrightunsigned({middle}, 22) AS {high}",
        f"({low} & {LIMB}L) | shiftleft({middle} & {LIMB}L, 22) | shiftleft({high}, 44) AS {out}",
    ]


def unsigned_mod(key: Column, modulus: Column | int) -> Column:
    """Remainder of a key read as an unsigned 64-bit integer."""
    n = F.lit(modulus) if isinstance(modulus, int) else modulus
    return (F.shiftrightunsigned(key, 1) % n * 2 + key.bitwiseAND(F.lit(1))) % n


def unsigned_order(key: Column) -> Column:
    """Signed long that sorts as the unsigned key does."""
    return key.bitwiseXOR(F.lit(SIGN_BIT))
