"""Binary codecs that Spark has no expression for, as Arrow-batched functions, and those that it can express, in the JVM."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
FIELD = 2**255 - 19


def to_base58(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def from_base58(text: str) -> bytes | None:
    n = 0
    for c in text:
        d = ALPHABET.find(c)
        if d < 0:
            return None
        n = n * 58 + d
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def keccak256(data: bytes) -> bytes:
    """Keccak with the original padding (not SHA3): sponge of 1,600 bits, rate 1,088. Rotations and round constants by their rules."""
    mask = 2**64 - 1
    rot = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & mask if n % 64 else x
    constants, lfsr = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if lfsr & 1:
                c |= 1 << (2**j - 1)
            lfsr = lfsr << 1 ^ (0x171 if lfsr & 0x80 else 0)
            lfsr &= 0xFF
        constants.append(c)
    block = bytearray(data + b"\x01" + b"\0" * (-(len(data) + 1) % 136))
    block[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for at in range(0, len(block), 136):
        for i in range(17):
            lanes[i % 5][i // 5] ^= int.from_bytes(block[at + 8 * i : at + 8 * i + 8], "little")
        for c in constants:
            parity = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
            lanes = [[lanes[x][y] ^ parity[(x - 1) % 5] ^ rot(parity[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
            x, y, moved = 1, 0, lanes[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                lanes[x][y], moved = rot(moved, (t + 1) * (t + 2) // 2), lanes[x][y]
            lanes = [[lanes[x][y] ^ (~lanes[(x + 1) % 5][y] & lanes[(x + 2) % 5][y] & mask) for y in range(5)] for x in range(5)]
            lanes[0][0] ^= c
    return b"".join(lanes[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def on_curve(raw: bytes) -> bool:
    """Is this the y coordinate of a point of the twisted Edwards curve -x^2 + y^2 = 1 + d x^2 y^2?"""
    y = int.from_bytes(raw, "little") & (2**255 - 1)
    d = -121665 * pow(121666, -1, FIELD) % FIELD
    x2 = (y * y - 1) * pow(d * y * y + 1, -1, FIELD) % FIELD
    return x2 == 0 or pow(x2, (FIELD - 1) // 2, FIELD) == 1


def program_address(seeds: list[bytes], program: bytes) -> bytes:
    """The first address, bumps from 255 down, that is no point of the curve."""
    for bump in range(255, -1, -1):
        raw = hashlib.sha256(b"".join(seeds) + bytes([bump]) + program + b"ProgramDerivedAddress").digest()
        if not on_curve(raw):
            return raw
    raise ValueError("no address off the curve")


def _udf(f, kind):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


base58_encode = _udf(lambda v: to_base58(bytes(v)), T.StringType())
base58_decode = _udf(from_base58, T.BinaryType())
keccak = _udf(lambda v: keccak256(bytes(v)), T.BinaryType())


def little_endian(data: Column, at: int, size: int = 8) -> Column:
    """An unsigned little-endian integer of up to 8 bytes at a byte place of binary data, as decimal(20,0). Stays in the JVM."""
    out = F.lit(0).cast("decimal(20,0)")
    for i in reversed(range(size)):
        byte = F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("decimal(3,0)")
        out = (out * F.lit(256).cast("decimal(3,0)") + byte).cast("decimal(20,0)")
    return out


def curve_trade(data: Column) -> Column:
    """A bonding-curve trade event: 8 bytes of discriminator, mint (32), SOL and token amounts, buy flag, trader (32), time, virtual reserves."""
    return F.struct(
        base58_encode(F.substring(data, 9, 32)).alias("mint"),
        (little_endian(data, 40).cast("double") / 1e9).alias("sol"),
        (little_endian(data, 48).cast("double") / 1e6).alias("tokens"),
        (F.hex(F.substring(data, 57, 1)) == "01").alias("is_buy"),
        base58_encode(F.substring(data, 58, 32)).alias("maker"),
        little_endian(data, 89).cast("long").alias("sec"),
        (little_endian(data, 97).cast("double") / 1e9).alias("virtual_sol"),
        (little_endian(data, 105).cast("double") / 1e6).alias("virtual_tokens"),
    )


def event_discriminator(name: str) -> bytes:
    return hashlib.sha256(f"event:{name}".encode()).digest()[:8]
