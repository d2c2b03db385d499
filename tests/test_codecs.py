"""Codecs and fixed points against known values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ammlytics.functions import codecs as K


def test_known_values(spark):
    assert K.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert K.keccak256(b"Transfer(address,address,uint256)").hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert K.to_base58(b"\0\0hello world") == "11StV1DL6CwTryKyV" and K.from_base58("11StV1DL6CwTryKyV") == b"\0\0hello world" and K.from_base58("0") is None
    x = spark.createDataFrame([(bytearray(b"\0abc"),), (None,)], "b binary").select(K.base58_decode(K.base58_encode("b")).alias("b")).collect()
    assert bytes(x[0].b) == b"\0abc" and x[1].b is None


def test_curve():
    base = (4 * pow(5, -1, K.FIELD) % K.FIELD).to_bytes(32, "little")
    assert K.on_curve(base)
    assert not K.on_curve(K.program_address([b"seed"], hashlib.sha256(b"p").digest()))


def test_curve_trade(spark):
    mint, maker = bytes(range(32)), bytes(range(32, 64))
    u = lambda v: v.to_bytes(8, "little")
    data = K.event_discriminator("TradeEvent") + mint + u(2 * 10**9) + u(3 * 10**6) + b"\1" + maker + u(1700000000) + u(30 * 10**9) + u(2**63)
    r = spark.createDataFrame([(bytearray(data),)], "d binary").select(K.curve_trade(F.col("d")).alias("t")).select("t.*").first()
    assert (r.mint, r.maker, r.sol, r.tokens, r.is_buy, r.sec, r.virtual_sol) == (K.to_base58(mint), K.to_base58(maker), 2.0, 3.0, True, 1700000000, 30.0)
    assert r.virtual_tokens == pytest.approx(2**63 / 1e6)
