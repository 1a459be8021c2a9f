"""Byte-level caption expressions: parity, character pairs, 708 payloads, hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions import values as V
from cuelake.functions.text import let

PRINTABLE = r"[^\x{20}-\x{7F}]"


def odd_parity(code: Column) -> Column:
    """Seven-bit value with bit 7 set so that the count of ones is odd."""
    low = code.bitwiseAND(F.lit(0x7F))
    return F.when(F.bit_count(low) % 2 == 0, low + 128).otherwise(low).cast("int")


def parity_ok(byte: Column) -> Column:
    return F.bit_count(byte) % 2 == 1


def basic_text(text: Column) -> Column:
    """Characters outside 0x20-0x7F become ``?`` (code points, not UTF-16 halves)."""
    return F.regexp_replace(text, PRINTABLE, "?")


def codes(text: Column) -> Column:
    """ASCII codes of a ``basic_text``."""
    return F.transform(F.filter(F.split(basic_text(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def pair(first: int, second: int) -> Column:
    return F.struct(F.lit(first).cast("int").alias("b1"), F.lit(second).cast("int").alias("b2"))


def control(second: int) -> Column:
    return pair(V.CONTROL, second)


def text_pairs(text: Column) -> Column:
    """Two characters per pair, odd tail filled with the null byte."""
    def packed(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(b) - 1, F.lit(2)), lambda i: F.struct(
            F.get(b, i).alias("b1"), F.coalesce(F.get(b, i + 1), F.lit(V.NULL)).alias("b2")))

    none = F.array().cast("array<struct<b1:int,b2:int>>")
    return let(F.transform(codes(text), odd_parity), lambda b: F.when(F.size(b) > 0, packed(b)).otherwise(none))


def service_blocks(payload: Column, service: int = 1, width: int = 31) -> Column:
    """Split a payload into service blocks, each led by ``service << 5 + length``."""
    def blocks(p: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(p), F.lit(width)), lambda i: F.concat(
            F.array((F.lit(service * 32) + F.least(F.lit(width), F.size(p) - i + 1)).cast("int")),
            F.slice(p, i, F.lit(width)))))

    return let(payload, blocks)


def spaced_hex(bytes_: Column) -> Column:
    return F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(b), 2, "0")), " ")


def bytes_of_hex(text: Column) -> Column:
    """``'8F 98'`` -> array of ints."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""),
                       lambda t: F.conv(t, 16, 10).cast("int"))
