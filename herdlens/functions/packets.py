"""Binary fields of the power meter, read with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTEWISE = "ISO-8859-1"  # one character per byte


def reversed_hex(data: Column) -> Column:
    """Hex text of the bytes in reverse order: little-endian words then read as ordinary hex numbers."""
    return F.hex(F.encode(F.reverse(F.decode(data, _BYTEWISE)), _BYTEWISE))


def word(backward: Column, words: int | Column, index: int | Column) -> Column:
    """Unsigned 32-bit word ``index`` (from 0) of ``words``, from ``reversed_hex``, as bigint."""
    start = (words - 1 - index) * 8 + 1
    digits = F.substr(backward, start if isinstance(start, Column) else F.lit(start), F.lit(8))
    return F.conv(digits, 16, 10).cast("bigint")


def text4(data: Column, index: int) -> Column:
    """Four-byte text field at word ``index``; NULL where the bytes are not UTF-8."""
    return F.try_validate_utf8(bytes4(data, index).cast("string"))


def bytes4(data: Column, index: int) -> Column:
    return F.substring(data, index * 4 + 1, 4)


def decrypt_blocks(packet: Column, key: Column) -> Column:
    """AES-ECB without padding. The built-in needs padded input, so an encrypted empty block is appended."""
    mode, padding = F.lit("ECB"), F.lit("PKCS")
    tail = F.aes_encrypt(F.lit(b""), key, mode, padding)
    return F.try_aes_decrypt(F.concat(packet, tail), key, mode, padding)
