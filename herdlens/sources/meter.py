"""Power-meter packets and recordings, decoded from tables of binary values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.functions.packets import bytes4, decrypt_blocks, reversed_hex, text4, word
from herdlens.functions.values import scaled, signed

PACKET_BYTES = 192
_PACK_WORDS = 16

# Units of the raw counters.
VOLT_UNIT = 1e-4
CURRENT_UNIT = 1e-5
POWER_UNIT = 1e-4
RESISTANCE_UNIT = 1e-1
DATA_LINE_UNIT = 1e-2


def decode_packets(packets: DataFrame, key: Column, packet: str = "packet") -> DataFrame:
    """Adds the fifteen readings and ``valid``. ``key`` is the device's AES key, as a binary column.

    A packet of the wrong length does not decrypt. A corrupt one of the right length decrypts to noise,
    so ``valid`` asks for the three pack ids; readings of invalid packets are NULL.
    """
    whole = F.when(F.length(packet) == PACKET_BYTES, F.col(packet))
    # Exploding a one-element array binds the decrypted packet: a filter on ``valid`` would otherwise be
    # pushed below and decrypt again for each field it names.
    plain = packets.select("*", F.explode(F.array(decrypt_blocks(whole, key))).alias("__data"))
    plain = plain.withColumn("__hex", reversed_hex(F.col("__data")))

    def number(pack: int, index: int) -> Column:
        return word(F.col("__hex"), 3 * _PACK_WORDS, (pack - 1) * _PACK_WORDS + index)

    def text(pack: int, index: int) -> Column:
        return text4(F.col("__data"), (pack - 1) * _PACK_WORDS + index)

    def has_id(pack: int) -> Column:
        return bytes4(F.col("__data"), (pack - 1) * _PACK_WORDS) == F.lit(f"pac{pack}".encode())

    readings = {
        "Name": text(1, 1),
        "Version": text(1, 2),
        "SN": number(1, 3),
        "Runs": number(1, 11),
        "Volt": scaled(number(1, 12), VOLT_UNIT),
        "Current": scaled(number(1, 13), CURRENT_UNIT),
        "Power": scaled(number(1, 14), POWER_UNIT),
        "Resistance": scaled(number(2, 1), RESISTANCE_UNIT),
        "G0_mAh": number(2, 2),
        "G0_mWh": number(2, 3),
        "G1_mAh": number(2, 4),
        "G1_mWh": number(2, 5),
        "Temp": signed(number(2, 6), number(2, 7)),
        "D_plus": scaled(number(2, 8), DATA_LINE_UNIT),
        "D_minus": scaled(number(2, 9), DATA_LINE_UNIT),
    }
    checked = plain.withColumn("valid", F.coalesce(has_id(1) & has_id(2) & has_id(3), F.lit(False)))
    valid_only = {name: F.when(F.col("valid"), value) for name, value in readings.items()}
    return checked.withColumns(valid_only).drop("__data", "__hex")


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("valid").drop("valid")


def rejected(decoded: DataFrame, *columns: str) -> DataFrame:
    """The packets that did not pass, as they came (name the columns to keep)."""
    return decoded.where(~F.col("valid")).select(*columns)


#: Pairs of a recording that are cut out at once.
_PAIRS = 64


def decode_recordings(blobs: DataFrame, blob: str = "blob") -> DataFrame:
    """One row ``Rec, Volt, Current`` per 8-byte pair, numbered from 1; a partial pair at the end is ignored.

    A blob is first cut into short pieces and those into positions, so that a row carries few bytes and words are
    decoded by generated code, not inside an array function.
    """
    others = [c for c in blobs.columns if c != blob]
    pairs = F.floor(F.length(blob) / 8).cast("int")
    whole = blobs.select(*others, pairs.alias("__pairs"), F.col(blob).alias("__blob")).where(F.col("__pairs") > 0)
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("__pairs") - 1, F.lit(_PAIRS)),
        lambda i: F.struct(i.alias("first"), F.substr(F.col("__blob"), i * 8 + 1, F.lit(8 * _PAIRS)).alias("bytes")),
    )
    cut = whole.select(*others, "__pairs", F.explode(pieces).alias("__piece"))
    cut = cut.select(*others, F.least(F.lit(_PAIRS), F.col("__pairs") - F.col("__piece.first")).alias("__n"), "__piece")
    rows = cut.select(*others, "__piece", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__pair"))
    backward = reversed_hex(F.substr(F.col("__piece.bytes"), F.col("__pair") * 8 + 1, F.lit(8)))
    rows = rows.select(*others, (F.col("__piece.first") + F.col("__pair") + 1).alias("Rec"), backward.alias("__hex"))
    return rows.select(
        *others,
        "Rec",
        scaled(word(F.col("__hex"), 2, 0), VOLT_UNIT).alias("Volt"),
        scaled(word(F.col("__hex"), 2, 1), CURRENT_UNIT).alias("Current"),
    )
