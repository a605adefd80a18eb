"""Strength sets in FIT files: a writer and a parser of their "set" messages, run over binary columns."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values of the format: message and field numbers, base types, invalid markers.
SET, ACTIVE = 225, 1
FIELDS = {3: ("repetitions", "H"), 4: ("weight", "H"), 5: ("set_type", "B"), 7: ("category", "H"), 0: ("duration", "I"), 254: ("time", "I")}
BASE = {"B": 2, "H": 0x84, "I": 0x86}
INVALID = {"B": 0xFF, "H": 0xFFFF, "I": 0xFFFFFFFF}
SCHEMA = "activity_id long, set_order int, exercise_category int, set_type int, repetitions int, weight_kg double, duration_secs double"


#: Longer files get their checksum byte by byte, so that no matrix of bytes grows with one file.
LONG = 4096


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0xA001, t >> 1).astype(np.uint16)
    return t


TABLE = _crc_table()


def crc16(data: bytes) -> int:
    crc, table = 0, TABLE.tolist()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc


def crc16s(files: list[bytes]) -> list[int]:
    """crc16 of each, short ones all at once, byte after byte."""
    out = [crc16(f) if len(f) > LONG else 0 for f in files]
    short = sorted((i for i, f in enumerate(files) if len(f) <= LONG), key=lambda i: len(files[i]))
    for lo in range(0, len(short), 1024):
        some = short[lo : lo + 1024]
        sizes = np.array([len(files[i]) for i in some])
        data = np.zeros((len(some), sizes[-1]), np.uint8)
        data[np.arange(sizes[-1]) < sizes[:, None]] = np.frombuffer(b"".join(files[i] for i in some), np.uint8)
        crc = np.zeros(len(some), np.uint16)
        for at in range(sizes[-1]):
            first = int(np.searchsorted(sizes, at, side="right"))  # those before it have ended
            crc[first:] = crc[first:] >> 8 ^ TABLE[(crc[first:] ^ data[first:, at]) & 0xFF]
        for i, c in zip(some, crc.tolist()):
            out[i] = c
    return out


ORDER = sorted(FIELDS)
#: A message of a set as it lies in the file: its header byte, and the fields in order.
MESSAGE = np.dtype([("header", "u1"), *((FIELDS[n][0], {"B": "u1", "H": "<u2", "I": "<u4"}[FIELDS[n][1]]) for n in ORDER)])
DEFINITION = bytes([0x40, 0, 0]) + struct.pack("<HB", SET, len(ORDER)) + b"".join(bytes([n, struct.calcsize(FIELDS[n][1]), BASE[FIELDS[n][1]]]) for n in ORDER)


def messages(columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Set messages from arrays of floats, where NaN stands for a value that is missing."""
    out = np.zeros(n, MESSAGE)
    for name, kind in FIELDS.values():
        v = columns.get(name, np.full(n, np.nan))
        v = np.where(np.isnan(v), INVALID[kind], v)
        if n and (v.min() < 0 or v.max() > INVALID[kind]):
            raise ValueError(f"{name} does not fit into its field")
        out[name] = v
    return out


def encode(bodies: list[bytes]) -> list[bytes]:
    """Files of the set messages that each body holds."""
    whole = [DEFINITION + b for b in bodies]
    heads = [struct.pack("<BBHI4s", 14, 0x20, 2100, len(b), b".FIT") for b in whole]
    files = [h + struct.pack("<H", c) + b for h, c, b in zip(heads, crc16s(heads), whole)]
    return [f + struct.pack("<H", c) for f, c in zip(files, crc16s(files))]


def parse(data: bytes) -> list[dict]:
    """Set messages in order; invalid markers are None. Other messages are skipped; files that break off give what is whole."""
    if len(data) < 12 or data[8:12] != b".FIT":
        return []
    at, end = data[0], min(data[0] + struct.unpack_from("<I", data, 4)[0], len(data))
    kinds: dict[int, tuple[int, struct.Struct, list[tuple[str, str]], int]] = {}
    out = []
    while at < end:
        h = data[at]
        at += 1
        local = h >> 5 & 3 if h & 0x80 else h & 15
        if not h & 0x80 and h & 0x40:
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack_from(order + "HB", data, at + 2)
            fields = [(data[at + 5 + 3 * i], data[at + 6 + 3 * i]) for i in range(n)]
            at += 5 + 3 * n
            extra = 0
            if h & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            # One format for the whole message: fields of no interest are padding.
            known = [(FIELDS[f], size) if number == SET and f in FIELDS and size >= struct.calcsize(FIELDS[f][1]) else (None, size) for f, size in fields]
            shape = struct.Struct(order + "".join(f"{size}x" if k is None else f"{k[1]}{size - struct.calcsize(k[1])}x" for k, size in known))
            kinds[local] = (number, shape, [k for k, _ in known if k is not None], extra)
            continue
        if local not in kinds:
            break
        number, shape, known, extra = kinds[local]
        if at + shape.size > end:
            break
        if number == SET:
            row = {}
            for (name, k), v in zip(known, shape.unpack_from(data, at)):
                row[name] = None if v == INVALID[k] or (v == 0xFFFE and name == "category") else v
            out.append(row)
        at += shape.size + extra
    return out


@F.arrow_udf(BinaryType())
def encode_sets(sets: pa.Array) -> pa.Array:
    """Arrays of sets to files; weights are in sixteenths of a kilogram, durations in milliseconds."""
    flat, ends = sets.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False))

    def values(name: str) -> np.ndarray:
        return pc.fill_null(pc.struct_field(flat, name).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)

    columns = {"repetitions": values("repetitions"), "weight": np.rint(values("weight_kg") * 16), "set_type": 1 - values("set_type"), "category": values("exercise_category"), "duration": np.full(len(flat), 30_000.0)}
    body, size = messages(columns, len(flat)).tobytes(), MESSAGE.itemsize
    return pa.array(encode([body[a * size : b * size] for a, b in zip([0, *ends.tolist()], ends.tolist())]), pa.binary())


def parse_files(files: DataFrame) -> DataFrame:
    """Sets of files (activity_id, content), one row each, numbered in order."""

    def run(batches):
        for batch in batches:
            activities, at, rows = [], [], []
            for activity, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parse(content)
                activities += [activity] * len(found)
                at += range(len(found))
                rows += found
            of = lambda name, kind: pa.array([r.get(name) for r in rows], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                pa.array(activities, pa.int64()), pa.array(at, pa.int32()), of("category", pa.int32()), pc.subtract(1, of("set_type", pa.int32())).cast(pa.int32()), of("repetitions", pa.int32()),
                pc.divide(of("weight", pa.float64()), 16.0), pc.divide(of("duration", pa.float64()), 1000.0),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("activity_id", "content").mapInArrow(run, SCHEMA)
