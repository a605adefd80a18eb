"""FIT files are written and read by batches."""

import struct

import pyarrow as pa
import pytest

from stridelake.sources import fit

SET = pa.struct([("set_order", pa.int32()), ("exercise_category", pa.int32()), ("set_type", pa.int32()), ("repetitions", pa.int32()), ("weight_kg", pa.float64())])


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    return crc


def test_checksums_of_a_batch_at_once():
    """as bit by bit, for files of any lengths."""
    files = [bytes((i * k + 7) % 256 for i in range(n)) for k, n in enumerate([0, 1, 5, 300, 5, 4096, 4097, 9000])]
    assert fit.crc16s(files) == [fit.crc16(f) for f in files] == [slow_crc(f) for f in files]
    assert fit.crc16s([]) == []


def test_files_of_a_batch():
    """whole batches of arrays, sliced ones and empty lists among them; values that do not fit are an error."""
    one = {"set_order": 1, "exercise_category": 7, "set_type": 0, "repetitions": None, "weight_kg": 2.53125}
    sets = pa.array([[one], [], [one, one | {"weight_kg": None, "repetitions": 9, "set_type": 1}], [one | {"weight_kg": float("nan")}]], pa.list_(SET))
    made = fit.encode_sets.func(sets).to_pylist()
    assert [len(fit.parse(f)) for f in made] == [1, 0, 2, 1]
    assert fit.encode_sets.func(sets.slice(2)).to_pylist() == made[2:]
    assert fit.parse(made[2])[1] == {"duration": 30_000, "repetitions": 9, "weight": None, "set_type": 0, "category": 7, "time": None}
    assert fit.parse(made[0])[0]["weight"] == 40 and fit.parse(made[3])[0]["weight"] is None
    assert all(struct.unpack("<H", f[-2:])[0] == slow_crc(f[:-2]) and struct.unpack("<H", f[12:14])[0] == slow_crc(f[:12]) for f in made)
    assert fit.parse(made[2][:-6]) == fit.parse(made[2])[:1]
    with pytest.raises(ValueError):
        fit.encode_sets.func(pa.array([[one | {"weight_kg": 5000.0}]], pa.list_(SET)))
