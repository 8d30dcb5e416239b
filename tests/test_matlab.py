"""Samples from MATLAB files that are made here by the public format: plain and compressed, of either byte order, full and sparse."""

import struct
import zlib

import numpy as np
import pytest

from rankweave.plans.pipeline import rank_features
from rankweave.sources import matlab
from rankweave.sources import samples as S

CODES = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}


def element(order, code, raw, small=True):
    if small and 0 < len(raw) <= 4:
        return struct.pack(order + "I", len(raw) << 16 | code) + raw.ljust(4, b"\0")
    return struct.pack(order + "II", code, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def variable(order, name, x, kind="f8", sparse=False, compressed=False, flags=0):
    def stored(values, k):
        return element(order, CODES[k], np.asarray(values).astype(order + k).tobytes())

    body = element(order, 6, struct.pack(order + "II", (5 if sparse else 6) | flags << 8, 0)) + stored(x.shape, "i4") + element(order, 1, name.encode())
    if sparse:
        col, row = np.nonzero(x.T)
        body += stored(row, "i4") + stored(np.searchsorted(col, np.arange(x.shape[1] + 1)), "i4") + stored(x[row, col], kind)
    else:
        body += stored(x.ravel("F"), kind)
    whole = struct.pack(order + "II", 14, len(body)) + body
    if compressed:
        packed = zlib.compress(whole)
        return struct.pack(order + "II", 15, len(packed)) + packed
    return whole


def file_of(path, order, *held):
    path.write_bytes(b"made in a test".ljust(124) + struct.pack(order + "HH", 0x0100, 0x4D49) + b"".join(held))
    return str(path)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("elements", [1, 37, matlab.ELEMENTS])
def test_full_and_sparse(spark, tmp_path, order, compressed, elements):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(23, 5)), np.where(rng.random((23, 3)) < 0.4, 1, -1)
    z = rng.integers(-3, 4, (23, 6)) * (rng.random((23, 6)) < 0.4)
    z[:, 4] = 0
    path = file_of(tmp_path / "a.mat", order, variable(order, "X_train", x, compressed=compressed), variable(order, "Y_train", y, "i1", compressed=compressed), variable(order, "Z", z, "i2", True, compressed))
    if elements == 1:
        x, y, z = x[:4], y[:4], z[:4]
        path = file_of(tmp_path / "b.mat", order, variable(order, "X_train", x, compressed=compressed), variable(order, "Y_train", y, "i1", compressed=compressed), variable(order, "Z", z, "i2", True, compressed))
    got = matlab.matlab_samples(spark, path, elements=elements).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(x)))
    assert np.array_equal([r["features"] for r in got], x) and np.array_equal([r["labels"] for r in got], y > 0)
    assert np.array_equal([r["values"] for r in matlab.matlab_rows(spark, path, "Z", elements).orderBy("id").collect()], z)


def test_single_number_and_empty(spark, tmp_path):
    path = file_of(tmp_path / "c.mat", "<", variable("<", "one", np.array([[7]]), "u1"), variable("<", "none", np.zeros((0, 3))))
    assert matlab.matlab_rows(spark, path, "one").collect()[0].asDict() == {"id": 0, "values": [7.0]}
    assert matlab.matlab_rows(spark, path, "none").count() == 0


def test_what_cannot_be_read_raises(spark, tmp_path):
    x = np.ones((4, 2))
    path = file_of(tmp_path / "d.mat", "<", variable("<", "X_train", x), variable("<", "Y_train", x[:3]), variable("<", "i", x, flags=8))
    with pytest.raises(ValueError, match="4 and 3 rows"):
        matlab.matlab_samples(spark, path)
    for name, said in (("absent", "no variable absent"), ("i", "not a real matrix")):
        with pytest.raises(Exception, match=said):
            matlab.matlab_rows(spark, path, name).count()
    (tmp_path / "e.mat").write_bytes(b"text")
    with pytest.raises(ValueError, match="not a MATLAB"):
        matlab.variables(str(tmp_path / "e.mat"))
    (tmp_path / "f.mat").write_bytes((tmp_path / "d.mat").read_bytes()[:300])
    with pytest.raises(Exception, match="ends within"):
        matlab.matlab_rows(spark, str(tmp_path / "f.mat"), "X_train").count()


def test_ranking_from_a_file_is_that_from_parquet(spark, tmp_path, data):
    rows = S.vectors(spark, data).orderBy("id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["labels"] for r in rows])
    path = file_of(tmp_path / "g.mat", "<", variable("<", "X_train", x, compressed=True), variable("<", "Y_train", 2 * y.astype(int) - 1, "i1", compressed=True))
    read = matlab.matlab_samples(spark, path, elements=3000)
    assert [tuple(r) for r in read.orderBy("id").select("features", "labels").collect()] == [(r["features"], r["labels"]) for r in rows]
    first, other = (rank_features(df, "simple")[0].orderBy("rank").collect() for df in (S.vectors(spark, data), read))
    assert [r["fid"] for r in first] == [r["fid"] for r in other]
