"""Zip archives by splits against zipfile."""

import json
import random
import zipfile

import pytest

from seqloom.sources import readers, zips


def written(path, seed, n=40):
    r = random.Random(seed)
    with zipfile.ZipFile(path, "w") as z:
        for k in range(n):
            kind = r.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
            text = json.dumps({"k": k, "x": "".join(r.choice("abcé中") for _ in range(r.choice([0, 5, 3000])))}, ensure_ascii=False)
            if k % 7 == 3:
                text += "PK\x03\x04" * r.randint(1, 3) + "tail" * r.randint(0, 30)  # the mark inside a member
            z.writestr(zipfile.ZipInfo(f"dir/é{k}.json" if k % 2 else f"{k}.json"), text, kind)
        z.writestr("other.txt", "no")
        z.writestr("dir/sub/", "")
    with zipfile.ZipFile(path) as z:
        return {m: z.read(m).decode() for m in z.namelist() if m.endswith(".json")}


@pytest.mark.parametrize("size", [1 << 20, 30_000])
def test_members_equal_zipfile(spark, tmp_path, size):
    want = {f"z{k}.zip": written(tmp_path / f"z{k}.zip", k) for k in range(3)}
    with zipfile.ZipFile(tmp_path / "z9.zip", "w"):
        want["z9.zip"] = {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = readers.read_zipped(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {name: {} for name in want}
    for r in got:
        by[r.archive.rsplit("/", 1)[1]][r.member] = r.text
    assert by == want and len(got) == sum(map(len, want.values()))


def test_streamed_archives_and_long_sizes(spark, tmp_path):
    """Sizes after the data (written to a pipe), and sizes in the extra field."""

    class Pipe:
        def __init__(self, f):
            self.f = f

        def write(self, b):
            return self.f.write(b)

        def flush(self):
            self.f.flush()

    with open(tmp_path / "a.zip", "wb") as f, zipfile.ZipFile(Pipe(f), "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5):
            with z.open(f"{k}.json", "w", force_zip64=k % 2 == 0) as m:
                m.write(b"x" * k * 1000)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z, z.open("long.json", "w", force_zip64=True) as m:
        m.write(b"PK\x03\x04y")
    got = {r.member: r.text for r in readers.read_zipped(spark, str(tmp_path)).collect()}
    assert got == {"long.json": "PK\x03\x04y", **{f"{k}.json": "x" * k * 1000 for k in range(5)}}


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(200):
            z.writestr(f"{k}.json", json.dumps({"k": k, "x": str(k) * 20_000}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = readers.read_zipped(spark, str(tmp_path))
        rows = df.rdd.mapPartitions(lambda part: [[json.loads(r.text)["k"] for r in part]]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(k for part in rows for k in part) == list(range(200))
    assert sum(bool(part) for part in rows) > 5


def test_damage_is_found():
    with pytest.raises(ValueError, match="not whole"):
        list(zips.members(iter([zips.HEAD.pack(20, 0, 8, 0, 0, 1, 50, 60, 1, 0) + b"a" + b"\x4b\x4c"])))
