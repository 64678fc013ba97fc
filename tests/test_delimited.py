import csv
import io
import random

import pytest

from cleanloom.sources.delimited import lines_of, mangle, read_bytes, read_delimited
from cleanloom.sources.encodings import judged, of_first_line
from cleanloom.sources.records import after, fields_of


@pytest.fixture()
def small_blocks(spark):
    """Files are read in blocks of 64 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(frame):
    names = [c for c in frame.columns if c != "_rid"]
    return [tuple(r[c] for c in names) for r in frame.orderBy("_rid").collect()]


def expected(data, encoding="utf-8"):
    rows = [r for r in csv.reader(io.StringIO(data.decode(encoding), newline="")) if len(r) > 1 or r and r[0].strip(" \t")]
    width = len(rows[0])
    return [tuple(r + [""] * (width - len(r))) for r in rows[1:]]


def made(rng, n):
    """Records with quotes, line breaks and delimiters in fields, one of them over several blocks, and what they hold."""
    field = lambda: rng.choice(["", "plain", "a,b", "line\nbreak", 'say ""hi""', "\r\n", ",", "\n\n", '""', "x" * rng.randint(0, 90), "ü€", "\n" * rng.randint(0, 80)])
    lines = ["id,text,more"]
    for i in range(n):
        lines.append(f'{i},"{field()}",' + rng.choice(["z", '"q"', f'"{field()}"', '5" disk', ""]))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "  "]))
    return "\r\n".join(lines).encode() + rng.choice([b"", b"\n", b"\r\n"])


@pytest.mark.parametrize("seed", range(6))
def test_blocks_give_what_one_task_gives(spark, small_blocks, tmp_path, seed):
    data = made(random.Random(seed), 60)
    path = f"{tmp_path}/f.csv"
    with open(path, "wb") as f:
        f.write(data)
    frame = read_delimited(spark, path)
    assert lines_of(spark, path).blocks.count() >= 12
    assert rows_of(frame) == expected(data)


def test_a_folder_of_files(spark, small_blocks, tmp_path):
    (tmp_path / "d").mkdir()
    parts = [made(random.Random(k), 20) for k in (7, 8)]
    for k, data in enumerate(parts):
        (tmp_path / "d" / f"{k}.csv").write_bytes(data)
    assert rows_of(read_delimited(spark, f"{tmp_path}/d")) == expected(parts[0]) + expected(parts[1])


def test_state_of_lines():
    assert after('a,"b', False) == (True, 1) and after('c",d', True) == (False, 1) and after('x""y', True) == (True, 0)
    assert after('5" disk,7"', False) == (False, 1) and after('"a""b",""', False) == (False, 1) and after('""",', False) == (True, 0)
    assert fields_of('1,"a,b\nc",3') == 3 and fields_of("") == 1 and fields_of(",,") == 3


@pytest.mark.parametrize("row", ["1,2,3", "1,2,,x", "1,2,", '1,"2\n,",,', "1,2" + "," * 40])
def test_longer_records_raise_with_their_place(spark, tmp_path, row):
    path = f"{tmp_path}/f.csv"
    for before in ("", "3,4\n" * 30):
        with open(path, "w") as f:
            f.write(f"a,b\n{before}{row}\n5,6\n")
        with pytest.raises(Exception, match=f"A record of .*f.csv .number {1 + before.count('3')} of block 0. has .* fields, the header 2"):
            read_delimited(spark, path).collect()


def test_headers(spark, tmp_path):
    assert mangle(["a", "_more"]) == ["a", "_more"] and mangle(["b", "b", "b.1"]) == ["b", "b.2", "b.1"] and mangle(["A", "a", "", " "]) == ["A", "a.1", "Unnamed: 2", "Unnamed: 3"]
    assert mangle(["_rid", "x"]) == ["_rid.1", "x"] and mangle(["c0", "a`b", "a.b"]) == ["c0", "a`b", "a.b"]
    path = f"{tmp_path}/f.csv"
    for names in (["a", "_more"], ["b", "b", "b.1"], ["A", "a"], ["c1", "c0", "path"], ["_rid", "fields"], ["x" * 300_000, 'q""uote\nd'], ["é", "a.b"]):
        with open(path, "w") as f:
            f.write("\n\n" + ",".join(f'"{n}"' for n in names) + "\n" + ",".join(map(str, range(len(names)))) + "\n7\n")
        frame = read_delimited(spark, path)
        assert rows_of(frame) == [tuple(map(str, range(len(names)))), ("7", *[""] * (len(names) - 1))]
        assert len({c.lower() for c in frame.columns}) == len(names) + 1


def test_files_without_rows_or_header(spark, tmp_path):
    path = tmp_path / "f.csv"
    for text in ("", "\n", "  \n\r\n"):
        path.write_text(text)
        with pytest.raises(ValueError, match="no header"):
            read_delimited(spark, path)
    for text in ("a,b", "a,b\n", '﻿"a",b\r\n\r\n'):
        path.write_text(text, "utf-8")
        frame = read_delimited(spark, path)
        assert frame.columns[:2] == ["a", "b"] and frame.collect() == []
    path.write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(Exception, match="not closed"):
        read_delimited(spark, path).collect()


TEXT = "name,says\nZoë,“it’s” 5 €…\nÉlan,–naïve—\n"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "utf-16", "utf-16-le", "utf-16-be"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes(TEXT.encode(encoding))
    assert rows_of(read_delimited(spark, path)) == [("Zoë", "“it’s” 5 €…"), ("Élan", "–naïve—")]


def test_latin_1_and_given_encodings(spark, small_blocks, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("a,b\nZoë,Ñandú ÿ\n".encode("latin-1") * 9)
    assert rows_of(read_delimited(spark, path))[0] == ("Zoë", "Ñandú ÿ")
    path.write_bytes(b"a,b\n" + b"plain,x\n" * 40 + "é’,\x80".encode("cp1252", "ignore") + b"\n")
    assert rows_of(read_delimited(spark, path))[-1][0] == "é’"
    path.write_bytes(b"a\n\x85\x81\x8d\x8f\n")  # places that Windows-1252 leaves open
    assert lines_of(spark, str(path)).encoding == "ISO-8859-1"
    path.write_bytes("a\n€\n".encode("cp1252"))
    assert rows_of(read_delimited(spark, path, encoding="latin-1")) == [("\x80",)] and rows_of(read_delimited(spark, path, encoding="cp1252")) == [("€",)]
    with pytest.raises(ValueError, match="Unknown encoding"):
        read_delimited(spark, path, encoding="ebcdic")
    assert of_first_line(b"a\0b\0") == "UTF-16LE" and of_first_line(b"\0a\0b") == "UTF-16BE" and of_first_line(b"abc") is None
    assert judged(True, 0, 0, 0) == "UTF-8" and judged(False, 3, 2, 0) == "windows-1252" and judged(False, 0, 0, 0) == "ISO-8859-1"


def test_upload(spark, tmp_path):
    assert rows_of(read_bytes(spark, 'a,b\n1,"x\ny"\n'.encode(), f"file://{tmp_path}")) == [("1", "x\ny")]
