import random

import pytest

from quillsearch.sources.quoted import fields, inside_after, lines_of, read_quoted


def plainly_inside(line, inside):
    """Character by character."""
    opens, after = not inside, False  # at a field's start; behind a quote within quotes
    for c in line:
        if inside and after:
            if c == '"':
                after = False
            else:
                inside, after, opens = False, False, c == ","
        elif inside:
            after = c == '"'
        else:
            inside, opens = opens and c == '"', c == ","
    return inside and not after


def test_states_equal_those_of_single_characters():
    rng = random.Random(1)
    for _ in range(20000):
        line, state = "".join(rng.choice('",a') for _ in range(rng.randrange(9))), rng.random() < 0.5
        assert inside_after(line, state) == plainly_inside(line, state), (line, state)


def test_fields():
    assert fields('a,"b,""c""\n",,"",5" x,"y"z') == ["a", 'b,"c"\n', "", "", '5" x', "yz"]
    assert fields("") == [""] and fields('"') == ['"'] and fields("a,") == ["a", ""]


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


@pytest.mark.parametrize("size, end", [(61, "\n"), (200, "\r\n"), (1 << 20, "\n")])
def test_ranges_equal_the_plain_reader(spark, tmp_path, size, end):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice('ab,"\n é') for _ in range(rng.choice([0, 3, 9, 90])))
    folder = tmp_path / "files"
    folder.mkdir()
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), word(), word()] for i in range(120)] + [["7", "x\n" * 200, 'a ""\n"'], ["inch", "5\" card", ""]]
        want += rows
        text = end.join(["n," + quoted("long\nname") + ",c", *[",".join([r[0], quoted(r[1]) if r[0] != "inch" else r[1], quoted(r[2])]) for r in rows], "", "9"])
        want.append(["9", "", ""])
        (folder / name).write_bytes((text + end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        tasks = lines_of(spark, str(folder)).rdd.getNumPartitions()
        got = read_quoted(spark, str(folder))
        assert got.columns == ["n", "long\nname", "c"]
        got = sorted(list(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want)
    assert tasks > 20 or size > 1000
    plain = spark.read.csv(str(folder), header=True, multiLine=True, quote='"', escape='"').na.fill("")
    if end == "\n":
        assert got == sorted(list(r) for r in plain.collect())


def test_odd_files(spark, tmp_path):
    (tmp_path / "open.csv").write_bytes(b'a,b\n\n1,"never closed\n2,x\n')
    assert [tuple(r) for r in read_quoted(spark, str(tmp_path / "open.csv")).collect()] == [("1", '"never closed\n2')]
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n1,\xff,left out\n")
    assert [tuple(r) for r in read_quoted(spark, str(tmp_path / "bytes.csv")).collect()] == [("1", "\ufffd")]
    (tmp_path / "none.csv").write_bytes(b"a,b\n")
    assert read_quoted(spark, str(tmp_path / "none.csv")).collect() == []
