import gzip
import zipfile

import pytest

from quillsearch.sources.catalogue import find_export, read_catalogue, read_query_log

TEXT = 'card_number,card_title,card_tags,other\n007,"a ""quoted"", title",x,1\n8,"two\nlines",,2\n'


def test_reads_plain_packed_and_zipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXT)
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(TEXT)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("__MACOSX/a.csv", "junk")
        z.writestr("deep/a.csv", TEXT)
    for name in ("a.csv", "a.csv.gz", "a.zip"):
        rows = sorted(tuple(r) for r in read_catalogue(spark, str(tmp_path / name)).select("card_number", "card_title", "card_tags", "other").collect())
        assert rows == [("007", 'a "quoted", title', "x", "1"), ("8", "two\nlines", "", "2")]


def test_refuses_what_it_cannot_read(spark, tmp_path):
    with pytest.raises(ValueError):
        read_catalogue(spark, "x.xlsx")
    with pytest.raises(FileNotFoundError):
        find_export(folder=str(tmp_path))
    (tmp_path / "b.csv").write_text("x")
    (tmp_path / ".hidden.csv").write_text("x")
    assert find_export(folder=str(tmp_path)).endswith("b.csv")
    for name in ("cards.csv.gz", "cards.csv", "card_database.zip"):  # the last is looked for first
        (tmp_path / name).write_text("x")
        assert find_export(folder=str(tmp_path)).endswith(name)


def test_query_log(spark, tmp_path):
    p = tmp_path / "log.tsv"
    p.write_text('query\ttimes\tresults\n# note\na "b\t3\t4\n\t2\t1\nbad\tx\t1\n')
    assert sorted(tuple(r) for r in read_query_log(spark, str(p), True).collect()) == [("", 2, 1), ('a "b', 3, 4)]
    assert read_query_log(spark, str(tmp_path / "none.tsv")).count() == 0
