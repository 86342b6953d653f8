import hashlib
import io
import random
import re

import pytest

from ledgerweave.plans import file_queries
from ledgerweave.sources import files, stage, text_scan
from ledgerweave.sources.text_scan import owned, split_lines

ENDS = ["\n", "\r", "\r\n"]


class File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def encoded(text, codec):
    mark = {"utf-16-be": b"\xfe\xff", "utf-16-le": b"\xff\xfe", "utf-32-be": b"\x00\x00\xfe\xff", "utf-32-le": b"\xff\xfe\x00\x00"}.get(codec, b"")
    return mark + text.encode(codec)


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "latin-1", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_lines_at_every_size_of_the_ranges(codec):
    rng = random.Random(codec)
    letters = ["a", "é", "bc"] + ([] if codec == "latin-1" else ["ਊ", "ഊ", "਍", "\U0001f600"])
    for _ in range(300):
        text = "".join(rng.choice(ENDS + letters) for _ in range(rng.randint(0, 30)))
        data, size, found = encoded(text, codec), rng.randint(1, 12), []
        for at in range(0, max(len(data), 1), size):
            part, told = owned(File(data), len(data), at, at + size, step=rng.choice([4, 8]))
            if told not in (None, "utf-8"):
                part = part.decode(told).encode()
            found += [x.decode("latin-1" if codec == "latin-1" else "utf-8") for x in split_lines(part).to_pylist()]
        lines = re.split("\r\n|\n|\r", text)
        assert found == (lines if lines[-1] else lines[:-1])


def test_files_of_all_charsets(spark, tmp_path):
    rng, texts = random.Random(5), {}
    for codec in ("utf-8", "utf-8-sig", "latin-1", "utf-16-le", "utf-32-be"):
        texts[codec] = "".join(f"{i};{'ç' * rng.randint(0, 9)}{rng.choice(ENDS)}" for i in range(400)) + "\n\nlast" + "x" * 3000
        (tmp_path / f"{codec}.csv").write_bytes(encoded(texts[codec], codec))
    (tmp_path / "empty.csv").write_bytes(b"")
    for size in (333, 1 << 20):
        rows = {}
        for r in files.lines(spark, str(tmp_path), size).collect():
            rows.setdefault(r.file_id.rpartition("/")[2].removesuffix(".csv"), []).append((r.row_no, r.line))
        assert {k: sorted(v) for k, v in rows.items()} == {k: [(i, x) for i, x in enumerate(re.split("\r\n|\n|\r", t)) if x] for k, t in texts.items()}
        told = {r.file_id.rpartition("/")[2].removesuffix(".csv"): r.charset for r in text_scan.charsets(spark, str(tmp_path), size).collect()}
        assert told == {"utf-8": "utf-8", "utf-8-sig": "utf-8", "latin-1": "iso-8859-1", "utf-16-le": "utf-16-le", "utf-32-be": "utf-32-be"}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("linha número 1\n" * 40_000, encoding="utf-16")
    ranges = text_scan.byte_ranges(spark, str(tmp_path), 1 << 16)
    assert ranges.count() == 19 and ranges.rdd.getNumPartitions() == 19
    lines = text_scan.numbered_lines(spark, str(tmp_path), 1 << 16)
    assert lines.agg({"row_no": "max"}).first()[0] == 39_999 and lines.select("line").distinct().count() == 1


def test_rejected_with_line_and_reason(spark, tmp_path):
    bad = "".join(f"1.{i};Conta {i};{'x' if i % 3 == 0 else i};\n" if i % 7 else f"1.{i};a;1;2;3\n" for i in range(1, 60))
    (tmp_path / "a.csv").write_text('título\n\nCódigo;Nome;Saldo;\n"1;x";"disse ""sim""";"1.234,50";\n' + bad + ";;9;\n2;;;\n", encoding="utf-8")
    table = files.lines(spark, str(tmp_path))
    rows, rejected = files.parsed(table, files.delimiter(table), files.header_rows(table, least=2))
    kept = {r.row_no: (r.codigo, r.descricao, r.saldo and float(r.saldo)) for r in rows.collect()}
    assert kept[3] == ("1;x", 'disse "sim"', 1234.5) and kept[4] == ("1.1", "Conta 1", 1.0) and kept[64] == ("2", "2", None) and 63 not in kept
    first = [(r.line, r.reason) for r in files.first_rejected(rejected).orderBy("nth").collect()]
    expected = [(4 + i, "too many fields: 5 for 4" if i % 7 == 0 else "unreadable amount: x") for i in range(1, 60) if i % 7 == 0 or i % 3 == 0]
    assert first == expected[:10] and rejected.count() == len(expected)


def test_clear_deletes_what_was_saved(spark):
    spark_dir = stage.shared_place(spark, "x")
    spark.range(3).write.parquet(spark_dir)
    stage.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(spark_dir)


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("linha\n" * 40_000, encoding="utf-8")
    ranges = text_scan.byte_ranges(spark, str(tmp_path), 1 << 9)
    assert ranges.count() == 469 and ranges.rdd.getNumPartitions() == 64
    lines = text_scan.numbered_lines(spark, str(tmp_path), 1 << 9)
    assert lines.agg({"row_no": "max"}).first()[0] == 39_999 and lines.select("row_no").distinct().count() == 40_000


def test_written_files_are_scanned_once(spark, tmp_path):
    spark.range(2000).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "id / 4d as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    # What is parsed reads lines that have been written; before, each of its results scanned the files anew, several times.
    rows, rejected = file_queries.parsed(spark, str(tmp_path))
    for df in (rows, rejected):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert rows.count() + rejected.count() == 2000


def test_digests_are_read_by_pieces(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * (9 << 20))
    listed = files.catalogue(spark, str(tmp_path))
    assert listed.first().sha256 == hashlib.sha256(b"x" * (9 << 20)).hexdigest()
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()  # a file over 2 GB is no value of a table
