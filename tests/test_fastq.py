import gzip
import random

import pytest

from lattica.sources import readers as R


def made(rng, n, end="\n"):
    rows = []
    for i in range(n):
        m = rng.choice([1, 2, 5, 30] if n > 5 else [1, 2])
        qual = rng.choice(["@", "+", "", "I"]) + "".join(rng.choice("@+I#!") for _ in range(m))
        rows.append((f"r{i}.{i % 2 + 1}", "".join(rng.choice("ACGTN") for _ in range(m)), qual[:m]))
    text = "".join(f"@{i}{' extra @ words' if n > 5 else ''}{end}{s}{end}+{rng.choice(['', i])}{end}{q}{end}" for i, s, q in rows)
    return rows, text


@pytest.mark.parametrize("split", [1, 200, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_ranges(spark, tmp_path, split, end):
    rng = random.Random(split)
    n = 2 if split == 1 else 30
    want = []
    for k in range(3 if split > 1 else 2):
        rows, text = made(rng, n, end)
        text = text[: -len(end)] if k == 1 else text + (end if k == 2 else "")
        (tmp_path / f"f{k}.fq").write_bytes(text.encode())
        want += rows
    (tmp_path / "_hidden").write_text("nothing")
    got = R.read_fastq(spark, str(tmp_path), split)
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["id", "seq", "qual"]
    assert R.read_fastq(spark, f"{tmp_path}/f*.fq", split).count() == len(want)


def test_compressed_and_empty_files(spark, tmp_path):
    rows, text = made(random.Random(0), 500)
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.fq").write_bytes(b"")
    assert sorted(map(tuple, R.read_fastq(spark, str(tmp_path), 100).collect())) == sorted(rows)
    (tmp_path / "c").mkdir()
    assert R.read_fastq(spark, f"{tmp_path}/c").count() == 0
    with pytest.raises(FileNotFoundError):
        R.read_fastq(spark, f"{tmp_path}/nowhere")


def test_there_is_no_shuffle(spark, tmp_path):
    (tmp_path / "a.fq").write_text(made(random.Random(1), 50)[1])
    df = R.read_fastq(spark, str(tmp_path), 200)
    assert "Exchange" not in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() > 5


def test_a_record_without_its_end_is_an_error(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="cut off"):
        R.read_fastq(spark, str(tmp_path)).collect()
