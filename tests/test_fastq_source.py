"""The FASTQ data source: any split, odd files, streams that start again."""

import random

import pytest

from seqloom.sources import fastq_source as fq


def hard_records(seed, n):
    """Records whose quality lines often begin with @ or +, and names that look like sequences."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 40, 300])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        quality = "".join(rng.choice("@+I#") for _ in range(size))
        made.append((f"@{rng.choice(['', 'ACGT', '@+'])}{i}", seq, rng.choice(["+", f"+{i}"]), quality))
    return made


def text_of(records, end="\n"):
    return "\n".join("\n".join(r) for r in records) + end


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**6])
def test_records_at_any_split(tmp_path, split):
    for seed in range(3):
        records = hard_records(seed, 60)
        path = tmp_path / f"a{seed}.fastq"
        path.write_text(text_of(records, "\n" if seed else ""))
        size = path.stat().st_size
        got = [lines for at in range(0, size, split) for _, lines in fq.records(str(path), at, min(at + split, size))]
        assert [tuple(x.decode() for x in lines) for lines in got] == records


def test_texts_that_no_pattern_tells_apart(tmp_path, monkeypatch):
    """Every line begins with @ or + and all are of one length: only the place in the file helps."""
    monkeypatch.setattr(fq, "LOOK_AHEAD", 8)
    records = [("@@+@", "+@@+", "+@@@", "@+@+"), ("@+++", "@@@@", "++++", "@@@+")] * 200
    path = tmp_path / "same.fastq"
    path.write_text(text_of(records))
    size = path.stat().st_size
    got = [tuple(x.decode() for x in lines) for at in range(0, size, 64) for _, lines in fq.records(str(path), at, at + 64)]
    assert got == records


def test_scan(spark, tmp_path):
    fq.register(spark)
    wanted = []
    for k in range(3):
        records = hard_records(10 + k, 50)
        (tmp_path / f"f{k}.fastq").write_text(text_of(records))
        wanted += [(f"f{k}.fastq", r[0], r[1], r[3]) for r in records]
    (tmp_path / "_hidden").write_text("@x\nA\n+\nI\n")
    (tmp_path / "broken.fastq").write_text("@é\nAéC\n+\nIII\n@cut\nAC")
    wanted += [("broken.fastq", "@é", "AéC", "III"), ("broken.fastq", "@cut", "AC", None)]
    (tmp_path / "empty.fastq").write_text("")
    for split in (50, 1000, 1 << 20):
        rows = spark.read.format("fastq").option("splitBytes", split).load(str(tmp_path)).collect()
        got = [(r.file.rsplit("/", 1)[1], r.name, r.seq, r.quality) for r in rows]
        assert sorted(got, key=str) == sorted(wanted, key=str)
        assert len({(r.file, r.offset) for r in rows}) == len(rows)
    nothing = tmp_path / "none"
    nothing.mkdir()
    assert spark.read.format("fastq").load(str(nothing)).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    fq.register(spark)
    files, out = tmp_path / "in", tmp_path / "out"
    files.mkdir()

    def run():
        rows = spark.readStream.format("fastq").option("splitBytes", 500).load(str(files))
        writer = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress"))
        writer.trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(str(out)).collect())

    wanted = []
    for k in range(3):
        records = [(f"@{k}-{i}", r[1], r[2], r[3]) for i, r in enumerate(hard_records(20 + k, 40))]
        (files / f"f{k}.fastq").write_text(text_of(records))
        wanted += [r[0] for r in records]
        assert run() == sorted(wanted)
    assert run() == sorted(wanted)
