import os

from pyspark.sql import functions as F

from seqloom import cli
from seqloom.metrics import Metrics, xml_lines
from seqloom.operators.words import word_counts
from seqloom.plans.assembly import Assembly
from seqloom.sources import arrays, dumps, fastq, images
from seqloom.streaming.counts import running_counts, start_word_counts, total_counts

A = ["ACGTC", "TACGT"]


def put_fastq(path, records):
    path.write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in records))


def text_of(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(os.path.join(folder, f)).read() for f in parts)


def test_fastq_over_many_splits(spark, tmp_path):
    """Tiny splits: line numbers must hold across them, also when qualities start with '@'."""
    records = [(f"r{i}", "ACGT"[: 1 + i % 4] * (1 + i % 5)) for i in range(200)]
    put_fastq(tmp_path / "a.fastq", records)
    put_fastq(tmp_path / "b.fastq", records[:7])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = fastq.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, want in (("a.fastq", records), ("b.fastq", records[:7])):
        got = {r.read_no: r.seq for r in rows if r.file.endswith(name)}
        assert got == {i: s for i, (_, s) in enumerate(want)}


def test_fastq_last_name_wins(spark, tmp_path):
    put_fastq(tmp_path / "a.fastq", [("x", "AC"), ("y", "G"), ("x", "TTT")])
    got = {r.name: (r.seq, r.quality) for r in fastq.parse_fastq(spark, str(tmp_path / "a.fastq")).collect()}
    assert got == {"@x": ("TTT", "@@@"), "@y": ("G", "@")}


def test_command_line(spark, tmp_path):
    put_fastq(tmp_path / "in.fastq", [(str(i), s) for i, s in enumerate(A)])
    args = cli.parser().parse_args(
        ["-i", str(tmp_path / "in.fastq"), "-o", str(tmp_path / "out"), "-k", "2", "-d", str(tmp_path / "dump"),
         "--dump-format", "dot", "--metrics", str(tmp_path / "m.xml")]
    )
    metrics = cli.run(spark, args)
    assert text_of(tmp_path / "out") == ">contig_2\nACGT\n>contig_3\nACGTC\n>contig_8\nGACGTACGT\n"
    dot = text_of(tmp_path / "dump").splitlines()
    assert dot[0] == "digraph G {" and dot[-1] == "}" and len(dot) == 14
    assert dot.count("\tAC -> CG [label=G]") == 4
    assert metrics.get("NM_DEBRUIJN_EDG") == 12 and metrics.get("NM_CIRCUIT_EDG") == 4
    assert "<item name='k-mer Count' value='6'/>" in (tmp_path / "m.xml").read_text()


def test_dumps(spark, tmp_path):
    reads = spark.createDataFrame(list(enumerate(A)), "read_id long, seq string")
    asm = Assembly(reads, 3)
    dumps.dump_graph(asm.graph, str(tmp_path / "long"), "long")
    lines = text_of(tmp_path / "long").splitlines()
    assert lines[0] == "[0]:vid[1], ep[0], eend[2], lp[0], lend[4]"
    assert [x for x in lines if x.startswith("e[")][:2] == ["e[0]: 8", "e[1]: 11"]
    assert "[2]: v1[0], v2[1], s[6]" in lines and "[10]: v1[3], v2[5], s[-]" in lines
    dumps.write_lines(dumps.circuit_dot(asm.circuit_edges), str(tmp_path / "circuit"))
    assert text_of(tmp_path / "circuit").splitlines() == [
        "graph G {", "\t0 -- 1 [label=e1:1-e2:2]", "\t0 -- 1 [label=e1:5-e2:6]",
        "\t1 -- 2 [label=e1:2-e2:3]", "\t1 -- 2 [label=e1:6-e2:7]", "}",
    ]
    dumps.write_lines(dumps.successor_dot(asm.links), str(tmp_path / "succ"))
    assert "\t2 -- 6" in text_of(tmp_path / "succ").splitlines()


def test_metrics(spark):
    m = Metrics()
    m.set("TM_TOTAL_TIME", 1.5)
    m.set("NM_LMER_COUNT", 12)
    m.set("NM_BLOCK_SIZE", 0)
    want = ["<item name='Total Time' value='1.500000'/>", "<item name='l-mer Count' value='12'/>"]
    assert m.xml_all() == want and m.get("TM_COMPONENT") == -1
    assert m.to_df(spark).count() == 31
    assert [r.line for r in xml_lines(m.to_df(spark)).orderBy("id").collect()] == want


def test_arrays(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1.5 2\n\n -3\t4e1\n")
    got = [r.x for r in arrays.read_array(spark, str(tmp_path / "x.txt"), "float").orderBy("i").collect()]
    assert got == [1.5, 2.0, -3.0, 40.0]
    df = spark.range(300).select("id", (F.lit(255) - F.col("id") % 200).alias("x"))
    arrays.write_array(df, str(tmp_path / "out"), "id", "x", "uchar")
    back = arrays.read_array(spark, str(tmp_path / "out"), "uchar").orderBy("i").collect()
    assert [r.x for r in back] == [255 - i % 200 for i in range(300)]


def test_images(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes([0, 10, 255, 7, 8, 9]))
    (tmp_path / "b.ppm").write_bytes(b"P6 1 2 255\n" + bytes(range(6)))
    read = images.read_images(spark, str(tmp_path))
    got = {
        (r.path[-5:], r.y, r.x, r.channel): r.value for r in images.samples(read).collect()
    }
    assert got["a.pgm", 0, 2, 0] == 255 and got["a.pgm", 1, 0, 0] == 7
    assert got["b.ppm", 1, 0, 2] == 5 and len(got) == 12
    (tmp_path / "out").mkdir()
    named = read.withColumn("name", F.element_at(F.split("path", "/"), -1))
    images.write_images(named, str(tmp_path / "out")).collect()
    again = images.samples(images.read_images(spark, str(tmp_path / "out"))).collect()
    assert {(r.path[-5:], r.y, r.x, r.channel): r.value for r in again} == got


def test_streaming_counts(spark, tmp_path):
    reads = [(i, s) for i, s in enumerate(["ACGTACGT", "TTGACA", "NNNNNN", "ACGTC"])]
    schema = "read_id long, seq string"
    for i, row in enumerate(reads):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    start_word_counts(source, 4, str(tmp_path / "state")).awaitTermination()
    want = sorted(map(tuple, word_counts(spark.createDataFrame(reads, schema), 4).collect()))
    assert sorted(map(tuple, total_counts(spark, str(tmp_path / "state")).collect())) == want
    query = (
        running_counts(source, 4).writeStream.outputMode("complete").format("memory").queryName("live")
        .option("checkpointLocation", str(tmp_path / "live")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == want


def test_fastq_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Splits planned differently between building the frame and running it lose no read."""
    place = tmp_path / "many.fastq"
    place.write_text("".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'I' * 4}\n" for i in range(4000)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        read = fastq.read_fastq(spark, str(place))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        got = {r.read_no: r.seq for r in read.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: "ACGT" * (i % 7 + 1) for i in range(4000)}


def test_image_headers_of_any_length_and_bad_files(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "a.pgm").write_bytes(b"P5\n#" + b"x" * 3000 + b"\n2 1\n255\n\x01\x02rest")
    (folder / "b.pgm").write_bytes(b"P5\n2 2\n255\n\x01")
    (folder / "c.pgm").write_bytes(b"no image")
    got = {r.path[-5:]: (r.reason, bytes(r.data) if r.data is not None else None) for r in images.read_images(spark, str(folder)).collect()}
    assert got == {"a.pgm": (None, b"\x01\x02"), "b.pgm": ("size", None), "c.pgm": ("header", None)}
