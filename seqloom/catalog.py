"""Named queries over the given tables, one per operator, each on whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import encoding as enc
from seqloom.metrics import Metrics, xml_lines
from seqloom.operators import circuits as cg
from seqloom.operators import contigs as ct
from seqloom.operators import graph as g
from seqloom.operators import hashindex as hx
from seqloom.operators import matrix as mx
from seqloom.operators import primitives as pr
from seqloom.operators import words as wd
from seqloom.operators.correction import correct_reads
from seqloom.operators.components import connected_components, degree_two_components
from seqloom.operators.exact import reduce_product, scan_floats, scan_products
from seqloom.operators.scan import dense_index, following, row_numbers, scan, segmented_scan
from seqloom.operators.suffixes import suffix_array
from seqloom.plans.assembly import DEFAULT_LENGTH, Assembly
from seqloom.sources import dumps, fastq, fastq_source
from seqloom.storage import Scratch, materialize, spread
from seqloom.streaming.counts import start_word_counts, total_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHORT = 7  # word length with few distinct words, each very frequent
URL = 9
CHECK = 1_000_003  # modulus of order-free checksums over words


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("read_id"), F.col("text").alias("seq")
    )


def urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("read_id"), F.col("url").alias("seq"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("read_id"), F.col("text").alias("seq")
    )


def scratch(spark: SparkSession, name: str) -> Scratch:
    return Scratch(spark, name)


# ---- words -------------------------------------------------------------------------------------


def _per_read(spark: SparkSession, sf: str, strand: str) -> DataFrame:
    cut = wd.windows(documents(spark, sf), DEFAULT_LENGTH, strand)
    return cut.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("lmer") % CHECK).alias("checksum")
    )


@query
def lmer_forward(spark, sf):
    return _per_read(spark, sf, "forward")


@query
def lmer_revcomp(spark, sf):
    return _per_read(spark, sf, "revcomp")


@query
def lmer_count(spark, sf):
    return wd.word_counts(documents(spark, sf), SHORT)


@query
def lmer_spectrum(spark, sf):
    """How many 17-mers occur how often on both strands."""
    return (
        wd.word_counts(documents(spark, sf), DEFAULT_LENGTH)
        .groupBy("cnt")
        .agg(F.count(F.lit(1)).alias("lmers"), F.sum(F.col("lmer") % CHECK).alias("checksum"))
    )


@query
def kmer_distinct(spark, sf):
    return wd.sub_words(wd.word_counts(documents(spark, sf), SHORT), SHORT)


@query
def kmer_index(spark, sf):
    return dense_index(materialize(kmer_distinct(spark, sf), "kmers"), ["kmer"], out="vidx")


@query
def prefix_suffix(spark, sf):
    return wd.split_words(wd.word_counts(documents(spark, sf), SHORT), SHORT).drop("cnt")


@query
def base_decode(spark, sf):
    counts = wd.word_counts(documents(spark, sf), SHORT)
    return counts.select("lmer", enc.decode_word(F.col("lmer"), SHORT).alias("bases"))


@query
def base_composition(spark, sf):
    """Per read the number of bytes with each code on both strands."""
    rows = documents(spark, sf).select(
        "read_id",
        enc.forward_digits(F.col("seq")).alias("f"),
        enc.complement_digits(F.col("seq")).alias("r"),
    )
    number = lambda col, d: F.length(F.regexp_replace(col, f"[^{d}]", "")).cast("long")
    return rows.select(
        "read_id", *[number(c, d).alias(f"{c}{d}") for c in ("f", "r") for d in range(4)]
    )


@query
def neighbour_bitmap(spark, sf):
    return wd.neighbour_bitmap(wd.word_counts(documents(spark, sf), SHORT), SHORT)


@query
def fastq_roundtrip(spark, sf):
    """Documents written as FASTQ records and read back by line position."""
    rows = documents(spark, sf).select(
        "read_id", F.regexp_replace(F.coalesce("seq", F.lit("")), "[\\r\\n]", "N").alias("seq")
    )
    place = f"{scratch(spark, 'fastq').base}/reads"
    fastq.write_fastq(rows, place, "read_id", "seq")
    back = fastq.parse_fastq(spark, place)
    return back.select(
        F.expr("substring(name, 2)").cast("long").alias("read_id"),
        F.md5(F.encode("seq", "UTF-8")).alias("seq_md5"),
        F.length("quality").cast("long").alias("n"),
    )


@query
def fastq_reads(spark, sf):
    """Conversation turns as FASTQ; total over the sequence lines by their length."""
    rows = turns(spark, sf).select(
        "read_id", F.regexp_replace(F.coalesce("seq", F.lit("")), "[\\r\\n]", "N").alias("seq")
    )
    place = f"{scratch(spark, 'fastq').base}/turns"
    fastq.write_fastq(rows, place, "read_id", "seq")
    back = fastq.read_fastq(spark, place)
    return back.groupBy(F.length("seq").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("reads"))


def _fastq_turns(spark, sf) -> str:
    """Folder of the conversation turns as FASTQ, named by conversation and turn."""
    rows = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("name"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]", "N").alias("seq"),
    )
    place = f"{scratch(spark, 'fastq').base}/named"
    fastq.write_fastq(rows, place, "name", "seq")
    fastq_source.register(spark)
    return place


def _digests(back: DataFrame) -> DataFrame:
    return back.select(
        F.expr("substring(name, 2)").alias("name"),
        F.md5(F.encode("seq", "UTF-8")).alias("seq_md5"),
        F.length("quality").cast("long").alias("n"),
    )


@query
def fastq_source_scan(spark, sf):
    """Conversation turns through the FASTQ data source, in ranges of 100,000 bytes."""
    place = _fastq_turns(spark, sf)
    return _digests(spark.read.format("fastq").option("splitBytes", 100_000).load(place))


@query
def fastq_source_stream(spark, sf):
    """The same files as a stream, its rows stored by a query that ends when all files are read."""
    place = _fastq_turns(spark, sf)
    out = scratch(spark, "fastq-stream").base
    rows = spark.readStream.format("fastq").option("splitBytes", 100_000).load(place)
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/progress")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return _digests(spark.read.schema(rows.schema).parquet(f"{out}/rows"))


@query
def stream_word_counts(spark, sf):
    """Counts of a stream over the documents file, summed over its batches."""
    schema = table(spark, sf, "documents").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    reads = source.parquet(f"{sf}/documents.parquet*").select(
        F.col("doc_id").alias("read_id"), F.col("text").alias("seq")
    )
    place = scratch(spark, "stream").base
    start_word_counts(reads, SHORT, place).awaitTermination()
    return total_counts(spark, place)


# ---- graph -------------------------------------------------------------------------------------


@query
def vertex_base_counts(spark, sf):
    return g.vertex_base_counts(wd.word_counts(documents(spark, sf), SHORT), SHORT)


@query
def vertex_degrees(spark, sf):
    """Vertices with degrees and list offsets."""
    return g.euler_vertices(Assembly(documents(spark, sf), SHORT).graph)


@query
def vertex_class(spark, sf):
    return g.vertex_class(Assembly(documents(spark, sf), SHORT).graph.vertices)


@query
def edges(spark, sf):
    """All edges of the 7-mer graph of the documents, summed up per tail vertex."""
    return (
        g.edges(Assembly(documents(spark, sf), SHORT).graph)
        .groupBy("v1")
        .agg(
            F.count(F.lit(1)).alias("edges"),
            F.sum("eid").alias("sum_eid"),
            F.sum("v2").alias("sum_v2"),
            F.sum("s").alias("sum_s"),
            F.sum(F.col("s").isNull().cast("long")).alias("ends"),
            F.sum("copy").alias("sum_copy"),
        )
    )


@query
def leaving_list(spark, sf):
    return g.leaving_list(Assembly(urls(spark, sf), URL).graph)


@query
def entering_list(spark, sf):
    return g.entering_list(Assembly(urls(spark, sf), URL).graph)


@query
def successors(spark, sf):
    return Assembly(urls(spark, sf), URL).edges().select("eid", "lmer", "v1", "v2", "s")


@query
def predecessors(spark, sf):
    return Assembly(urls(spark, sf), URL).links.select(F.col("id").alias("eid"), F.col("prv").alias("p"))


@query
def successor_blocks(spark, sf):
    """Pairing over the 17-mer graph of the documents, summed up per block of edge ids."""
    return g.link_blocks(Assembly(documents(spark, sf)).graph, 4096)


@query
def contig_start(spark, sf):
    """Edges of the 17-mer graph of the documents that no edge points to."""
    return g.unpaired_starts(Assembly(documents(spark, sf)).graph)


@query
def components(spark, sf):
    return Assembly(urls(spark, sf), URL).chains.select(F.col("id").alias("eid"), "label")


@query
def component_sizes(spark, sf):
    """Successor components of the 17-mer graph of the conversation turns."""
    chains = Assembly(turns(spark, sf)).chains
    return chains.groupBy("circuit", "label").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("id").alias("sum_eid")
    )


@query
def circuit_vertices(spark, sf):
    return cg.circuit_vertices(Assembly(turns(spark, sf)).chains)


@query
def circuit_edges(spark, sf):
    return Assembly(urls(spark, sf), URL).circuit_edges


@query
def circuit_edge_counts(spark, sf):
    return cg.circuit_edge_counts(Assembly(turns(spark, sf)).touching)


@query
def spanning_forest(spark, sf):
    return Assembly(urls(spark, sf), URL).forest


@query
def swipe(spark, sf):
    return Assembly(urls(spark, sf), URL).swiped_edges().select("eid", "s")


@query
def merged_starts(spark, sf):
    return Assembly(urls(spark, sf), URL).starts()


@query
def contigs(spark, sf):
    return Assembly(urls(spark, sf), URL).contigs()


@query
def contig_lengths(spark, sf):
    return Assembly(urls(spark, sf), URL).contig_lengths()


@query
def cycle_contigs(spark, sf):
    """Circular contigs before the swipe, each from its least rotation; equal ones together."""
    asm = Assembly(urls(spark, sf), SHORT)
    lmers = g.unroll(asm.graph.arcs, g.edge_id().alias("eid"), "lmer")
    parts = ct.cycle_parts(asm.chains, lmers, scratch(spark, "cycles"))
    return parts.groupBy("part", "seq", "bases").agg(F.count(F.lit(1)).alias("contigs"))


@query
def graph_checks(spark, sf):
    """Counts, offsets and successors of the graph of all documents against each other."""
    return Assembly(documents(spark, sf), SHORT).checks()


def planted_reads(spark, sf):
    """Reads of 100 bases at every 12th base of sequences derived from the lines of the documents.

    A line gives the 64 bases of the hash of its document, number and text. Every seventh read that lies inside its sequence has a wrong
    base, every fourteenth two: (read_id, seq, truth).
    """
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("lines"))
    line = lambda x, i: F.sha2(F.concat_ws(":", F.col("doc_id"), i, x), 256)
    bases = F.translate(F.array_join(F.transform("lines", line), ""), "0123456789abcdef", "ACGT" * 4)
    docs = docs.select("doc_id", bases.alias("bases"), F.length(bases).cast("long").alias("n")).filter("n >= 100")
    cut = docs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 100) / 12))))
    cut = cut.withColumn("truth", F.substring("bases", (F.col("i") * 12 + 1).cast("int"), F.lit(100)))
    place = (F.pmod(F.col("i") * 13 + F.col("doc_id") * 7, F.lit(30)) + 21).cast("int")
    wrong = lambda seq, at: F.overlay(seq, F.translate(F.substring(seq, at, F.lit(1)), "ACGT", "CGTA"), at)
    once = wrong(F.col("truth"), place)
    seq = F.when(F.col("i") % 14 == 3, wrong(once, place + 31)).when(F.col("i") % 7 == 3, once)
    inside = (F.col("i") * 12 >= 100) & (F.col("i") * 12 + 200 <= F.col("n"))
    return cut.select(
        F.concat_ws(":", "doc_id", "i").alias("read_id"),
        F.coalesce(F.when(inside, seq), F.col("truth")).alias("seq"),
        "truth",
    )


@query
def corrected_reads(spark, sf):
    """Reads with planted errors after their correction; their SQL makes the reads without errors."""
    reads = materialize(planted_reads(spark, sf).select("read_id", "seq"), "planted")
    return correct_reads(reads, DEFAULT_LENGTH, scratch=scratch(spark, "correction"))


@query
def document_contigs(spark, sf):
    """The whole assembly of the documents with 17-mers."""
    return Assembly(documents(spark, sf)).contig_lengths()


@query
def graph_dot(spark, sf):
    rows = dumps.debruijn_dot(Assembly(urls(spark, sf), URL).graph)
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_long(spark, sf):
    return dumps.debruijn_long(Assembly(urls(spark, sf), URL).graph)


@query
def successor_dot(spark, sf):
    return dumps.successor_dot(Assembly(urls(spark, sf), URL).links)


@query
def circuit_dot(spark, sf):
    return dumps.circuit_dot(Assembly(urls(spark, sf), URL).circuit_edges)


@query
def assembly_metrics(spark, sf):
    found = Metrics()
    found.update(Assembly(urls(spark, sf), URL).summary())
    return xml_lines(found.to_df(spark))


@query
def part_supplier_components(spark, sf):
    """Parts and suppliers that line items connect; suppliers get negative ids."""
    pairs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("a"), (-F.col("l_suppkey") - 1).alias("b")
    )
    return connected_components(pairs, scratch(spark, "components"))


@query
def event_chain_components(spark, sf):
    """Chains of each user's events as a graph of degree two."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id")
    nxt = materialize(following(events, "event_id", ["ts", "event_id"], ["user_id"]), "lists")
    back = nxt.where("following is not null").select(
        F.col("following").alias("event_id"), F.col("event_id").alias("n2")
    )
    rows = nxt.join(back, "event_id", "left").select(
        F.col("event_id").alias("vid"), F.col("following").alias("n1"), "n2"
    )
    return degree_two_components(rows, scratch(spark, "components"))


# ---- scans -------------------------------------------------------------------------------------


def _events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        (F.col("event_type") == "signup").cast("int").alias("flag"),
        F.when(F.col("event_type") == "purchase", -1).otherwise(1).alias("sign"),
    )


ORDER = ["ts", "event_id"]


@query
def scan_exclusive(spark, sf):
    return scan(_events(spark, sf), "cents", ORDER).select("event_id", "scan")


@query
def scan_inclusive(spark, sf):
    return scan(_events(spark, sf), "cents", ORDER, inclusive=True).select("event_id", "scan")


@query
def scan_backward(spark, sf):
    return scan(_events(spark, sf), "cents", ORDER, backward=True).select("event_id", "scan")


@query
def scan_min(spark, sf):
    return scan(_events(spark, sf), "cents", ORDER, "min").select("event_id", "scan")


@query
def scan_max(spark, sf):
    rows = scan(_events(spark, sf), "cents", ORDER, "max", inclusive=True, backward=True)
    return rows.select("event_id", "scan")


@query
def scan_multiply(spark, sf):
    return scan(_events(spark, sf), "sign", ORDER, "multiply", inclusive=True).select("event_id", "scan")


@query
def scan_product(spark, sf):
    """Products of factors 2 to 5 per user, wrapped to 64 bits."""
    rows = _events(spark, sf).withColumn("factor", F.pmod("event_id", F.lit(4)) + 2)
    done = scan_products(rows, "factor", ORDER, inclusive=True, partition_by=["user_id"])
    return done.select("event_id", "user_id", "scan")


@query
def scan_float(spark, sf):
    """Running sum of the event values as floats, which does not depend on the buckets."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.col("value").cast("double").alias("value"))
    done = scan_floats(rows, "value", ORDER, inclusive=True)
    return done.select("event_id", F.round("scan", 4).alias("scan"))


@query
def reduce_wrapped(spark, sf):
    """Product of all order keys that are odd, modulo 2^64."""
    return reduce_product(table(spark, sf, "orders").filter("o_orderkey % 2 = 1"), "o_orderkey")


@query
def scan_multi(spark, sf):
    """One independent scan per user."""
    rows = scan(_events(spark, sf), "cents", ORDER, partition_by=["user_id"])
    return rows.select("event_id", "user_id", "scan")


@query
def scan_segmented(spark, sf):
    """Each signup starts a segment."""
    rows = segmented_scan(_events(spark, sf), "cents", "flag", ORDER, inclusive=True)
    return rows.select("event_id", "scan")


@query
def scan_segmented_max_backward(spark, sf):
    rows = segmented_scan(_events(spark, sf), "cents", "flag", ORDER, "max", backward=True)
    return rows.select("event_id", "scan")


@query
def scan_lineitem(spark, sf):
    """Exclusive sum of line counts over orders: where the lines of each order start."""
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return scan(materialize(sizes, "sizes"), "n", ["l_orderkey"])


# ---- primitives --------------------------------------------------------------------------------


@query
def compact(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("valid")
    )
    return pr.compact(rows, "valid", ["o_orderkey"]).select("o_orderkey", "idx")


@query
def compact_backward(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("valid")
    )
    return pr.compact(rows, "valid", ["o_orderkey"], backward=True).select("o_orderkey", "idx")


@query
def sort_radix(spark, sf):
    """Place of every order by price, then key."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return pr.sort_positions(rows, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")


@query
def sort_string(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return pr.sort_positions(rows, ["p_name", "p_partkey"]).select("p_partkey", "p_name", "idx")


@query
def sort_descending(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return pr.sort(rows, ["c_acctbal", "c_custkey"], descending=True)


@query
def reduce(spark, sf):
    rows = _events(spark, sf)
    signs = pr.reduce_column(rows, "sign").select(F.col("multiply").alias("multiply"))
    return pr.reduce_column(rows, "cents").drop("multiply").join(F.broadcast(signs))


@query
def random_words(spark, sf):
    return pr.random_words(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42)


@query
def list_rank(spark, sf):
    """Rank of each event in the list of its user's events."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id")
    lists = following(events, "event_id", ["ts", "event_id"], ["user_id"])
    return pr.list_rank(lists, "event_id", "following", scratch(spark, "rank"))


@query
def spmv(spark, sf):
    """Quantity matrix (orders by parts) times retail price, in whole cents."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("a")
    )
    part = table(spark, sf, "part").select(
        "p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("x")
    )
    return mx.spmv(lines, part, "l_orderkey", "l_partkey", "a", "p_partkey", "x")


@query
def tridiagonal(spark, sf):
    """Per customer the system 4x[i] - x[i-1] - x[i+1] = price over the customer's orders."""
    placed = row_numbers(
        table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_orderkey"], ["o_custkey"], out="i",
    )
    rows = placed.select(
        F.col("o_custkey").alias("system"),
        "i",
        F.lit(-1.0).alias("a"),
        F.lit(4.0).alias("b"),
        F.lit(-1.0).alias("c"),
        F.col("o_totalprice").alias("d"),
    )
    solved = mx.solve_tridiagonal(rows, scratch(spark, "tridiagonal"))
    return solved.select("system", "i", F.round("x", 3).alias("x"))


@query
def suffixes(spark, sf):
    return suffix_array(
        table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", scratch(spark, "suffix")
    )


# ---- hash index --------------------------------------------------------------------------------


def _order_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"))


@query
def hash_slots(spark, sf):
    return hx.slot_candidates(_order_keys(spark, sf), "o_orderkey", 4000000007)


@query
def hash_probe(spark, sf):
    """Every line item asks the index of finished orders; a miss gives 4294967295."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    asked = table(spark, sf, "lineitem").select("l_orderkey")
    met = hx.probe(
        asked, "l_orderkey", done.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")),
        hx.h.MISS,
    )
    return met.groupBy("l_orderkey", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def hash_multivalue_keys(spark, sf):
    return hx.multi_value_keys(table(spark, sf, "orders"), "o_custkey")


@query
def hash_multivalue(spark, sf):
    return hx.multi_value_values(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query
def hash_compacting(spark, sf):
    return hx.compacting_index(table(spark, sf, "lineitem"), "l_suppkey")
