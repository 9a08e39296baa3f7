"""Command line: assemble the reads of a FASTQ file into contigs.

    python -m seqloom.cli -i reads.fastq -o contigs -k 16 [-d dump_folder] [--dump-format dot]
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from seqloom.metrics import Metrics
from seqloom.plans.assembly import DEFAULT_LENGTH, Assembly
from seqloom.session import get_spark
from seqloom.sources import dumps
from seqloom.sources.fastq import reads_from_fastq

log = logging.getLogger("seqloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="FASTQ file or folder")
    p.add_argument("-o", "--output", required=True, help="folder for FASTA part files")
    p.add_argument("-k", type=int, default=DEFAULT_LENGTH - 1, help="k-mer length (vertices)")
    p.add_argument("-d", "--dump", help="folder for a dump of the graph")
    p.add_argument("--dump-format", choices=("long", "dot"), default="long")
    p.add_argument("--ec-tuple-size", type=int, help="word length of read correction; none without it")
    p.add_argument("--max-ec-pos", type=int, default=4, help="most bases repaired in a read")
    p.add_argument("--metrics", help="file for run statistics as XML items")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> Metrics:
    metrics = Metrics()
    begun = time.time()
    asm = Assembly(reads_from_fastq(spark, args.input), args.k + 1, args.ec_tuple_size, args.max_ec_pos)
    for key, step in (
        ("TM_DEBRUIJN_CONSTRUCTION", lambda: asm.graph.arcs),
        ("TM_COMPONENT", lambda: asm.chains),
        ("TM_EULER_TOUR_P2", lambda: asm.touching),
        ("TM_SPANNING_TREE", lambda: asm.forest_edges),
        ("TM_SWIPE_EXECUTION", lambda: asm.changed),
        ("TM_CONTIG_GENERATION", lambda: dumps.write_fasta(asm.contigs(), args.output)),
    ):
        started = time.time()
        step()
        metrics.set(key, time.time() - started)
        log.info("%s %.1f s", key, metrics.get(key))
    if args.dump:
        dumps.dump_graph(asm.graph, args.dump, args.dump_format)
    metrics.update(asm.summary())
    metrics.set("TM_TOTAL_TIME", time.time() - begun)
    if args.metrics:
        with open(args.metrics, "w") as out:
            out.write("\n".join(metrics.xml_all()) + "\n")
    return metrics


def main() -> None:
    logging.basicConfig(level=logging.INFO, format="<!-- %(message)s -->")
    spark = get_spark("seqloom")
    run(spark, parser().parse_args())
    spark.stop()


if __name__ == "__main__":
    main()
