"""The assembly from reads to contigs, step by step.

Every step is available on its own; a later step runs the earlier ones. Intermediate tables are
removed when the run ends, except those the returned DataFrame still reads.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import circuits as cg
from seqloom.operators import contigs as ct
from seqloom.operators import graph as g
from seqloom.operators import swipe as sw
from seqloom.operators import words as wd
from seqloom.operators.checks import graph_checks
from seqloom.operators.chains import retrace_chains
from seqloom.operators.correction import correct_reads
from seqloom.operators.forest import spanning_forest
from seqloom.operators.stretches import trace_stretches
from seqloom.storage import Scratch, dealt

# The word length the reference program uses (k-mers of 16 bases).
DEFAULT_LENGTH = 17


@dataclass
class Assembly:
    """Stages of one assembly, computed on first use and kept as written tables."""

    reads: DataFrame  # read_id, seq
    length: int = DEFAULT_LENGTH
    # Word length of the error correction; without it reads are taken as they are.
    ec_tuple_size: int | None = None
    max_ec_pos: int = 4
    scratch: Scratch = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.scratch is None:
            self.scratch = Scratch(self.reads.sparkSession, "assembly")

    @cached_property
    def corrected(self) -> DataFrame:
        if self.ec_tuple_size is None:
            return self.reads
        steps = Scratch(self.reads.sparkSession, "correction")
        done = correct_reads(self.reads, self.ec_tuple_size, max_positions=self.max_ec_pos, scratch=steps)
        done = self.scratch.write(done, keep=True)
        steps.drop_all(kept=True)
        return done

    @cached_property
    def counts(self) -> DataFrame:
        return wd.word_counts(self.corrected, self.length)

    @cached_property
    def graph(self) -> g.Graph:
        return g.build_graph(self.counts, self.length, self.scratch)

    @cached_property
    def links(self) -> DataFrame:
        return g.successor_links(self.graph)

    @cached_property
    def chains(self) -> DataFrame:
        """Components of the successor graph before the swipe."""
        steps = Scratch(self.reads.sparkSession, "chains")
        done = trace_stretches(g.successor_ranges(self.graph), self.length - 1, steps)
        steps.drop_all()
        return done

    @cached_property
    def touching(self) -> DataFrame:
        """(c1, c2, e1, e2) of all circuit edges, not numbered."""
        return cg.touching_pairs(self.graph, self.chains, self.scratch)

    @cached_property
    def circuit_edges(self) -> DataFrame:
        return self.scratch.write(cg.circuit_edges(self.touching), keep=True)

    @cached_property
    def forest_edges(self) -> DataFrame:
        """(c1, c2, e1, e2) of the circuit edges in the lightest spanning forest."""
        steps = Scratch(self.reads.sparkSession, "forest")
        picked = spanning_forest(cg.first_touch(self.touching), steps, "pick").select("pick.*")
        done = steps.write(picked, keep=True)
        steps.drop_all()
        return done

    @property
    def forest(self) -> DataFrame:
        """The forest as numbers of circuit edges."""
        places = ["c1", "c2", "e1", "e2"]
        return self.circuit_edges.join(dealt(self.forest_edges), places).select("ceid")

    @cached_property
    def changed(self) -> DataFrame:
        marks = sw.swipe_marks(self.forest_edges)
        return sw.changed_successors(g.paired_edges(self.graph), marks, self.scratch)

    @cached_property
    def merged_chains(self) -> DataFrame:
        """Components after the swipe."""
        steps = Scratch(self.reads.sparkSession, "merged")
        done = steps.write(retrace_chains(self.chains, self.changed, steps), keep=True)
        steps.drop_all()
        return done

    def edges(self) -> DataFrame:
        return g.edges(self.graph)

    def swiped_edges(self) -> DataFrame:
        return sw.apply_swipe(self.edges(), self.changed)

    def merged_links(self) -> DataFrame:
        return sw.relink(self.links, self.changed)

    def starts(self) -> DataFrame:
        return g.contig_starts(self.merged_links())

    def contigs(self) -> DataFrame:
        lmers = g.unroll(self.graph.arcs, g.edge_id().alias("eid"), "lmer")
        return ct.contig_parts(self.merged_chains, lmers, self.length)

    def cycle_contigs(self) -> DataFrame:
        """(contig, part, seq, bases) of the cycles, which have no start of their own."""
        lmers = g.unroll(self.graph.arcs, g.edge_id().alias("eid"), "lmer")
        steps = Scratch(self.reads.sparkSession, "cycles")
        done = self.scratch.write(ct.cycle_parts(self.merged_chains, lmers, steps), keep=True)
        steps.drop_all()
        return done

    def checks(self) -> DataFrame:
        """(check, value, bad, first): whether the tables of the graph agree with each other."""
        steps = Scratch(self.reads.sparkSession, "checks")
        done = graph_checks(self.graph.words, self.graph.vertices, g.edge_ranges(self.graph), steps)
        steps.drop_all()
        return done

    def contig_lengths(self) -> DataFrame:
        return ct.contig_lengths(self.merged_chains, self.length)

    def close(self) -> None:
        """Remove the stage tables; DataFrames made by this assembly cannot be read afterwards."""
        self.scratch.drop_all(kept=True)

    def summary(self) -> dict[str, float]:
        """Counts for the metrics registry."""
        return {
            "NM_LMER_LENGTH": self.length,
            "NM_READ_COUNT": self.reads.count(),
            "NM_LMER_COUNT": self.graph.words.count(),
            "NM_KMER_COUNT": self.graph.vertices.count(),
            "NM_DEBRUIJN_VTX": self.graph.vertices.count(),
            "NM_DEBRUIJN_EDG": self.graph.words.agg(F.sum("cnt")).first()[0] or 0,
            "NM_CIRCUIT_VTX": cg.circuit_vertices(self.chains).count(),
            "NM_CIRCUIT_EDG": self.touching.count(),
        }
