"""From files to products: settings, states and steps of one dataset."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE
from ..operators import rdf, stats, summary
from ..operators.bisimulation import Refinement, refinement, typed_start, universal_start
from ..operators.graphs import nodes
from ..operators.preprocess import encoded, entity_dictionary, predicate_dictionary, preprocessed
from ..sources.ntriples import read_nquads, read_ntriples
from ..sources.store import cut, read_table, write_lines, write_tables


@dataclass
class Settings:
    format: str = "nt"  # nt, nq or trig (one named graph)
    skip_literals: bool = False
    skip_rdf_lists: bool = False
    types_to_predicates: bool = False
    typed_start: bool = False
    min_support: int = 1
    max_k: int | None = None
    exact: bool = False
    names: str = "digest"
    namespace: str = rdf.NAMESPACE


@dataclass
class SummarySession:
    """Runs one dataset into ``folder``; each step needs the state that the one before leaves.

    States: ready_to_start, preprocessed, bisimulation_complete, multi_summary_complete,
    or multi_summary_incorrect when the count of blocks doesn't fit that of refines edges.
    """

    spark: SparkSession
    path: str
    folder: str
    settings: Settings = field(default_factory=Settings)
    state: str = "ready_to_start"
    plotted: bool = False
    serialized: bool = False
    refinement: Refinement | None = None

    def change_settings(self, **changes) -> None:
        if unknown := set(changes) - set(asdict(self.settings)):
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        for k, v in changes.items():
            setattr(self.settings, k, v)

    @property
    def experiment_state(self) -> dict:
        return {"summary_status": self.state, "plotted": self.plotted, "serialized": self.serialized}

    def _needs(self, *states: str) -> None:
        if self.state not in states:
            raise RuntimeError(f"this step needs the state {' or '.join(states)}, not {self.state}")

    def preprocess(self) -> None:
        self._needs("ready_to_start")
        s = self.settings
        rows = read_nquads(self.spark, self.path) if s.format == "nq" else read_ntriples(self.spark, self.path, wrapped=s.format == "trig")
        triples = cut(preprocessed(rows, s.skip_literals, s.skip_rdf_lists, s.types_to_predicates).distinct(), "triples")
        entities, predicates = entity_dictionary(triples), predicate_dictionary(triples)
        write_tables({"entities": entities, "predicates": predicates}, self.folder)
        write_tables({"edges": encoded(triples, self.table("entities"), self.table("predicates"))}, self.folder)
        self.state = "preprocessed"

    def bisimulate(self) -> None:
        self._needs("preprocessed")
        s, e = self.settings, self.table("edges")
        v = nodes(e)
        if s.typed_start:
            is_type = self.table("predicates").where(F.col("iri") == RDF_TYPE).select(F.col("id").alias("p"))
            start = typed_start(v, e.join(is_type, "p", "left_semi").select(F.col("s").alias("node"), F.col("o").alias("type")))
        else:
            start = universal_start(v)
        self.refinement = refinement(e, start, s.max_k, s.min_support, s.exact)
        write_tables({"final_partition": self.refinement.final, "born": self.refinement.born, "level_statistics": stats.level_statistics(self.refinement)}, self.folder, {"born": "start"})
        self.state = "bisimulation_complete"

    def summarise(self) -> None:
        self._needs("bisimulation_complete")
        r = self.refinement
        hist = cut(summary.history(r), "history")
        write_tables({"blocks": summary.blocks(r), "refines": summary.refines(r), "data_edges": summary.data_edges(r, hist), "history": hist}, self.folder)
        self.state = "multi_summary_complete" if stats.is_consistent(r).first()["consistent"] else "multi_summary_incorrect"

    def quotient(self, k: int = -1) -> DataFrame:
        """Edges of the quotient graph of level ``k``; -1: the last."""
        self._needs("multi_summary_complete")
        return summary.quotient(self.refinement, None if k < 0 else k, self.table("history"))

    def counts(self) -> DataFrame:
        self._needs("multi_summary_complete")
        return stats.full_counts(self.refinement, self.table("history"), e=self.table("data_edges"))

    def serialize(self, letters: str = "cdirs") -> str:
        self._needs("multi_summary_complete")
        r, ns, entities = self.refinement, self.settings.namespace, self.table("entities")
        own = summary.members(r, self.table("history"))
        names = cut(rdf.block_names(own, self.settings.names, entities), "names")
        b = self.table("blocks")
        parts = {
            "s": rdf.sizes_lines(b, names, ns), "c": rdf.contains_lines(own, names, entities, ns), "r": rdf.refines_lines(self.table("refines"), names, ns),
            "d": rdf.data_lines(self.table("data_edges"), names, self.table("predicates"), ns), "i": rdf.intervals_lines(b, names, ns),
        }
        write_lines(rdf.merged_lines(parts, letters) if len(letters) > 1 else parts[letters], f"{self.folder}/rdf")
        self.serialized = True
        return f"{self.folder}/rdf"

    def plot_data(self) -> dict[str, DataFrame]:
        """What the plots of a run show: sizes, edges, splits and densities by level."""
        self._needs("multi_summary_complete")
        r = self.refinement
        sizes = stats.block_size_histogram(r)
        self.plotted = True
        return {"block_sizes": sizes, "edges_per_level": stats.edges_per_level(self.table("data_edges")), "splits": stats.split_counts(r), "density": stats.kde_grid(sizes)}

    def run(self) -> str:
        self.preprocess()
        self.bisimulate()
        self.summarise()
        return json.dumps(self.experiment_state)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)
