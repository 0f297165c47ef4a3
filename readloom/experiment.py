"""The container: an immutable set of tables that belong together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ["chrom", "pos", "strand"]


@dataclass(frozen=True)
class ModExperiment:
    """Samples, reads, positions and observations. A missing row of `calls` is a base that was not observed.

    samples(sample, modbase, n_reads), reads(sample, read_id, read_ord, qscore), positions(chrom, pos, strand[, seq_context]),
    calls(sample, read_id, chrom, pos, strand, mod_prob), pileup(sample, chrom, pos, strand, n_mod, n_valid, ...),
    read_stats(sample, read_id, ...), thresholds(sample, call_code, kind, value), seqinfo(chrom, chrom_ord, length).
    """

    samples: DataFrame
    positions: DataFrame
    reads: DataFrame | None = None
    calls: DataFrame | None = None
    pileup: DataFrame | None = None
    read_stats: DataFrame | None = None
    thresholds: DataFrame | None = None
    seqinfo: DataFrame | None = None
    stats_meta: dict | None = None

    def with_(self, **tables) -> ModExperiment:
        return replace(self, **tables)

    def _each(self, change) -> ModExperiment:
        """Apply a change to every table with samples."""
        names = ("samples", "reads", "calls", "pileup", "read_stats", "thresholds")
        return self.with_(**{n: change(getattr(self, n)) for n in names if getattr(self, n) is not None})

    def select_samples(self, *samples: str) -> ModExperiment:
        return self._each(lambda t: t.where(F.col("sample").isin(*samples)))

    def select_positions(self, positions: DataFrame) -> ModExperiment:
        """Only the given (chrom, pos, strand)."""
        keep = lambda t: t if t is None else t.join(positions, POSITION, "left_semi")
        return self.with_(positions=keep(self.positions), calls=keep(self.calls), pileup=keep(self.pileup))

    def select_rows(self, *names: str) -> ModExperiment:
        """Positions by their names chrom:pos:strand."""
        rows = [(n.rsplit(":", 2)[0], int(n.rsplit(":", 2)[1]), n.rsplit(":", 2)[2]) for n in names]
        return self.select_positions(self.positions.sparkSession.createDataFrame(rows, "chrom string, pos int, strand string"))

    def renamed(self, names: dict[str, str]) -> ModExperiment:
        old = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
        return self._each(lambda t: t.withColumn("sample", F.coalesce(F.element_at(old, F.col("sample")), F.col("sample")))) if names else self

    def bind(self, other: ModExperiment) -> ModExperiment:
        """Samples of both; their names must differ."""
        if not self.samples.join(other.samples, "sample", "left_semi").isEmpty():
            raise ValueError("both have a sample of the same name")
        both = lambda a, b: a if b is None else b if a is None else a.unionByName(b, allowMissingColumns=True)
        names = ("samples", "reads", "calls", "pileup", "read_stats", "thresholds")
        return self.with_(positions=both(self.positions, other.positions).distinct(), **{n: both(getattr(self, n), getattr(other, n)) for n in names})

    def with_assay(self, name: str, value, level: str = "calls") -> ModExperiment:
        """Add a column to the calls or the pileup."""
        return self.with_(**{level: getattr(self, level).withColumn(name, value)})

    def read_level_assays(self) -> list[str]:
        fixed = {"sample", "read_id", *POSITION}
        return [c for c in self.calls.columns if c not in fixed] if self.calls is not None else []

    def dense(self, assay: str = "mod_prob") -> DataFrame:
        """Positions by reads of a small region: a column a read, null where not observed."""
        return self.calls.groupBy(*POSITION).pivot("read_id").agg(F.first(assay))

    def dense_pileup(self, columns: tuple[str, ...] = ("n_mod", "n_valid")) -> DataFrame:
        """Every position of every sample, 0 where there is nothing."""
        grid = self.positions.select(*POSITION).crossJoin(F.broadcast(self.samples.select("sample")))  # samples are the columns of a result
        return grid.join(self.pileup, ["sample", *POSITION], "left").fillna(0, list(columns))

    def read_names(self) -> DataFrame:
        """(sample, read_id, name) with the name sample-read, which is unique over all samples."""
        return self.reads.select("sample", "read_id", F.concat_ws("-", "sample", "read_id").alias("name"))

    def per_sample(self, change) -> dict[str, object]:
        """What `change` makes of the experiment of each sample alone, by sample."""
        return {r["sample"]: change(self.select_samples(r["sample"])) for r in self.samples.select("sample").collect()}  # the samples are columns of a result

    def qscores(self) -> DataFrame:
        return self.reads.select("sample", "read_id", "qscore")

    def validate(self) -> None:
        """Raise where keys of one table lack in another, or a sample or read is there twice."""
        twice = lambda t, *k: not t.groupBy(*k).count().where("count > 1").isEmpty()
        lacks = lambda a, b, *k: a is not None and b is not None and not a.join(b, list(k), "left_anti").isEmpty()
        faults = {
            "a sample without a name": lambda: not self.samples.where("sample is null").isEmpty(),
            "repeated samples": lambda: twice(self.samples, "sample"),
            "repeated reads": lambda: self.reads is not None and twice(self.reads, "sample", "read_id"),
            "reads of unknown samples": lambda: lacks(self.reads, self.samples, "sample"),
            "calls of unknown reads": lambda: lacks(self.calls, self.reads, "sample", "read_id"),
            "calls at unknown positions": lambda: lacks(self.calls, self.positions, *POSITION),
            "pileup of unknown samples": lambda: lacks(self.pileup, self.samples, "sample"),
            "statistics of unknown reads": lambda: lacks(self.read_stats, self.reads, "sample", "read_id"),
            "reads without statistics": lambda: lacks(self.reads, self.read_stats, "sample", "read_id"),
        }
        if found := [name for name, wrong in faults.items() if wrong()]:
            raise ValueError("; ".join(found))

    def repeated_calls(self) -> int:
        """Calls whose probability is a sum of several and exceeds one."""
        return self.calls.where("mod_prob > 1").count()
