"""A whole run from a configuration: read, fuse, write; with phase timers and a way to stop it."""

from __future__ import annotations

import resource
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave import sinks
from quadweave.config import Config, Output, SourceType, validate
from quadweave.errors import Code, FusionError
from quadweave.functions.quality import metadata_scores
from quadweave.operators.entities import union_sources
from quadweave.operators.mapping import canonical_uris
from quadweave.plans.fusion import FusionJob
from quadweave.session import Table
from quadweave.sources import registry, sparql
from quadweave.sources.rdf import Format, read_uri_list

MEGABYTE = 1024 * 1024


class Phase(Enum):
    """What time is spent on."""

    INITIALIZATION = "Initialization"
    META_INITIALIZATION = "Reading metadata and links"
    DATA_INITIALIZATION = "Data preparation"
    QUAD_LOADING = "Quad loading"
    INPUT_FILTERING = "Input filtering"
    BUFFERING = "Buffering"
    CONFLICT_RESOLUTION = "Conflict resolution"
    OUTPUT_WRITING = "Output writing"
    META_OUTPUT_WRITING = "Writing metadata, canonical names and links"


class Timers:
    """Seconds by phase. Spark runs loading, filtering and resolution as one plan: their time is that of resolution, unless the plan is cut between them."""

    def __init__(self):
        self.seconds = dict.fromkeys(Phase, 0.0)

    @contextmanager
    def of(self, phase: Phase) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[phase] += time.monotonic() - began

    def report(self, spark: SparkSession) -> list[str]:
        runtime = spark._jvm.Runtime.getRuntime()
        lines = [f"{p.value + ':':<48}{duration(s)}" for p, s in self.seconds.items()]
        lines.append(f"{'Memory of the driver, total:':<48}{readable_size(runtime.totalMemory())}")
        lines.append(f"{'Memory of the driver, free:':<48}{readable_size(runtime.freeMemory())}")
        lines.append(f"{'Most memory of this process:':<48}{readable_size(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024)}")
        return lines


def readable_size(n: float) -> str:
    """Bytes in the largest unit of which there is one."""
    for unit in ("B", "kB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def duration(seconds: float) -> str:
    """hours:minutes:seconds.milliseconds."""
    ms = round(seconds * 1000)
    return f"{ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def _guarded(code: Code, what: str, run: Callable[[], DataFrame | None]):
    try:
        return run()
    except FusionError:
        raise
    except Exception as e:
        raise FusionError(code, f"{what}: {e}", e) from e


class Run:
    """One run of a configuration."""

    def __init__(self, config: Config, spark: SparkSession):
        self.config, self.spark, self.timers = config, spark, Timers()
        self.tag = f"quadweave-{uuid.uuid4().hex}"

    def cancel(self) -> None:
        """Stop all that this run does; may be called from another thread."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def quads(self) -> DataFrame:
        c = self.config
        return _guarded(Code.LOADING, "cannot read the data sources", lambda: union_sources(*[registry.read(self.spark, s, c.prefixes) for s in c.data]))

    def job(self) -> FusionJob:
        c, spark = self.config, self.spark
        links = _guarded(Code.SAME_AS_LOAD, "cannot read links", lambda: registry.links(spark, c.same_as, c.prefixes))
        about = _guarded(Code.QUERY_METADATA, "cannot read metadata", lambda: registry.metadata(spark, c.metadata, c.prefixes))
        if links is None:
            links = spark.createDataFrame([], "s string, o string")
        return FusionJob(
            c.policy,
            links.select("s", "o"),
            read_uri_list(spark, c.canonical_input) if c.canonical_input else None,
            None if about is None else metadata_scores(about),
            required_class=c.required_class,
            only_mapped=c.only_mapped,
            max_output=c.max_output,
            result_prefix=c.result_prefix,
            metadata=about,
        )

    def write(self, resolved: DataFrame, output: Output) -> None:
        p = output.params
        if output.type is SourceType.FILE:
            split = p.integer("splitByMB")
            sinks.write_document(resolved, p.required("path"), Format.parse(p.required("format")), output.metadata_context, output.data_context, self.config.prefixes, split * MEGABYTE if split else None)
            return
        quads = sinks.with_metadata(resolved, output.metadata_context, output.data_context)
        if output.type is SourceType.SPARQL:
            sparql.write(quads, sparql.Endpoint(p.required("endpointUrl"), username=p.text("username"), password=p.text("password")))
        else:
            registry.write_jdbc(quads, output)

    def run(self) -> int:
        """Write all outputs; the number of fused statements."""
        c, sc, timers = self.config, self.spark.sparkContext, self.timers
        validate(c)
        sc.addJobTag(self.tag)
        job = None
        try:
            with timers.of(Phase.META_INITIALIZATION):
                job = self.job()
            with timers.of(Phase.DATA_INITIALIZATION):
                quads = self.quads()
            with timers.of(Phase.CONFLICT_RESOLUTION):
                table = _guarded(Code.LOADING, "fusion failed", lambda: Table(job.run(quads)))
            with timers.of(Phase.OUTPUT_WRITING):
                for output in c.outputs:
                    _guarded(Code.OUTPUT_PARAM, f"cannot write output {output}", lambda o=output: self.write(table.df, o))
            with timers.of(Phase.META_OUTPUT_WRITING):
                mapping = job.mapping()
                for output in c.outputs:
                    path = output.params.text("sameAsFile")
                    if output.type is SourceType.FILE and path:
                        split = output.params.integer("splitByMB")
                        sinks.write_links(mapping, path, Format.parse(output.params.text("format", "ntriples")), c.prefixes, split * MEGABYTE if split else None)
                if c.canonical_output:
                    sinks.write_uris(canonical_uris(mapping), c.canonical_output)
            n = table.df.count()
            table.drop()
            return n
        finally:
            if job is not None:
                job.release()
            sc.removeJobTag(self.tag)
