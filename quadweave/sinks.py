"""Sinks: statements as lines, with or without metadata, to files or to any writer."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadweave.operators.mapping import link_dump
from quadweave.schema import COLUMNS, XSD_DOUBLE
from quadweave.session import Table, shared_dir
from quadweave.sources.rdf import Format

QUALITY = "urn:quadweave:quality"
SOURCE = "urn:quadweave:source"


def _escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def term(value: Column, kind: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """A term in N-Triples form."""
    tail = F.lit("")
    if datatype is not None and lang is not None:
        tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(kind == "literal", F.concat(F.lit('"'), _escape(value), F.lit('"'), tail)).when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def nquad_lines(quads: DataFrame, graph: bool = True) -> DataFrame:
    """(value): one line per quad; without graph, per triple."""
    parts = [term(F.col("s"), F.col("s_kind")), term(F.col("p"), F.lit("iri")), term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))]
    if graph:
        parts.append(F.when(F.col("g").startswith("_:"), F.col("g")).when(F.col("g").isNotNull(), F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def _with_kind(resolved: DataFrame) -> DataFrame:
    return resolved if "s_kind" in resolved.columns else resolved.withColumn("s_kind", F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"))


def with_metadata(resolved: DataFrame, metadata_graph: str | None, data_graph: str | None = None) -> DataFrame:
    """Quads of resolved statements. Each in its own graph, with its quality and sources in
    metadata_graph; or, if data_graph is given, all in that graph without metadata."""
    r = _with_kind(resolved)
    data = r.withColumn("g", F.lit(data_graph) if data_graph else F.col("result_graph")).select(*COLUMNS)
    if data_graph or not metadata_graph:
        return data
    none, meta = F.lit(None).cast("string"), F.lit(metadata_graph)

    def about(p: str, o: Column, kind: str, dt: Column) -> list[Column]:
        return [F.col("result_graph").alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), dt.alias("o_dt"), none.alias("o_lang"), meta.alias("g")]

    quality = r.select(*about(QUALITY, F.col("quality").cast("string"), "literal", F.lit(XSD_DOUBLE)))
    sources = r.select("result_graph", F.explode("sources").alias("__source")).select(*about(SOURCE, F.col("__source"), "iri", none))
    return data.unionByName(quality).unionByName(sources)


# ---------------------------------------------------------------- documents


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _short(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """A prefixed name where the namespace has a prefix and the rest is a plain name; null elsewhere."""
    if not prefixes:
        return F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for p, namespace in prefixes.items() for x in (namespace, p)])
    found = F.element_at(names, F.regexp_extract(iri, "^(.*[/#])[^/#]*$", 1))
    local = F.regexp_extract(iri, "([^/#]*)$", 1)
    return F.when(found.isNotNull() & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(found, F.lit(":"), local))


def trig_lines(quads: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """(value): one TriG statement per quad, with prefixed names."""
    iri = lambda c: F.coalesce(_short(c, prefixes), F.concat(F.lit("<"), c, F.lit(">")))
    node = lambda c, kind: F.when(kind == "iri", iri(c)).otherwise(term(c, kind))
    o = F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(term(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    triple = F.concat_ws(" ", node(F.col("s"), F.col("s_kind")), iri(F.col("p")), o, F.lit("."))
    g = F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(iri(F.col("g")))
    return quads.select(F.when(F.col("g").isNull(), triple).otherwise(F.concat(g, F.lit(" { "), triple, F.lit(" }"))).alias("value"))


def rdf_xml_lines(quads: DataFrame) -> DataFrame:
    """(value): one RDF/XML node element per triple; graphs are dropped. Predicates must end in an XML name."""
    about = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="'), F.col("s"))).otherwise(F.concat(F.lit('rdf:about="'), _xml(F.col("s"))))
    local = F.regexp_extract("p", "([A-Za-z_][A-Za-z0-9_.-]*)$", 1)
    local = F.when(local == "", F.raise_error(F.concat(F.lit("no XML name in predicate "), F.col("p"))).cast("string")).otherwise(local)
    namespace = _xml(F.substring("p", F.lit(1), F.length("p") - F.length(local)))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(F.col("o_dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(F.col("o_dt")), F.lit('"'))).otherwise("")
    text = F.replace(F.replace(_xml(F.col("o")), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    value = (
        F.when(F.col("o_kind") == "literal", F.concat(tail, F.lit(">"), text, F.lit("</q:"), local, F.lit(">")))
        .when(F.col("o_kind") == "bnode", F.concat(F.lit(' rdf:nodeID="'), F.col("o"), F.lit('"/>')))
        .otherwise(F.concat(F.lit(' rdf:resource="'), _xml(F.col("o")), F.lit('"/>')))
    )
    return quads.select(F.concat(F.lit("<rdf:Description "), about, F.lit('"><q:'), local, F.lit(' xmlns:q="'), namespace, F.lit('"'), value, F.lit("</rdf:Description>")).alias("value"))


def tuple_lines(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """(value): arrays of (kind, value) terms, as parse_tuples() reads them, in N-Triples form with a full stop."""
    one = lambda t: term(t["value"], t["kind"])
    return rows.select(F.concat(F.array_join(F.transform(terms, one), " "), F.lit(" .")).alias("value"))


def html_rows(resolved: DataFrame, cut: int = 110, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """(value): a table row per statement, all text escaped; known namespaces are shortened."""

    def cell(c: Column) -> Column:
        text = F.when(F.length(c) > cut, F.concat(F.substring(c, 1, cut), F.lit("..."))).otherwise(c)
        return F.concat(F.lit("<td>"), _xml(text), F.lit("</td>"))

    name = lambda c: F.coalesce(_short(c, prefixes or {}), c)
    colour = F.when(F.col("quality") < 0.25, "red").otherwise("green")
    shown = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(name(F.col("o")))
    cells = [cell(name(F.col("s"))), cell(name(F.col("p"))), cell(shown), F.concat(F.lit('<td style="color:'), colour, F.lit('">'), F.format_number("quality", 4), F.lit("</td>")), cell(F.array_join("sources", ", "))]
    return resolved.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def _plain(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def document(resolved: DataFrame, format: Format, metadata_graph: str | None = None, data_graph: str | None = None, prefixes: Mapping[str, str] | None = None) -> tuple[DataFrame, str, str]:
    """(lines, header, footer) of resolved statements in a format."""
    names = dict(prefixes or {})
    if format is Format.HTML:
        known = "".join(f"<li>{_plain(p)}: {_plain(n)}</li>" for p, n in names.items())
        head = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>Fused statements</title></head><body>\n<ul>{known}</ul>\n<table border="1">\n<tr><th>Subject</th><th>Predicate</th><th>Object</th><th>Quality</th><th>Sources</th></tr>\n'
        return html_rows(resolved, prefixes=names), head, "</table></body></html>\n"
    if format is Format.NQUADS:
        return nquad_lines(with_metadata(resolved, metadata_graph, data_graph)), "", ""
    if format is Format.TRIG:
        usable = {p: n for p, n in names.items() if p and n}
        return trig_lines(with_metadata(resolved, metadata_graph, data_graph), usable), "".join(f"@prefix {p}: <{n}> .\n" for p, n in usable.items()), ""
    triples = _with_kind(resolved).withColumn("g", F.lit(None).cast("string"))
    if format is Format.RDF_XML:
        spaces = "".join(f' xmlns:{p}="{_plain(n)}"' for p, n in names.items() if p and p != "rdf" and n)
        return rdf_xml_lines(triples), f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"{spaces}>\n', "</rdf:RDF>\n"
    return nquad_lines(triples, graph=False), "", ""


# ---------------------------------------------------------------- files


def split_name(path: str, n: int) -> str:
    """base-N.ext for the N-th file, from 1."""
    folder, slash, name = path.rpartition("/")
    base, dot, ending = name.rpartition(".")
    return f"{folder}{slash}{base}-{n}.{ending}" if dot and base else f"{folder}{slash}{name}-{n}"


class _Files:
    """Files of any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self._conf)

    def join(self, folder: str, target: str, header: str, footer: str) -> None:
        """The text files of a folder as one file, which appears whole; the JVM copies them, block by block."""
        out_fs, in_fs, target_path = self.system(target), self.system(folder), self.path(target)
        part = self.path(target + ".part")
        out = out_fs.create(part, True)
        try:
            out.write(bytearray(header.encode()))
            found = in_fs.listStatus(self.path(folder)) if in_fs.exists(self.path(folder)) else []
            for name in sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-")):
                stream = in_fs.open(self.path(name))
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
                finally:
                    stream.close()
            out.write(bytearray(footer.encode()))
        finally:
            out.close()
        self.replace(part, target_path, out_fs)

    def replace(self, part, target, fs) -> None:
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"cannot write {target}")

    def remove(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)


def write_single(lines: DataFrame, path: str, header: str = "", footer: str = "", split_bytes: int | None = None) -> list[str]:
    """Lines as one file, or as base-1.ext, base-2.ext, ... of about split_bytes each; the files' names.

    Tasks write the lines to the shared folder; then the files are put together. A line goes into the
    file in which its first byte falls, header and footer not counted, so only a file's last line passes the limit.
    """
    spark = lines.sparkSession
    files, folder = _Files(spark), f"{shared_dir(spark)}/quadweave/{uuid.uuid4().hex}"
    try:
        if not split_bytes:
            lines.write.text(folder)
            files.join(folder, path, header, footer)
            return [path]
        table = Table(lines.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
        size = F.octet_length("value") + 1
        totals = dict(table.df.groupBy("part").agg(F.sum(size)).collect())  # a number for each task
        before, total = [], 0
        for part in sorted(totals):
            before.append((part, total))
            total += totals[part]
        if not before:
            table.drop()
            files.join(folder, split_name(path, 1), header, footer)
            return [split_name(path, 1)]
        known = F.broadcast(spark.createDataFrame(before, "part int, before long"))
        running = F.coalesce(F.sum(size).over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = table.df.withColumn("running", running).join(known, "part").select("value", "row", ((F.col("before") + F.col("running")) / split_bytes).cast("long").alias("file"))
        numbered.repartitionByRange("file").sortWithinPartitions("file", "row").select("value", "file").write.partitionBy("file").text(folder)
        names = []
        for n in range((total - 1) // split_bytes + 1):
            if files.system(folder).exists(files.path(f"{folder}/file={n}")):  # a line longer than the limit leaves a gap
                names.append(split_name(path, len(names) + 1))
                files.join(f"{folder}/file={n}", names[-1], header, footer)
        table.drop()
        return names
    finally:
        files.remove(folder)


def write_file(resolved: DataFrame, path: str, format: str = "nquads", metadata_graph: str | None = None, data_graph: str | None = None, max_records: int | None = None, mode: str = "errorifexists") -> None:
    """One output folder, written by all tasks at once. Formats: nquads, ntriples, parquet; max_records splits files.

    Formats with a header (TriG, RDF/XML, HTML) are single files: see write_document().
    """
    if format == "parquet":
        resolved.write.mode(mode).parquet(path)
        return
    kind = Format.parse(format)
    if kind not in (Format.NQUADS, Format.N3):
        raise ValueError(f"not a format of output folders: {format}")
    lines, _, _ = document(resolved, kind, metadata_graph, data_graph)
    writer = lines.write.mode(mode)
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).text(path)


def write_document(resolved: DataFrame, path: str, format: str | Format, metadata_graph: str | None = None, data_graph: str | None = None, prefixes: Mapping[str, str] | None = None, split_bytes: int | None = None) -> list[str]:
    """Resolved statements as a single file, or as files of about split_bytes, in any output format."""
    kind = format if isinstance(format, Format) else Format.parse(format)
    if kind is None:
        raise ValueError(f"unknown output format {format}")
    lines, header, footer = document(resolved, kind, metadata_graph, data_graph, prefixes)
    return write_single(lines, path, header, footer, split_bytes)


def write_links(mapping: DataFrame, path: str, format: str | Format = Format.N3, prefixes: Mapping[str, str] | None = None, split_bytes: int | None = None) -> list[str]:
    """The equivalence links used, each name to its canonical one."""
    links = link_dump(mapping).select("s", "p", "o", F.lit("iri").alias("s_kind"), F.lit("iri").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_dt", "o_lang", "result_graph")], F.lit(1.0).alias("quality"), F.array().cast("array<string>").alias("sources"))
    return write_document(links, path, format, prefixes=prefixes, split_bytes=split_bytes)


def write_uris(uris: DataFrame, path: str) -> None:
    """(canonical) one IRI per line; the file is replaced as a whole."""
    write_single(uris.select(F.col(uris.columns[0]).alias("value")).distinct().orderBy("value"), path)


def write_all(resolved: DataFrame, writers: list[Callable[[DataFrame], None]]) -> None:
    """Every output gets every statement; the plan runs once."""
    table = Table(resolved)
    try:
        for w in writers:
            w(table.df)
    finally:
        table.drop()
