"""SPARQL endpoints: paged scans, constructed statements, and updates, over plain HTTP.

A scan is split by page number: of k partitions, partition i asks for the pages i, i + k, i + 2k, ...
until one is not full. With a minimum interval between queries there is one partition, which keeps it.
A lost task asks for its pages again. Pages are ordered, so that they neither overlap nor leave gaps.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadweave.schema import COLUMNS, QUAD
from quadweave.sources import rdf

#: Fixed values.
PAGE_ROWS = 10_000
IN_LIST = 25
RETRY_SECONDS, RETRY_ATTEMPTS = 20.0, 540
TIMEOUT_SECONDS = 1200


def with_prefixes(query: str, prefixes: Mapping[str, str]) -> str:
    """The query with declarations of all prefixes, after a BASE that it begins with."""
    block = "".join(f"PREFIX {p}: <{namespace}>\n" for p, namespace in prefixes.items())
    m = re.match(r"\s*BASE\s*<[^>]*>\s*", query, re.IGNORECASE)
    at = m.end() if m else 0
    return query[:at] + block + query[at:]


@dataclass
class Endpoint:
    """How an endpoint is asked: politely, and again if it fails."""

    url: str
    update_url: str | None = None
    username: str | None = None
    password: str | None = None
    min_interval: float = 0.0
    retry_seconds: float = RETRY_SECONDS
    retry_attempts: int = RETRY_ATTEMPTS
    timeout: float = TIMEOUT_SECONDS
    _last: float = float("-inf")

    def _send(self, url: str, form: dict[str, str], accept: str) -> bytes:
        wait = self._last + self.min_interval - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self._last = time.monotonic()
        request = urllib.request.Request(url, urllib.parse.urlencode(form).encode(), {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"})
        if self.username is not None:
            request.add_header("Authorization", "Basic " + base64.b64encode(f"{self.username}:{self.password or ''}".encode()).decode())
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            return response.read()

    def _again(self, url: str, form: dict[str, str], accept: str) -> bytes:
        for attempt in range(self.retry_attempts + 1):
            try:
                return self._send(url, form, accept)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429)
                if refused or attempt == self.retry_attempts:
                    raise
                time.sleep(self.retry_seconds)
        raise AssertionError

    def select(self, query: str) -> list[dict]:
        """Bindings of a SELECT query."""
        return json.loads(self._again(self.url, {"query": query}, "application/sparql-results+json"))["results"]["bindings"]

    def construct(self, query: str) -> str:
        """N-Triples of a CONSTRUCT query."""
        return self._again(self.url, {"query": query}, "application/n-triples, text/plain;q=0.5").decode()

    def update(self, text: str) -> None:
        self._again(self.update_url or self.url, {"update": text}, "*/*")


def _kind(term: dict) -> str:
    return {"uri": "iri", "bnode": "bnode"}.get(term["type"], "literal")


def _row(b: dict, scope: str) -> tuple:
    s, p, o = b["s"], b["p"], b["o"]
    name = lambda t: scope + t["value"] if t["type"] == "bnode" else t["value"]
    g = b.get("g")
    graph = None if g is None else "_:" + name(g) if g["type"] == "bnode" else g["value"]
    return name(s), _kind(s), p["value"], name(o), _kind(o), o.get("datatype"), o.get("xml:lang"), graph


def scan_query(prefixes: Mapping[str, str] | None = None, pattern: str = "", variable: str = "g", limit: int = PAGE_ROWS, offset: int = 0) -> str:
    """A page of all quads in graphs that the pattern finds."""
    restriction = f" {{ {pattern} }}" if pattern else ""
    text = f"SELECT DISTINCT ?{variable} ?s ?p ?o WHERE {{ GRAPH ?{variable} {{ ?s ?p ?o }}{restriction} }} ORDER BY ?{variable} ?s ?p ?o LIMIT {limit} OFFSET {offset}"
    return with_prefixes(text, prefixes or {})


def scan(spark: SparkSession, endpoint: Endpoint, prefixes: Mapping[str, str] | None = None, pattern: str = "", variable: str = "g", page_rows: int = PAGE_ROWS, default_graph: str | None = None, partitions: int = 4) -> DataFrame:
    """All quads of an endpoint, page by page. Missing graphs get default_graph, else the endpoint's address."""
    parts = 1 if endpoint.min_interval > 0 else max(1, partitions)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for page in frame["id"].tolist():
                while True:
                    found = endpoint.select(scan_query(prefixes, pattern, variable, page_rows, page * page_rows))
                    for b in found:
                        if variable != "g" and variable in b:
                            b["g"] = b[variable]
                    yield pd.DataFrame([_row(b, "") for b in found], columns=QUAD.names)
                    if len(found) < page_rows:
                        break
                    page += parts

    quads = spark.range(0, parts, 1, parts).mapInPandas(run, QUAD)
    return quads.withColumn("g", F.coalesce("g", F.lit(default_graph or endpoint.url)))


def resources_query(uris: Iterable[str], prefixes: Mapping[str, str] | None = None, pattern: str = "", variable: str = "g") -> str:
    """All quads of some resources."""
    names = ", ".join(f"<{u.strip()}>" for u in uris)
    restriction = f" {{ {pattern} }}" if pattern else ""
    return with_prefixes(f"SELECT DISTINCT ?{variable} ?s ?p ?o WHERE {{ GRAPH ?{variable} {{ ?s ?p ?o }}{restriction} FILTER (?s IN ({names})) }}", prefixes or {})


def lookup(uris: DataFrame, endpoint: Endpoint, prefixes: Mapping[str, str] | None = None, pattern: str = "", variable: str = "g") -> DataFrame:
    """Quads of the resources in the first column of uris, IN_LIST of them in a query.

    Seeds with their alternatives are best joined with a mapping first; this is for endpoints that are too large to be scanned.
    """
    names = uris.select(F.col(uris.columns[0]).alias("uri")).where("uri is not null").distinct()
    names = names.repartition(1) if endpoint.min_interval > 0 else names

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            own = frame["uri"].tolist()
            for lo in range(0, len(own), IN_LIST):
                found = endpoint.select(resources_query(own[lo : lo + IN_LIST], prefixes, pattern, variable))
                for b in found:
                    if variable in b:
                        b["g"] = b[variable]
                yield pd.DataFrame([_row(b, "") for b in found], columns=QUAD.names)

    return names.mapInPandas(run, QUAD).withColumn("g", F.coalesce("g", F.lit(endpoint.url)))


def constructed(spark: SparkSession, endpoint: Endpoint, query: str, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """Statements that a CONSTRUCT query makes: links or metadata. Their graph is the endpoint's address."""
    text = with_prefixes(query, prefixes or {})

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for _ in frame["id"].tolist():
                lines = endpoint.construct(text).splitlines()
                for lo in range(0, len(lines), 10_000):
                    yield pd.DataFrame({"value": lines[lo : lo + 10_000]})

    return rdf.parse_lines(spark.range(0, 1, 1, 1).mapInPandas(run, "value string"), mode="FAILFAST").withColumn("g", F.coalesce("g", F.lit(endpoint.url)))


# ---------------------------------------------------------------- updates


def encoded_literal(value: Column, datatype: Column, lang: Column) -> Column:
    """A literal in SPARQL, all special characters escaped."""
    text = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.concat(F.lit('"'), text, F.lit('"'), tail)


#: Fixed value: the graph of statements that have none.
RESULT_GRAPH = "urn:quadweave:result"


def insert_rows(quads: DataFrame) -> DataFrame:
    """(graph, triple): quads in the syntax of SPARQL updates. Blank nodes become IRIs, as an update can't name them."""
    node = lambda v, kind: F.when(kind == "bnode", F.concat(F.lit("<urn:nodeid:"), v, F.lit(">"))).otherwise(F.concat(F.lit("<"), v, F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", encoded_literal(F.col("o"), F.col("o_dt"), F.col("o_lang"))).otherwise(node(F.col("o"), F.col("o_kind")))
    g = F.when(F.col("g").isNull(), RESULT_GRAPH).when(F.col("g").startswith("_:"), F.concat(F.lit("urn:nodeid:"), F.substring("g", F.lit(3), F.length("g")))).otherwise(F.col("g"))
    return quads.select(*COLUMNS).select(g.alias("graph"), F.concat_ws(" ", node(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.lit(".")).alias("triple"))


def write(quads: DataFrame, endpoint: Endpoint, batch: int = 500) -> None:
    """Quads inserted at an endpoint, batch statements an update. A task that is run again inserts the same statements, which changes nothing."""
    rows = insert_rows(quads)
    rows = rows.coalesce(1) if endpoint.min_interval > 0 else rows

    def send(part: Iterator) -> None:
        held: dict[str, list[str]] = {}
        n = 0

        def flush() -> None:
            if held:
                endpoint.update("INSERT DATA { " + " ".join(f"GRAPH <{g}> {{ {' '.join(ts)} }}" for g, ts in held.items()) + " }")
                held.clear()

        for r in part:
            held.setdefault(r["graph"], []).append(r["triple"])
            n += 1
            if n % batch == 0:
                flush()
        flush()

    rows.foreachPartition(send)
