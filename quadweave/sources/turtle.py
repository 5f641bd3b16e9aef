"""Turtle, TriG and RDF/XML, read a whole file at a time.

These formats cannot be split, so one task parses one file; large inputs
belong in N-Quads, which is read by native expressions (see rdf.py). Rows leave a file's task in chunks.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.schema import QUAD, RDF_TYPE, XSD
from quadweave.sources.rdf import Format, read_lines

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<bnode>_:[\w.-]*[\w-])
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w.-]*?:(?:[\w:%-]|\.(?=[\w:%-]))*|:(?:[\w:%-]|\.(?=[\w:%-]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>[.;,{}\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


class TurtleParser:
    """Statements of a Turtle or TriG text as rows of the quad model."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.base, self.scope, self.prefixes, self.made = base, scope, {}, 0
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle near {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
        self.at = 0

    def _next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the text ends inside a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def _expect(self, sign: str) -> None:
        if self._next()[1] != sign:
            raise ValueError(f"{sign} expected before {self._peek()!r}")

    def _name(self, kind: str, token: str) -> str:
        if kind == "iri":
            return urljoin(self.base, _unescape(token[1:-1])) if self.base else _unescape(token[1:-1])
        prefix, _, local = token.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"prefix {prefix}: is not declared")
        return self.prefixes[prefix] + local

    def _fresh(self) -> str:
        self.made += 1
        return f"{self.scope}anon{self.made}"

    def _node(self, out: list, graph: str | None) -> tuple[str, str, str | None, str | None]:
        kind, token = self._next()
        if kind in ("iri", "name"):
            return self._name(kind, token), "iri", None, None
        if kind == "bnode":
            return self.scope + token[2:], "bnode", None, None
        if token == "[":
            own = self._fresh()
            if self._peek() != "]":
                self._properties((own, "bnode"), out, graph)
            self._expect("]")
            return own, "bnode", None, None
        if token == "(":
            return *self._list(out, graph), None, None
        if kind == "number":
            return token, "literal", XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None
        if token in ("true", "false"):
            return token, "literal", XSD + "boolean", None
        if kind in ("text", "long"):
            value = _unescape(token[3:-3] if kind == "long" else token[1:-1])
            following = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
            if following == "lang":
                return value, "literal", None, self._next()[1][1:]
            if following == "dt":
                self._next()
                return value, "literal", self._name(*self._next()), None
            return value, "literal", None, None
        raise ValueError(f"no term: {token!r}")

    def _list(self, out: list, graph: str | None) -> tuple[str, str]:
        """The head of a collection, whose members are linked nodes."""
        head = last = None
        while self._peek() != ")":
            o, o_kind, dt, lang = self._node(out, graph)
            own = self._fresh()
            if last is None:
                head = own
            else:
                out.append((last, "bnode", RDF + "rest", own, "bnode", None, None, graph))
            out.append((own, "bnode", RDF + "first", o, o_kind, dt, lang, graph))
            last = own
        self._expect(")")
        if head is None:
            return RDF + "nil", "iri"
        out.append((last, "bnode", RDF + "rest", RDF + "nil", "iri", None, None, graph))
        return head, "bnode"

    def _properties(self, subject: tuple[str, str], out: list, graph: str | None) -> None:
        while True:
            kind, token = self._next()
            p = RDF_TYPE if token == "a" else self._name(kind, token)
            while True:
                o, o_kind, dt, lang = self._node(out, graph)
                out.append((subject[0], subject[1], p, o, o_kind, dt, lang, graph))
                if self._peek() != ",":
                    break
                self._next()
            while self._peek() == ";":
                self._next()
            if self._peek() in (".", "]", "}", ""):
                return

    def parse(self) -> list[tuple]:
        out: list[tuple] = []
        graph = None
        while self.at < len(self.tokens):
            kind, token = self.tokens[self.at]
            low = token.lower()
            if low in ("@prefix", "prefix"):
                self._next()
                name = self._next()[1]
                self.prefixes[name.rstrip(":")] = self._name(*self._next())
                if low[0] == "@":
                    self._expect(".")
            elif low in ("@base", "base"):
                self._next()
                self.base = self._name(*self._next())
                if low[0] == "@":
                    self._expect(".")
            elif token == "}":
                self._next()
                graph = None
            elif token == "{" or low == "graph":
                self._next()
            elif token == ".":
                self._next()
            else:
                s, s_kind, _, _ = self._node(out, graph)
                if self._peek() == "{":
                    self._next()
                    graph = s if s_kind == "iri" else "_:" + s
                    continue
                if self._peek() != ".":
                    self._properties((s, s_kind), out, graph)
                if self._peek() == ".":
                    self._next()
                elif self._peek() != "}":
                    raise ValueError(f"full stop expected before {self._peek()!r}")
        return out


_RDF = "{" + RDF + "}"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def parse_rdf_xml(text: str, base: str = "", scope: str = "") -> list[tuple]:
    """Statements of RDF/XML: node elements, property elements and attributes, nested nodes, parse types."""
    out: list[tuple] = []
    made = [0]
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(e: ET.Element) -> tuple[str, str]:
        if (about := e.get(_RDF + "about")) is not None:
            own = (urljoin(base, about), "iri")
        elif (short := e.get(_RDF + "ID")) is not None:
            own = (f"{base}#{short}", "iri")
        else:
            made[0] += 1
            own = (scope + (e.get(_RDF + "nodeID") or f"anon{made[0]}"), "bnode")
        if e.tag != _RDF + "Description":
            out.append((*own, RDF_TYPE, name(e.tag), "iri", None, None, None))
        for key, value in e.attrib.items():
            if not key.startswith(_RDF) and key != _LANG:
                out.append((*own, name(key), value, "literal", None, e.get(_LANG), None))
        properties(e, own)
        return own

    def fresh() -> str:
        made[0] += 1
        return f"{scope}anon{made[0]}"

    def properties(e: ET.Element, own: tuple[str, str]) -> None:
        for child in e:
            p, kind = name(child.tag), child.get(_RDF + "parseType")
            if kind == "Resource":
                inner = (fresh(), "bnode")
                out.append((*own, p, *inner, None, None, None))
                properties(child, inner)
            elif kind == "Collection":
                members = [node(x) for x in child]
                nodes = [(fresh(), "bnode") for _ in members] + [(RDF + "nil", "iri")]
                out.append((*own, p, *nodes[0], None, None, None))
                for k, m in enumerate(members):
                    out.append((*nodes[k], RDF + "first", *m, None, None, None))
                    out.append((*nodes[k], RDF + "rest", *nodes[k + 1], None, None, None))
            elif kind is not None:  # Literal, as are all others
                text = (child.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in child)
                out.append((*own, p, text, "literal", RDF + "XMLLiteral", None, None))
            elif (resource := child.get(_RDF + "resource")) is not None:
                out.append((*own, p, urljoin(base, resource), "iri", None, None, None))
            elif (blank := child.get(_RDF + "nodeID")) is not None:
                out.append((*own, p, scope + blank, "bnode", None, None, None))
            elif len(child):
                for inner in child:
                    o, kind = node(inner)
                    out.append((*own, p, o, kind, None, None, None))
            else:
                out.append((*own, p, child.text or "", "literal", child.get(_RDF + "datatype"), child.get(_LANG) or e.get(_LANG), None))

    root = ET.fromstring(text)
    for e in root if root.tag == _RDF + "RDF" else [root]:
        node(e)
    return out


def read_files(spark: SparkSession, path: str, format: Format | str | None = None, base: str = "", default_graph: str | None = None) -> DataFrame:
    """Quads of a file or folder in any input format; the format is told by name, else by the path's ending.

    Blank nodes are kept apart by file. Missing graphs get default_graph, else the path.
    """
    kind = format if isinstance(format, Format) else Format.parse(format) if format else Format.of_path(path)
    if kind is None or kind is Format.HTML:
        raise ValueError(f"not an input format: {format}")
    graph = default_graph or base or path
    if kind is Format.NQUADS:
        return read_lines(spark, path, graph)

    def run(frames: Iterator) -> Iterator:
        import gzip

        import pandas as pd

        for frame in frames:
            for where, raw in zip(frame["path"], frame["content"], strict=True):
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)).decode()
                scope = blake2b(where.encode(), digest_size=6).hexdigest() + "-"
                rows = parse_rdf_xml(text, base, scope) if kind is Format.RDF_XML else TurtleParser(text, base, scope).parse()
                for lo in range(0, max(len(rows), 1), 50_000):
                    yield pd.DataFrame(rows[lo : lo + 50_000], columns=QUAD.names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, QUAD).withColumn("g", F.coalesce("g", F.lit(graph)))
