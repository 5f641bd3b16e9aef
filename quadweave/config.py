"""Configuration: prefixes, sources, processing, resolution strategies and outputs, in Python or from XML."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from quadweave.errors import InvalidInput
from quadweave.functions.resolution import IGNORE, MANY, RETURN_ALL, SINGLE, Strategy
from quadweave.plans.fusion import Policy
from quadweave.sources.rdf import Format

DEFAULT_GRAPH_VARIABLE = "g"
RESULT_PREFIX = "urn:quadweave:result:"

_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|^`\\]*")
_PREFIX = re.compile(r"[^\W\d_](?:[\w.-]*[\w-])?")
_VARIABLE = re.compile(r"\w+")


# ---------------------------------------------------------------- names


def is_iri(text: str) -> bool:
    """Whether text is an absolute IRI."""
    return bool(_IRI.fullmatch(text))


def is_prefix(text: str) -> bool:
    """Whether text may stand before the colon of a prefixed name."""
    return bool(_PREFIX.fullmatch(text))


def is_variable(text: str) -> bool:
    """Whether text may name a SPARQL variable."""
    return bool(_VARIABLE.fullmatch(text))


def expand(name: str, prefixes: Mapping[str, str]) -> str:
    """A full IRI from a prefixed name; IRIs with an authority stay, undefined prefixes are an error."""
    head, colon, tail = name.partition(":")
    if not colon:
        raise InvalidInput(f"'{name}' is neither an IRI nor a prefixed name")
    if tail.startswith("//"):
        return name
    if head in prefixes:
        return prefixes[head] + tail
    if is_iri(name) and head.lower() in ("urn", "mailto", "tag", "data"):
        return name
    raise InvalidInput(f"prefix '{head}' of '{name}' is not defined")


def shorten(iri: str, prefixes: Mapping[str, str]) -> str:
    """A prefixed name if the part up to the last slash or hash is a known namespace, else the IRI."""
    at = max(iri.rfind("/"), iri.rfind("#")) + 1
    by = {namespace: p for p, namespace in prefixes.items()}
    return f"{by[iri[:at]]}:{iri[at:]}" if at and iri[:at] in by else iri


# ---------------------------------------------------------------- parameters


def _long(text: str) -> int:
    if not re.fullmatch(r"[+-]?\d{1,19}", text):
        raise ValueError(text)
    return int(text)


class Params(dict):
    """Parameters with lower-case names, and typed readers of them."""

    def __init__(self, given: Mapping[str, str | None] | None = None):
        super().__init__({k.lower(): v for k, v in (given or {}).items()})

    def required(self, name: str) -> str:
        value = self.get(name.lower())
        if value is None:
            raise InvalidInput(f"missing required parameter '{name}'")
        return value

    def text(self, name: str, default: str | None = None) -> str | None:
        value = self.get(name.lower())
        return default if value is None else value

    def _read(self, name: str, default, kind: Callable):
        value = self.get(name.lower())
        if value is None or value == "":
            return default
        try:
            return kind(value)
        except ValueError:
            return default  # malformed values count as absent

    def integer(self, name: str, default: int | None = None) -> int | None:
        return self._read(name, default, _long)

    def number(self, name: str, default: float | None = None) -> float | None:
        return self._read(name, default, float)

    def boolean(self, name: str, default: bool | None = None) -> bool | None:
        return self._read(name, default, lambda v: v.strip().lower() == "true")


# ---------------------------------------------------------------- model


class SourceType(Enum):
    VIRTUOSO = "virtuoso"
    SPARQL = "sparql"
    FILE = "file"


@dataclass
class Restriction:
    """A graph pattern that binds a variable: only the graphs it finds are read from an endpoint."""

    pattern: str = ""
    variable: str = DEFAULT_GRAPH_VARIABLE


@dataclass
class Source:
    """Where statements come from. construct: the query that makes links or metadata at an endpoint."""

    type: SourceType
    params: Params = field(default_factory=Params)
    name: str | None = None
    restriction: Restriction = field(default_factory=Restriction)
    construct: str | None = None

    def __str__(self) -> str:
        return self.name or self.type.value


@dataclass
class Output:
    type: SourceType
    params: Params = field(default_factory=Params)
    name: str | None = None
    data_context: str | None = None
    metadata_context: str | None = None

    def __str__(self) -> str:
        return self.name or self.type.value


@dataclass
class Config:
    """All that a run needs."""

    prefixes: dict[str, str] = field(default_factory=dict)
    data: list[Source] = field(default_factory=list)
    same_as: list[Source] = field(default_factory=list)
    metadata: list[Source] = field(default_factory=list)
    canonical_output: str | None = None
    canonical_input: str | None = None
    enable_file_cache: bool = False
    max_output: int | None = None
    local_copy: bool = True
    required_class: str | None = None
    policy: Policy = field(default_factory=Policy)
    outputs: list[Output] = field(default_factory=list)
    result_prefix: str = RESULT_PREFIX
    only_mapped: bool = False
    profile: bool = False


# ---------------------------------------------------------------- XML


def _children(element: ET.Element | None, tag: str) -> list[ET.Element]:
    return [] if element is None else [e for e in element if e.tag == tag]


def _params(element: ET.Element) -> dict[str, str | None]:
    out = {}
    for p in _children(element, "Param"):
        if not p.get("name"):
            raise InvalidInput("a Param has no name")
        out[p.get("name")] = p.get("value")
    return out


def _type(element: ET.Element, what: str) -> SourceType:
    given = (element.get("type") or "").lower()
    try:
        return SourceType(given)
    except ValueError:
        raise InvalidInput(f"unknown type of {what}: {element.get('type')}") from None


def _pattern(text: str | None) -> str:
    """A group pattern without the braces around the whole of it."""
    text = (text or "").strip()
    depth = 0
    if text.startswith("{") and text.endswith("}"):
        for k, c in enumerate(text):
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[1:-1].strip() if k == len(text) - 1 else text
    return text


def _data_source(e: ET.Element) -> Source:
    r = next(iter(_children(e, "GraphRestriction")), None)
    restriction = Restriction() if r is None else Restriction(_pattern(r.text), r.get("var") or DEFAULT_GRAPH_VARIABLE)
    return Source(_type(e, "data source"), Params(_params(e)), e.get("name"), restriction)


def _construct_source(e: ET.Element) -> Source:
    query = next(iter(_children(e, "ConstructQuery")), None)
    kind = _type(e, "data source")
    if query is None or not (query.text or "").strip():
        raise InvalidInput("empty CONSTRUCT query")
    return Source(kind, Params(_params(e)), e.get("name"), construct=query.text.strip())


def _strategy(e: ET.Element, prefixes: Mapping[str, str]) -> Strategy:
    def one_of(name: str, *allowed: str) -> str | None:
        value = e.get(name)
        if value is not None and value.upper() not in allowed:
            raise InvalidInput(f"{name} can't be '{value}'")
        return value and value.upper()

    depends = e.get("dependsOn")
    return Strategy(
        e.get("function"),
        one_of("cardinality", SINGLE, MANY),
        one_of("aggregationErrorStrategy", IGNORE, RETURN_ALL),
        expand(depends, prefixes) if depends else None,
        {k: v for k, v in _params(e).items() if v is not None},
    )


def _output(e: ET.Element) -> Output:
    out = Output(_type(e, "output"), Params(_params(e)), e.get("name"))
    p = out.params
    if out.type is SourceType.FILE:
        for name in ("format", "path"):
            if name in p and p[name] is None:
                raise InvalidInput(f"{name} of output {out} must be given")
        if "format" in p and Format.parse(p["format"]) is None:
            raise InvalidInput(f"unknown output format '{p['format']}' for output {out}")
        if p.get("splitbymb") is not None:
            try:
                size = _long(p["splitbymb"])
            except ValueError:
                size = 0
            if size <= 0:
                raise InvalidInput(f"splitByMB of output {out} is not a positive number")
    for name, attribute in (("metadataContext", "metadata_context"), ("dataContext", "data_context")):
        value = p.get(name.lower())
        if value is not None:
            if not is_iri(value):
                raise InvalidInput(f"{name} is not a valid IRI for output {out}")
            setattr(out, attribute, value)
    return out


def parse(text: str | bytes) -> Config:
    """A configuration from XML text."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise InvalidInput(f"the configuration is not XML: {e}") from e
    part = lambda tag: next(iter(_children(root, tag)), None)
    if part("Sources") is None or part("Outputs") is None:
        raise InvalidInput("the configuration needs Sources and Outputs")
    prefixes = {p.get("id") or "": p.get("namespace") or "" for p in _children(part("Prefixes"), "Prefix")}
    config = Config(prefixes)
    sources = part("Sources")
    config.data = [_data_source(e) for e in _children(sources, "DataSource")]
    config.same_as = [_construct_source(e) for e in _children(sources, "SameAsSource")]
    config.metadata = [_construct_source(e) for e in _children(sources, "MetadataSource")]
    if (e := part("DataProcessing")) is not None:
        _processing(config, _params(e))
    if (e := part("ConflictResolution")) is not None:
        default = next(iter(_children(e, "DefaultStrategy")), None)
        properties = {}
        for s in _children(e, "ResolutionStrategy"):
            strategy = _strategy(s, prefixes)
            for p in _children(s, "Property"):
                properties[expand(p.get("id") or "", prefixes)] = strategy
        config.policy = Policy(Strategy() if default is None else _strategy(default, prefixes), properties)
    config.outputs = [_output(e) for e in _children(part("Outputs"), "Output")]
    return config


def _processing(config: Config, params: Mapping[str, str | None]) -> None:
    for name, value in params.items():
        if value is None:
            continue
        low = name.lower()
        if low == "canonicalurioutputfile":
            config.canonical_output = value or None
        elif low == "canonicaluriinputfile":
            config.canonical_input = value or None
        elif low == "enablefilecache":  # Spark spills by itself: accepted, without effect
            config.enable_file_cache = value.strip().lower() == "true" if value else config.enable_file_cache
        elif low == "maxoutputtriples":
            try:
                config.max_output = _long(value)
            except ValueError:
                raise InvalidInput("maxOutputTriples is not a number") from None
        elif low == "localcopyprocessing":
            config.local_copy = value.strip().lower() == "true" if value else config.local_copy
        elif low == "processresourceswithclass":
            config.required_class = expand(value, config.prefixes) if value else None
        else:
            raise InvalidInput(f"unknown parameter {name} of data processing")


def read(path: str) -> Config:
    """A configuration from an XML file."""
    try:
        with open(path, "rb") as f:
            return parse(f.read())
    except OSError as e:
        raise InvalidInput(f"cannot read configuration {path}: {e}") from e


# ---------------------------------------------------------------- validation


_REQUIRED = {SourceType.VIRTUOSO: ("host", "port", "username", "password"), SourceType.SPARQL: ("endpointUrl",), SourceType.FILE: ("path",)}


def _readable(path: str) -> bool:
    return "://" in path or os.path.isfile(path) and os.access(path, os.R_OK)  # other file systems tell when they are read


def validate(config: Config) -> None:
    """InvalidInput if a run could not begin."""
    if not is_iri(config.result_prefix):
        raise InvalidInput(f"the prefix of results must be an IRI, not '{config.result_prefix}'")
    for prefix, namespace in config.prefixes.items():
        if prefix and not is_prefix(prefix):
            raise InvalidInput(f"invalid namespace prefix '{prefix}'")
        if namespace and not is_iri(namespace):
            raise InvalidInput(f"invalid namespace '{namespace}' of prefix '{prefix}'")
    if not config.data:
        raise InvalidInput("there must be at least one DataSource")
    for source in [*config.data, *config.same_as, *config.metadata]:
        for name in _REQUIRED[source.type]:
            if source.params.get(name.lower()) is None:
                raise InvalidInput(f"missing required parameter '{name}' of source {source}")
        if source.type is SourceType.FILE and not _readable(source.params["path"]):
            raise InvalidInput(f"cannot read input file {source.params['path']}")
        if not is_variable(source.restriction.variable):
            raise InvalidInput(f"'{source.restriction.variable}' can't be a SPARQL variable (source {source})")
    for output in config.outputs:
        path = output.params.get("path")
        if output.type is SourceType.FILE and path and "://" not in path and os.path.exists(path) and not os.access(path, os.W_OK):
            raise InvalidInput(f"cannot write to output file {path}")
