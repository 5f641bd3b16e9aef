import gzip

import pytest

from quadweave.schema import RDF_TYPE, XSD
from quadweave.sources.turtle import TurtleParser, parse_rdf_xml, read_files

TRIG = """@prefix ex: <http://ex/> .
# links
ex:a a ex:C ; ex:p "x\\ny"@en , 'z' , 5, 1.5, true ; ex:q [ ex:r ex:b ] .
ex:g { ex:a ex:p ex:b . _:n ex:p "1"^^<http://www.w3.org/2001/XMLSchema#int> }
<http://ex/d> ex:p ex:e.
"""


def test_trig():
    rows = TurtleParser(TRIG, scope="f-").parse()
    assert (("http://ex/a", "iri", RDF_TYPE, "http://ex/C", "iri", None, None, None)) in rows
    objects = {(r[3], r[5], r[6]) for r in rows if r[0] == "http://ex/a" and r[2] == "http://ex/p" and r[7] is None}
    assert objects == {("x\ny", None, "en"), ("z", None, None), ("5", XSD + "integer", None), ("1.5", XSD + "decimal", None), ("true", XSD + "boolean", None)}
    assert ("f-anon1", "bnode", "http://ex/r", "http://ex/b", "iri", None, None, None) in rows
    assert ("f-n", "bnode", "http://ex/p", "1", "literal", XSD + "int", None, "http://ex/g") in rows
    assert rows[-1] == ("http://ex/d", "iri", "http://ex/p", "http://ex/e", "iri", None, None, None)
    with pytest.raises(ValueError, match="not declared"):
        TurtleParser("x:a x:b x:c .").parse()


def test_rdf_xml():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex/">
    <ex:C rdf:about="http://ex/a" ex:n="v"><ex:p rdf:resource="http://ex/b"/><ex:q xml:lang="en">t</ex:q></ex:C></rdf:RDF>"""
    assert {(r[2], r[3], r[6]) for r in parse_rdf_xml(text)} == {(RDF_TYPE, "http://ex/C", None), ("http://ex/n", "v", None), ("http://ex/p", "http://ex/b", None), ("http://ex/q", "t", "en")}


def test_files(spark, tmp_path):
    (tmp_path / "a.trig.gz").write_bytes(gzip.compress(TRIG.encode()))
    got = read_files(spark, str(tmp_path / "a.trig.gz"), default_graph="urn:d")
    assert got.count() == 11 and {r.g for r in got.select("g").distinct().collect()} == {"urn:d", "http://ex/g"}


def test_collections_and_long_strings():
    rows = TurtleParser("<http://s> <http://p> (1 <http://x>), () ; <http://q> \'\'\'it\'s\n\'\'two\'\'\'@en .").parse()
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    heads = [r[3] for r in rows if r[2] == "http://p"]
    first = {r[0]: r[3] for r in rows if r[2] == rdf + "first"}
    rest = {r[0]: r[3] for r in rows if r[2] == rdf + "rest"}
    assert heads[1] == rdf + "nil" and first[heads[0]] == "1" and first[rest[heads[0]]] == "http://x" and rest[rest[heads[0]]] == rdf + "nil"
    assert [r[3] for r in rows if r[2] == "http://q"] == ["it\'s\n\'\'two"]


def test_rdf_xml_parse_types():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex/"><rdf:Description rdf:about="http://ex/a">
    <ex:r rdf:parseType="Resource"><ex:v>1</ex:v></ex:r><ex:c rdf:parseType="Collection"><rdf:Description rdf:about="http://ex/m"/><rdf:Description rdf:about="http://ex/n"/></ex:c>
    <ex:l rdf:parseType="Literal">x<ex:b/>y</ex:l></rdf:Description></rdf:RDF>"""
    rows = parse_rdf_xml(text)
    by = {}
    for r in rows:
        by.setdefault(r[2].rpartition("/")[2].rpartition("#")[2], []).append(r)
    assert by["v"][0][0] == by["r"][0][3] and [r[3] for r in by["first"]] == ["http://ex/m", "http://ex/n"] and by["rest"][-1][3].endswith("nil")
    assert by["c"][0][3] == by["first"][0][0] and by["l"][0][3].startswith("x<") and by["l"][0][5].endswith("XMLLiteral")
