"""Configuration, endpoints, output documents and the command line."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from quadweave import cli, config, runner, sinks
from quadweave.errors import Code, FusionError, InvalidInput
from quadweave.functions import quality as Q
from quadweave.functions.resolution import Strategy
from quadweave.plans.fusion import FusionJob, Policy
from quadweave.schema import QUAD
from quadweave.sources import rdf, registry, sparql
from quadweave.sources.turtle import TurtleParser, parse_rdf_xml

HEAD = '<Config><Prefixes><Prefix id="ex" namespace="http://ex/"/></Prefixes>'


def quad(s, p, o, g="http://g/1", kind="iri", dt=None, lang=None):
    return (s, "bnode" if s.startswith("_:") else "iri", p, o, kind, dt, lang, g)


def xml(sources, outputs='<Output type="file"><Param name="path" value="o.nq"/><Param name="format" value="nquads"/></Output>', more=""):
    return f"{HEAD}<Sources>{sources}</Sources>{more}<Outputs>{outputs}</Outputs></Config>"


FILE = '<DataSource type="FILE"><Param name="PATH" value="{}"/></DataSource>'


def test_configuration():
    c = config.parse(
        xml(
            '<DataSource type="sparql" name="e"><Param name="endpointURL" value="http://e"/><GraphRestriction var="x">{ ?x a ex:G }</GraphRestriction></DataSource>'
            '<SameAsSource type="sparql"><ConstructQuery>CONSTRUCT {?s ?p ?o} WHERE {?s ?p ?o}</ConstructQuery><Param name="endpointUrl" value="http://e"/></SameAsSource>',
            more='<DataProcessing><Param name="MAXoutputTriples" value="7"/><Param name="processResourcesWithClass" value="ex:C"/><Param name="localCopyProcessing" value="false"/></DataProcessing>'
            '<ConflictResolution><DefaultStrategy function="BEST"/><ResolutionStrategy function="AVG" cardinality="singlevalued" dependsOn="ex:q"><Param name="k" value="v"/><Property id="ex:p"/><Property id="ex:q"/></ResolutionStrategy></ConflictResolution>',
        )
    )
    assert c.max_output == 7 and c.required_class == "http://ex/C" and not c.local_copy
    assert c.data[0].restriction == config.Restriction("?x a ex:G", "x") and c.data[0].params.required("endpointUrl") == "http://e"
    assert c.policy.default.function == "BEST" and c.policy.properties["http://ex/p"] == Strategy("AVG", "SINGLEVALUED", None, "http://ex/q", {"k": "v"})
    config.validate(c)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("<Config>", "not XML"),
        ("<Config/>", "Sources"),
        (xml('<DataSource type="odd"/>'), "unknown type"),
        (xml('<SameAsSource type="file"/>'), "empty CONSTRUCT"),
        (xml("", more='<DataProcessing><Param name="odd" value="1"/></DataProcessing>'), "unknown parameter"),
        (xml("", more='<DataProcessing><Param name="maxOutputTriples" value="many"/></DataProcessing>'), "not a number"),
        (xml("", '<Output type="file"><Param name="format" value="odd"/></Output>'), "unknown output format"),
        (xml("", '<Output type="file"><Param name="splitByMB" value="0"/></Output>'), "not a positive"),
        (xml("", '<Output type="file"><Param name="dataContext" value="no iri"/></Output>'), "not a valid IRI"),
        (xml("", more='<ConflictResolution><ResolutionStrategy><Property id="no:x"/></ResolutionStrategy></ConflictResolution>'), "not defined"),
    ],
)
def test_bad_configuration(text, said):
    with pytest.raises(InvalidInput, match=said):
        config.parse(text)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (xml(""), "at least one"),
        (xml('<DataSource type="sparql"/>'), "endpointUrl"),
        (xml(FILE.format("/no/such/file")), "cannot read"),
        (xml('<DataSource type="virtuoso"><Param name="host" value="h"/></DataSource>'), "port"),
        (xml('<DataSource type="sparql"><Param name="endpointUrl" value="http://e"/><GraphRestriction var="a b">x</GraphRestriction></DataSource>'), "variable"),
    ],
)
def test_invalid_configuration(text, said):
    with pytest.raises(InvalidInput, match=said):
        config.validate(config.parse(text))


def test_names_and_parameters():
    p = config.Params({"Size": "12", "Bad": "x", "Flag": "TRUE", "None": None})
    assert (p.integer("size"), p.integer("bad", 3), p.boolean("FLAG"), p.number("size"), p.text("none", "d")) == (12, 3, True, 12.0, "d")
    with pytest.raises(InvalidInput):
        p.required("other")
    assert config.expand("ex:a", {"ex": "http://ex/"}) == "http://ex/a" and config.expand("http://x/y", {}) == "http://x/y" and config.expand("urn:x", {}) == "urn:x"
    assert config.shorten("http://ex/#a", {"e": "http://ex/#"}) == "e:a" and config.shorten("http://no/a", {"e": "http://ex/"}) == "http://no/a"
    assert sparql.with_prefixes("BASE <http://b/> SELECT", {"a": "http://a/"}) == "BASE <http://b/> PREFIX a: <http://a/>\nSELECT"
    assert runner.readable_size(1536) == "1.50 kB" and runner.duration(3723.5) == "1:02:03.500"
    assert cli.arguments(["-vv", "--only-mapped", "--only-conflicts", "--profile", "c.xml"]) == cli.Arguments("c.xml", 2, True, True, True)
    assert str(FusionError(Code.OUTPUT_PARAM, "x")) == "Error 25: x"


class Server(BaseHTTPRequestHandler):
    rows, asked, updates, failures = [], [], [], 0

    def do_POST(self):
        form = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
        if "update" in form:
            Server.updates.append((form["update"][0], self.headers.get("Authorization")))
            body = b""
        elif Server.failures:
            Server.failures -= 1
            self.send_error(503)
            return
        else:
            query = form["query"][0]
            Server.asked.append(query)
            if "CONSTRUCT" in query:
                body = b"<http://a> <http://odd/p> <http://b> .\n"
            else:
                limit, offset = (int(query.split(k)[1].split()[0]) for k in ("LIMIT", "OFFSET")) if "LIMIT" in query else (9999, 0)
                body = json.dumps({"results": {"bindings": Server.rows[offset : offset + limit]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    term = lambda v: {"type": "uri", "value": v}
    Server.rows = [{"g": term("http://g"), "s": term(f"http://s/{i:03d}"), "p": term("http://p"), "o": {"type": "literal", "value": f"v{i}", "xml:lang": "en"}} for i in range(57)]
    Server.asked, Server.updates, Server.failures = [], [], 0
    yield f"http://127.0.0.1:{http.server_port}/"
    http.shutdown()


def test_endpoint_scan(spark, server):
    end = sparql.Endpoint(server, retry_seconds=0.01, retry_attempts=3)
    Server.failures = 2
    got = sparql.scan(spark, end, {"ex": "http://ex/"}, "?g a ex:G", page_rows=10).collect()
    assert sorted(r.s for r in got) == [f"http://s/{i:03d}" for i in range(57)] and got[0].o_lang == "en" and got[0].g == "http://g"
    assert all(q.startswith("PREFIX ex: <http://ex/>\n") and "{ ?g a ex:G }" in q for q in Server.asked)
    Server.failures = 99
    with pytest.raises(Exception, match="503"):
        sparql.scan(spark, end, page_rows=10).collect()
    Server.failures = 0
    names = spark.createDataFrame([(f"http://s/{i}",) for i in range(60)], "uri string")
    Server.asked = []
    sparql.lookup(names.coalesce(1), end).count()
    assert [q.count("<http://s/") for q in Server.asked] == [25, 25, 10] or sum(q.count("<http://s/") for q in Server.asked) == 60


def test_endpoint_sources_and_updates(spark, server):
    source = config.Source(config.SourceType.SPARQL, config.Params({"endpointUrl": server, "minQueryInterval": "1"}), construct="CONSTRUCT {?s ?p ?o} WHERE {?s ?p ?o}")
    assert [tuple(r) for r in registry.links(spark, [source]).collect()] == [("http://a", "http://b", 0)]
    assert registry.read(spark, source).count() == 57
    rows = [quad("http://s", "http://p", 'a"b\n\'c\\', kind="literal", lang="en"), quad("b1", "http://p", "b2", None, "bnode")]
    quads = spark.createDataFrame(rows, QUAD).withColumn("s_kind", F.when(F.col("s") == "b1", "bnode").otherwise("iri"))
    sparql.write(quads, sparql.Endpoint(server, username="u", password="p"))
    text = " ".join(t for t, _ in Server.updates)
    assert "GRAPH <http://g/1> { <http://s> <http://p> \"a\\\"b\\n\\'c\\\\\"@en . }" in text and "GRAPH <urn:quadweave:result> { <urn:nodeid:b1> <http://p> <urn:nodeid:b2> . }" in text
    assert Server.updates[0][1].startswith("Basic ")
    virtuoso = config.Source(config.SourceType.VIRTUOSO, config.Params({"host": "h", "port": "1111", "username": "u", "password": "p"}))
    assert registry.jdbc_options(virtuoso)["url"].startswith("jdbc:virtuoso://h:1111/") and registry.jdbc_query({}).startswith("SPARQL SELECT")
    assert "INSERT INTO GRAPH <http://g/1> {" in registry.insert_statements(quads).first().value
    with pytest.raises(FusionError, match="Error 27"):
        registry.write_jdbc(quads, config.Output(config.SourceType.VIRTUOSO, virtuoso.params))


@pytest.fixture
def resolved(spark):
    rows = [quad("http://ex/a", "http://ex/p", "http://ex/b"), quad("http://ex/a", "http://ex/q", '<t> & "u"\nv', kind="literal", lang="en"), quad("http://ex/a", "http://ex/n", "1", kind="literal", dt="http://www.w3.org/2001/XMLSchema#int"), quad("http://ex/a", "http://ex/p", "x" * 200, "http://g/2", "literal")]
    return FusionJob().run(spark.createDataFrame(rows, QUAD))


def test_documents(spark, resolved, tmp_path):
    triples = {(r.s, r.p, r.o, r.o_dt, r.o_lang) for r in resolved.collect()}
    prefixes = {"ex": "http://ex/", "": "http://none/"}
    parsed = lambda rows: {(r[0], r[2], r[3], r[5], r[6]) for r in rows}
    trig = sinks.write_document(resolved, f"{tmp_path}/o.trig", "trig", "urn:meta", prefixes=prefixes)
    text = open(trig[0]).read()
    assert text.startswith("@prefix ex: <http://ex/> .\n") and "ex:a ex:p ex:b ." in text
    rows = TurtleParser(text).parse()
    assert parsed(r for r in rows if r[7] != "urn:meta") == triples and len([r for r in rows if r[7] == "urn:meta"]) == 8
    one = TurtleParser(open(sinks.write_document(resolved, f"{tmp_path}/d.trig", "trig", "urn:meta", "urn:data")[0]).read()).parse()
    assert {r[7] for r in one} == {"urn:data"} and parsed(one) == triples
    rdf_xml = open(sinks.write_document(resolved, f"{tmp_path}/o.rdf", "rdf/xml", prefixes=prefixes)[0]).read()
    assert parsed(parse_rdf_xml(rdf_xml)) == triples and 'xmlns:ex="http://ex/"' in rdf_xml
    html = open(sinks.write_document(resolved, f"{tmp_path}/o.html", "html", prefixes=prefixes)[0]).read()
    assert html.startswith("<!DOCTYPE html>") and html.rstrip().endswith("</html>") and html.count("<tr>") == 5 and "&lt;t&gt; &amp;" in html and "x" * 111 not in html and "<td>ex:a</td>" in html
    lines = open(sinks.write_document(resolved, f"{tmp_path}/o.nt", "ntriples")[0]).read().splitlines()
    assert parsed(map(tuple, rdf.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), mode="FAILFAST").collect())) == triples
    with pytest.raises(ValueError, match="unknown output format"):
        sinks.write_document(resolved, "x", "odd")


def test_split_files(spark, tmp_path):
    lines = spark.range(0, 1000, 1, 7).select(F.format_string("line %05d %s", "id", F.lit("é" * 5)).alias("value"))
    names = sinks.write_single(lines, f"{tmp_path}/out.txt", "head\n", "foot\n", split_bytes=3000)
    assert names == [f"{tmp_path}/out-{i}.txt" for i in range(1, len(names) + 1)] and len(names) == 8
    kept = []
    for name in names:
        text = open(name, "rb").read()
        assert text.startswith(b"head\n") and text.endswith(b"foot\n")
        body = text[5:-5]
        assert len(body) - len(body.splitlines()[-1]) - 1 < 3000
        kept += body.decode().splitlines()
    assert sorted(kept) == [f"line {i:05d} {'é' * 5}" for i in range(1000)]
    assert sinks.write_single(lines.where("false"), f"{tmp_path}/none", "h\n", "", 10) == [f"{tmp_path}/none-1"]
    assert open(f"{tmp_path}/none-1").read() == "h\n" and sinks.split_name("a/b.c.nq", 2) == "a/b.c-2.nq"


def test_tuples_written(spark):
    lines = spark.createDataFrame([('<a> _:b "c\\"d" <d> .',)], "value string")
    assert sinks.tuple_lines(rdf.parse_tuples(lines)).first().value == lines.first().value


def test_command_line(spark, tmp_path, capsys):
    data = '<http://ex/a1> <http://ex/v> "1" <http://g/1> .\n<http://ex/a2> <http://ex/v> "3" <http://g/2> .\n<http://ex/z> <http://ex/v> "5" <http://g/2> .\n'
    (tmp_path / "in.nq.gz").write_bytes(gzip.compress(data.encode()))
    (tmp_path / "same.nt").write_text("<http://ex/a1> <http://www.w3.org/2002/07/owl#sameAs> <http://ex/a2> .\n<http://ex/a1> <http://ex/odd> <http://ex/z> .\n")
    (tmp_path / "meta.nt").write_text('<http://g/1> <http://m/score> "1.0" .\n<http://g/2> <http://m/score> "0.5" .\n<http://g/2> <http://m/publishedBy> <http://who> .\n<http://who> <http://m/publisherScore> "1.0" .\n')
    (tmp_path / "canon.txt").write_text("http://ex/a2\n")
    same = f'<SameAsSource type="file"><ConstructQuery>x</ConstructQuery><Param name="path" value="{tmp_path}/same.nt"/></SameAsSource><MetadataSource type="file"><ConstructQuery>x</ConstructQuery><Param name="path" value="{tmp_path}/meta.nt"/></MetadataSource>'
    out = f'<Output type="file"><Param name="path" value="{tmp_path}/out.trig"/><Param name="format" value="trig"/><Param name="metadataContext" value="urn:meta"/><Param name="sameAsFile" value="{tmp_path}/links.nt"/></Output><Output type="file"><Param name="path" value="{tmp_path}/out.nt"/><Param name="format" value="ntriples"/></Output>'
    more = f'<DataProcessing><Param name="canonicalUriInputFile" value="{tmp_path}/canon.txt"/><Param name="canonicalUriOutputFile" value="{tmp_path}/names.txt"/></DataProcessing><ConflictResolution><DefaultStrategy function="AVG"/></ConflictResolution>'
    (tmp_path / "c.xml").write_text(xml(FILE.format(tmp_path / "in.nq.gz") + same, out, more))
    assert cli.main(["--profile", str(tmp_path / "c.xml")]) == 0
    said = capsys.readouterr().out
    assert "2 statements fused" in said and "Conflict resolution:" in said
    rows = TurtleParser((tmp_path / "out.trig").read_text()).parse()
    data = {(r[0], r[2], r[3]) for r in rows if r[7] != "urn:meta"}
    assert data == {("http://ex/a2", "http://ex/v", "2.0"), ("http://ex/z", "http://ex/v", "5.0")}
    quality = sorted(float(r[3]) for r in rows if r[2] == sinks.QUALITY)
    assert quality == pytest.approx([0.6, 0.8])
    links = TurtleParser((tmp_path / "links.nt").read_text()).parse()  # in the output's own format
    assert [r[:4] for r in links] == [("http://ex/a1", "iri", "http://www.w3.org/2002/07/owl#sameAs", "http://ex/a2")]
    assert (tmp_path / "names.txt").read_text() == "http://ex/a2\n"
    assert cli.main(["--only-mapped", str(tmp_path / "c.xml")]) == 0
    assert len((tmp_path / "out.nt").read_text().splitlines()) == 1
    assert cli.main([]) == 1 and cli.main([str(tmp_path / "none.xml")]) == 1
    (tmp_path / "in.nq.gz").write_bytes(gzip.compress(b"bad line\n"))
    assert cli.main([str(tmp_path / "c.xml")]) == int(Code.LOADING)


def test_metadata_scores_and_function(spark):
    said = [("g1", "http://m/score", "0.9"), ("g2", "http://m/publishedBy", "w"), ("w", "http://m/publisherScore", "0.4"), ("g3", "http://m/score", "bad"), ("g1", "http://m/when", "2020-01-01"), ("g2", "http://m/when", "2021-01-01")]
    meta = spark.createDataFrame([(s, "iri", p, o, "literal", None, None, None) for s, p, o in said], QUAD)
    assert {r.g: r.score for r in Q.metadata_scores(meta).collect()} == {"g1": 0.9, "g2": 0.4}
    quads = spark.createDataFrame([quad("s", "p", "old", "g1"), quad("s", "p", "new", "g2"), quad("s", "p", "none", "g9")], QUAD)
    job = FusionJob(Policy(Strategy("MAX_SOURCE_METADATA", params={"property": "http://m/when"})), metadata=meta)
    assert [r.o for r in job.run(quads).collect()] == ["new"]


def test_dates_are_near(spark):
    d = spark.createDataFrame([("2020-01-01", "2020-07-02"), ("2020-01-01", "2030-01-01"), ("2020-01-01", "text")], "a string, b string")
    got = [r[0] for r in d.select(Q.distance(F.col("a"), F.lit("literal"), F.col("b"), F.lit("literal"))).collect()]
    assert got[0] == pytest.approx(183 / 366) and got[1] == 1.0 and 0 < got[2] <= 1


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from quadweave import session

    class Context:
        master, applicationId = "spark://h:7077", "a"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session())
