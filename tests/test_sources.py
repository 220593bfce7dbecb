"""Readers and writers on small files."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.sources import arrays, text, xml

NT = r'''# a comment
<http://e/s> <http://e/p> <http://e/o> .
<http://e/s>	<http://e/p>	"plain" .
<http://e/s> <http://e/p> "café \"x\""@en .
_:b1 <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> . # end
not a triple
'''
HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://e">'
OWL = (
    HEAD
    + """<owl:Ontology rdf:about=""/>
<owl:Class rdf:ID="A"><rdfs:label>a</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:someValuesFrom rdf:resource="#B"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:ID="B"><owl:intersectionOf rdf:parseType="Collection"><owl:Class rdf:about="#C"/><owl:Class rdf:about="#D"/></owl:intersectionOf></owl:Class>
<owl:Class rdf:ID="N"><rdfs:subClassOf><owl:Class rdf:ID="Inner"><rdfs:label>i</rdfs:label></owl:Class></rdfs:subClassOf><rdfs:label>n</rdfs:label></owl:Class>
<owl:ObjectProperty rdf:ID="p"><rdfs:domain rdf:resource="#A"/><rdfs:range rdf:resource="#B"/><owl:inverseOf rdf:resource="#q"/></owl:ObjectProperty>
<owl:DatatypeProperty rdf:ID="d"><rdfs:subPropertyOf rdf:resource="#e"/></owl:DatatypeProperty></rdf:RDF>"""
)


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text(NT)
    rows = text.read_ntriples(spark, str(tmp_path / "a.nt")).collect()
    assert [(r.object_kind, r.object_value, r.lang, r.datatype) for r in rows] == [
        ("iri", "http://e/o", None, None), ("literal", "plain", None, None), ("literal", 'café "x"', "en", None),
        ("literal", "1", None, "http://www.w3.org/2001/XMLSchema#integer"),
    ]
    assert rows[3].subject == "_:b1"


def test_ntriples_roundtrip(spark):
    rows = [("http://e/s", "http://e/p", v) for v in ("http://e/o", 'a "b" \\ c\t\n', "", "x y", "\\n")]
    back = text.parse_ntriples(text.format_ntriples(spark.createDataFrame(rows, "subject string, predicate string, object string")), "value")
    assert sorted((r.subject, r.predicate, r.object_value) for r in back.collect()) == sorted(rows)


def test_delimited(spark, tmp_path):
    path = str(tmp_path / "d")
    text.write_tsv(spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long"), path)
    text.write_tsv(spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long"), path)
    d = text.read_dictionary(spark, path)
    assert sorted(map(tuple, d.collect())) == [("a", 1), ("b", 2)]
    assert json.loads(text.dictionary_json(d).first().json) == {"a": 1, "b": 2}
    (tmp_path / "t.txt").write_text("h\tt\tr\n")
    assert tuple(text.read_delimited_triples(spark, str(tmp_path / "t.txt")).first()) == ("h", "r", "t")
    text.write_json_dictionary(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_owl(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    whole = xml.read_owl(spark, str(tmp_path / "o.owl"))
    assert sorted(r.kind for r in whole.collect()) == ["Class", "Class", "Class", "DatatypeProperty", "ObjectProperty"]
    cut = xml.read_owl(spark, str(tmp_path / "o.owl"), compat="streamxml").where("kind = 'Class'").collect()
    assert any(r.fragment.count("<owl:Class") == 2 and r.fragment.count("</owl:Class>") == 1 for r in cut)
    with pytest.raises(ValueError):
        xml.read_owl(spark, "x", "turtle")
    found = {(r.axiom_type, r.subject, r.object) for r in xml.axioms(whole, xml.prefix_tag(OWL)).collect()}
    assert ("SubClassOf", "http://e#A", "some(http://e#p, http://e#B)") in found
    assert ("EquivalentClasses", "http://e#B", "and(http://e#C, http://e#D)") in found
    assert {("Domain", "http://e#p", "http://e#A"), ("Range", "http://e#p", "http://e#B"), ("InverseOf", "http://e#p", "http://e#q"), ("SubPropertyOf", "http://e#d", "http://e#e")} <= found
    assert xml.axioms_of("<broken", "") is None
    assert xml.axioms(spark.createDataFrame([("<broken",)], "fragment string")).count() == 0


def test_rdfxml(spark, tmp_path):
    doc = HEAD + '<rdf:Description rdf:about="http://e/x" rdfs:label="lab"><rdfs:comment xml:lang="en">hi</rdfs:comment><rdfs:seeAlso rdf:resource="http://e/y"/></rdf:Description></rdf:RDF>'
    (tmp_path / "a.rdf").write_text(doc)
    rows = {(r.predicate.rpartition("#")[2], r.object, r.lang) for r in xml.read_rdfxml(spark, str(tmp_path / "a.rdf")).collect()}
    assert rows == {("label", '"lab"', None), ("comment", '"hi"@en', "en"), ("seeAlso", "http://e/y", None)}
    assert xml.read_owl(spark, str(tmp_path / "a.rdf"), compat="streamxml").count() == 0


def test_idx(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "x.gz").write_bytes(gzip.compress(struct.pack(">HBB", 0, 8, 3) + struct.pack(">3I", 2, 3, 4) + a.tobytes()))
    rows = arrays.read_idx(spark, str(tmp_path / "x.gz")).orderBy("idx").collect()
    assert [r["values"] for r in rows] == a.reshape(2, 12).astype(float).tolist()
    with pytest.raises(ValueError):
        arrays.decode_idx(b"\0\0\x09\1")


def test_generated(spark):
    d = arrays.linear_data(spark, 2000, seed=3)
    assert d.collect() == arrays.linear_data(spark, 2000, seed=3).repartition(3).orderBy("x").collect() or d.agg(F.sum("y")).first()[0] == pytest.approx(arrays.linear_data(spark, 2000, seed=3).agg(F.sum("y")).first()[0])
    assert 0.1 < d.select(F.stddev(F.col("y") - F.col("y_true"))).first()[0] < 0.2
    s = arrays.random_swarm(spark, 5, 3, 1)
    assert s.collect() == arrays.random_swarm(spark, 5, 3, 1).collect() and all(0 <= v < 1 for r in s.collect() for v in r.position)
    assert arrays.zip_rows(spark.range(3).withColumnRenamed("id", "idx"), spark.range(3).selectExpr("id AS idx", "id * 2 AS b")).count() == 3
