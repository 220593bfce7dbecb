"""RDF/XML and OWL sources: tag-delimited fragments, nested records, triples and axioms."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import ship

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
KINDS = ("Class", "ObjectProperty", "DatatypeProperty")

TRIPLES = "subject string, predicate string, object string, object_kind string, object_value string, lang string, datatype string"
AXIOMS = "frag_id long, axiom_type string, subject string, property string, object string, extra map<string,string>"


def tag_pattern(tags: tuple[str, ...] = KINDS, prefix: str = "owl:") -> str:
    """From the begin tag to the first end tag of the same name."""
    return rf"(?s)(<{re.escape(prefix)}({'|'.join(tags)})[\s>].*?</{re.escape(prefix)}\2>)"


def fragments(texts: DataFrame, column: str = "value", tags: tuple[str, ...] = KINDS, prefix: str = "owl:") -> DataFrame:
    """(kind, fragment) of tag-delimited records of whole texts: begin tag to first end tag, as record readers of streams do.

    One scan for all tags. Nested records of the same tag are cut early in this mode; ``records`` is nesting-aware.
    """
    found = texts.select(F.explode(F.regexp_extract_all(column, F.lit(tag_pattern(tags, prefix)), F.lit(1))).alias("fragment"))
    return found.select(F.regexp_extract("fragment", rf"^<{re.escape(prefix)}(\w+)", 1).alias("kind"), "fragment")


def _walk(text: str) -> ET.Element | None:
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def _top_level(text: str, tags: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    root = _walk(text)
    for child in root if root is not None else ():
        name = child.tag.rpartition("}")[2]
        if name in tags:
            yield name, ET.tostring(child, encoding="unicode").strip()


def records(files: DataFrame, column: str = "value", tags: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, fragment) of the top-level elements of whole documents, nested ones intact; documents that do not parse give none."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for text in f[column] if text for x in _top_level(text, tags)], columns=["kind", "fragment"])

    return files.select(column).mapInPandas(run, "kind string, fragment string")


def read_owl(spark: SparkSession, path: str, syntax: str = "owlxml", compat: str | None = None, tags: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, fragment) of ontologies. ``compat="streamxml"`` reads begin tag to first end tag instead of whole elements."""
    if syntax != "owlxml":
        raise ValueError(f"unsupported syntax: {syntax}")
    texts = spark.read.text(path, wholetext=True)
    return fragments(texts, tags=tags) if compat == "streamxml" else records(texts, tags=tags)


# --- RDF/XML -> triples ----------------------------------------------------------------------------------------------


def _name(tag: str) -> str:
    return tag[1:].replace("}", "") if tag[0] == "{" else tag


def rdfxml_triples(text: str, base: str = "") -> Iterator[tuple]:
    """Rows of TRIPLES for a document: node and property elements, property attributes, collections and reification-free nesting."""
    root = _walk(text)
    if root is None:
        return
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", base)
    number = [0]

    def blank() -> str:
        number[0] += 1
        return f"_:b{number[0]}"

    def resolve(value: str) -> str:
        return base + value if value.startswith("#") or not value else value

    def subject_of(node: ET.Element) -> str:
        if (v := node.get(f"{{{RDF}}}about")) is not None:
            return resolve(v)
        if (v := node.get(f"{{{RDF}}}ID")) is not None:
            return f"{base}#{v}"
        if (v := node.get(f"{{{RDF}}}nodeID")) is not None:
            return f"_:{v}"
        return blank()

    def resource(s: str, p: str, o: str) -> tuple:
        return s, p, o, "blank" if o.startswith("_:") else "iri", o, None, None

    def literal(s: str, p: str, value: str, lang: str | None, datatype: str | None) -> tuple:
        raw = f'"{value}"' + (f"^^<{datatype}>" if datatype else f"@{lang}" if lang else "")
        return s, p, raw, "literal", value, None if datatype else lang, datatype

    out: list[tuple] = []
    skip = {f"{{{RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype")}

    def node(e: ET.Element, lang: str | None) -> str:
        s = subject_of(e)
        lang = e.get("{http://www.w3.org/XML/1998/namespace}lang", lang)
        if e.tag != f"{{{RDF}}}Description":
            out.append(resource(s, RDF + "type", _name(e.tag)))
        for k, v in e.attrib.items():
            if k not in skip and not k.startswith("{http://www.w3.org/XML/1998/namespace}"):
                out.append(resource(s, _name(k), resolve(v)) if k == f"{{{RDF}}}type" else literal(s, _name(k), v, lang, None))
        for p in e:
            prop(s, p, lang)
        return s

    def prop(s: str, e: ET.Element, lang: str | None) -> None:
        p = _name(e.tag)
        lang = e.get("{http://www.w3.org/XML/1998/namespace}lang", lang)
        if (v := e.get(f"{{{RDF}}}resource")) is not None:
            out.append(resource(s, p, resolve(v)))
        elif (v := e.get(f"{{{RDF}}}nodeID")) is not None:
            out.append(resource(s, p, f"_:{v}"))
        elif e.get(f"{{{RDF}}}parseType") == "Collection":
            head = RDF + "nil"
            for item in reversed([node(x, lang) for x in e]):
                cell = blank()
                out.append(resource(cell, RDF + "first", item))
                out.append(resource(cell, RDF + "rest", head))
                head = cell
            out.append(resource(s, p, head))
        elif e.get(f"{{{RDF}}}parseType") == "Resource":
            b = blank()
            out.append(resource(s, p, b))
            for child in e:
                prop(b, child, lang)
        elif len(e):
            out.append(resource(s, p, node(e[0], lang)))
        else:
            out.append(literal(s, p, e.text or "", lang, e.get(f"{{{RDF}}}datatype")))

    for e in root if root.tag == f"{{{RDF}}}RDF" else [root]:
        node(e, None)
    yield from out


def parse_rdfxml(texts: DataFrame, column: str = "value") -> DataFrame:
    """Triples of whole RDF/XML documents, a document for each row; what does not parse gives none."""
    ship(texts.sparkSession)
    names = [x.split()[0] for x in TRIPLES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([t for text in f[column] if text for t in rdfxml_triples(text)], columns=names)

    return texts.select(column).mapInPandas(run, TRIPLES)


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    return parse_rdfxml(spark.read.text(path, wholetext=True))


# --- OWL fragments -> axioms -----------------------------------------------------------------------------------------

_DECLARED = {OWL + k: k for k in ("Class", "ObjectProperty", "DatatypeProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "SymmetricProperty")}
_SIMPLE = {
    RDFS + "subClassOf": "SubClassOf", RDFS + "domain": "Domain", RDFS + "range": "Range", RDFS + "subPropertyOf": "SubPropertyOf",
    OWL + "inverseOf": "InverseOf", OWL + "disjointWith": "DisjointClasses", OWL + "equivalentClass": "EquivalentClasses",
    OWL + "intersectionOf": "EquivalentClasses", OWL + "unionOf": "EquivalentClasses",
}


def axioms_of(fragment: str, head: str = "") -> list[tuple] | None:
    """(axiom_type, subject, property, object, extra) of a fragment; None when it does not parse.

    ``head`` is the opening rdf:RDF tag with the namespaces that the fragment uses. Class expressions are written out in a
    functional style: and(..), or(..), some(p, c), only(p, c).
    """
    text = f"{head}{fragment}</rdf:RDF>" if head else fragment
    root = _walk(text)
    if root is None:
        return None
    triples = list(rdfxml_triples(text))
    by_subject: dict[str, list[tuple]] = {}
    for t in triples:
        by_subject.setdefault(t[0], []).append(t)

    def members(cell: str) -> list[str]:
        out = []
        while cell != RDF + "nil" and cell in by_subject:
            one = {t[1]: t[2] for t in by_subject[cell]}
            out.append(expression(one.get(RDF + "first", "")))
            cell = one.get(RDF + "rest", RDF + "nil")
        return out

    def expression(term: str) -> str:
        if not term.startswith("_:"):
            return term
        one = {t[1]: t[2] for t in by_subject.get(term, [])}
        for key, word in ((OWL + "intersectionOf", "and"), (OWL + "unionOf", "or")):
            if key in one:
                return f"{word}({', '.join(members(one[key]))})"
        for key, word in ((OWL + "someValuesFrom", "some"), (OWL + "allValuesFrom", "only"), (OWL + "hasValue", "value")):
            if key in one:
                return f"{word}({one.get(OWL + 'onProperty', '')}, {expression(one[key])})"
        return term

    out = []
    for s, p, o, kind, value, lang, datatype in triples:
        if s.startswith("_:"):
            continue
        if p == RDF + "type":
            out.append(("Declaration" if o in _DECLARED else "ClassAssertion", s, None, o, None))
        elif p in (OWL + "intersectionOf", OWL + "unionOf"):
            word = "and" if p.endswith("intersectionOf") else "or"
            out.append(("EquivalentClasses", s, p, f"{word}({', '.join(members(o))})", None))
        elif p in _SIMPLE:
            out.append((_SIMPLE[p], s, p, expression(o), None))
        elif kind == "literal":
            extra = {k: v for k, v in (("lang", lang), ("datatype", datatype)) if v}
            out.append(("AnnotationAssertion", s, p, value, extra or None))
        else:
            out.append(("PropertyAssertion", s, p, expression(o), None))
    return out


def axioms(parts: DataFrame, head: str = "", fragment_col: str = "fragment") -> DataFrame:
    """Rows of AXIOMS for the fragments of a table; fragments that do not parse are dropped."""
    ship(parts.sparkSession)
    numbered = parts.select(F.monotonically_increasing_id().alias("frag_id"), F.col(fragment_col).alias("f"))
    names = [x.split()[0] for x in AXIOMS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, *a) for i, text in zip(f["frag_id"], f["f"]) for a in axioms_of(text, head) or ()], columns=names)

    return numbered.mapInPandas(run, AXIOMS)


def prefix_tag(text: str) -> str:
    """The opening rdf:RDF tag of a document, with its namespaces."""
    found = re.search(r"<rdf:RDF[^>]*>", text)
    return found[0] if found else ""
