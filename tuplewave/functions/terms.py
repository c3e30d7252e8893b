"""RDF terms as one string column each, so that term equality is string equality.

``U`` + IRI, ``B`` + label, or ``L`` + datatype IRI + U+0001 + language + U+0001 + lexical form. A literal without a
datatype is an ``xsd:string``, one with a language an ``rdf:langString``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, LANG_STRING = XSD + "string", RDF + "langString"
BOOLEAN, DATE_TIME, INTEGER, DECIMAL, DOUBLE = (XSD + t for t in ("boolean", "dateTime", "integer", "decimal", "double"))
#: The names of the XML Schema numeric types.
NUMERIC = [XSD + t for t in (
    "integer", "decimal", "float", "double", "byte", "short", "int", "long", "nonNegativeInteger", "nonPositiveInteger",
    "negativeInteger", "positiveInteger", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong",
)]
CUT = "\x01"


def iri(value: str) -> str:
    return "U" + value


def blank_node(label: str) -> str:
    return "B" + label


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    kind = LANG_STRING if lang else datatype or STRING
    return f"L{kind}{CUT}{(lang or '').lower()}{CUT}{lexical}"


def parts(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form or name, datatype, language)."""
    if term[0] != "L":
        return term[0], term[1:], None, None
    datatype, lang, lexical = term[1:].split(CUT, 2)
    return "L", lexical, datatype, lang or None


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def ntriples(term: str) -> str:
    """The term as N-Triples writes it."""
    kind, name, datatype, lang = parts(term)
    if kind == "U":
        return f"<{name}>"
    if kind == "B":
        return f"_:{name}"
    text = '"' + "".join(_ESCAPES.get(c, c) for c in name) + '"'
    return f"{text}@{lang}" if lang else text if datatype == STRING else f"{text}^^<{datatype}>"


# ------------------------------------------------ the same on columns


def is_iri(t: Column) -> Column:
    return t.startswith("U")


def is_blank(t: Column) -> Column:
    return t.startswith("B")


def is_literal(t: Column) -> Column:
    return t.startswith("L")


def datatype(t: Column) -> Column:
    """Null for terms that are not literals."""
    return F.when(is_literal(t), F.split_part(F.substr(t, F.lit(2)), F.lit(CUT), F.lit(1)))


def language(t: Column) -> Column:
    """The empty string for literals without one, null for other terms."""
    return F.when(is_literal(t), F.split_part(t, F.lit(CUT), F.lit(2)))


def lexical(t: Column) -> Column:
    """The lexical form of a literal, else the IRI or label."""
    first = F.locate(CUT, t)
    second = F.call_function("locate", F.lit(CUT), t, first + 1)
    return F.when(is_literal(t), F.substr(t, second + 1)).otherwise(F.substr(t, F.lit(2)))


def literal_column(text: Column, kind: str = STRING) -> Column:
    return F.concat(F.lit(f"L{kind}{CUT}{CUT}"), text.cast("string"))


def iri_column(text: Column) -> Column:
    return F.concat(F.lit("U"), text)
