"""FILTER expressions as native columns.

An expression is a nested tuple ``(operator, operand, ...)``; leaves are ``Var`` and ``Const``. SPARQL's errors are nulls,
which three-valued SQL logic carries as SPARQL's does. Values have a static type: ``int``, ``dec`` and ``num`` (double),
``bool``, ``str``, ``time``, or ``term`` for encoded terms, whose type is decided row by row. Integers and decimals are
compared and computed exactly (up to 38 digits, ten of them behind the point); where a double takes part, or the type of a
term is not known before it is read, arithmetic is in doubles. Functions of strings keep the language of their argument.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, IntegralType, NumericType, TimestampNTZType, TimestampType

from ..plans.algebra import Const, IncompatibleQueryError, Var
from . import terms as T


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column


def typed(col: Column, kind: DataType | None) -> Value:
    """A column of a typed relation; strings of term relations are passed with kind None."""
    if kind is None:
        return Value("term", col)
    if isinstance(kind, BooleanType):
        return Value("bool", col)
    if isinstance(kind, IntegralType):
        return Value("int", col)
    if isinstance(kind, NumericType):
        return Value("dec" if isinstance(kind, DecimalType) else "num", col)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return Value("time", col.cast("timestamp"))
    return Value("str", col)


NUMBERS = ("int", "dec", "num")
#: Exact literals of terms; longer ones are compared as doubles.
EXACT = [t for t in T.NUMERIC if t not in (T.DOUBLE, T.XSD + "float")]
_EXACT_TYPE = "decimal(38,10)"


def exact(v: Value) -> Column:
    """The value of an integer or decimal, null for others."""
    if v.kind in ("int", "dec"):
        return v.col.try_cast(_EXACT_TYPE)
    if v.kind == "term":
        return F.when(T.datatype(v.col).isin(EXACT), T.lexical(v.col).try_cast(_EXACT_TYPE))
    return F.lit(None).cast(_EXACT_TYPE)


def number(v: Value) -> Column:
    if v.kind in NUMBERS:
        return v.col.cast("double") if v.kind != "num" else v.col
    if v.kind == "term":
        return F.when(T.datatype(v.col).isin(T.NUMERIC), T.lexical(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def moment(v: Value) -> Column:
    if v.kind == "time":
        return v.col
    if v.kind == "term":
        return F.when(T.datatype(v.col) == T.DATE_TIME, T.lexical(v.col).try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def truth_literal(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "term":
        return F.when(T.datatype(v.col) == T.BOOLEAN, T.lexical(v.col).try_cast("boolean"))
    return F.lit(None).cast("boolean")


def string(v: Value) -> Column:
    """String literals only: plain, xsd:string or with a language."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when(T.datatype(v.col).isin(T.STRING, T.LANG_STRING), T.lexical(v.col))
    return F.lit(None).cast("string")


def written(v: Value) -> Column:
    """STR(): the lexical form of a literal or the IRI; an error for blank nodes."""
    if v.kind == "term":
        return F.when(~T.is_blank(v.col), T.lexical(v.col))
    if v.kind == "time":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    if v.kind == "dec":
        # Canonical: no zeros at the end of the fraction.
        return F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return v.col.cast("string")


def like(v: Value, text: Column) -> Value:
    """``text`` as a string of the same type and language as the string ``v``."""
    if v.kind != "term":
        return Value("str", text)
    known = string(v).isNotNull()
    return Value("term", F.when(known, F.concat(F.lit("L"), T.datatype(v.col), F.lit(T.CUT), T.language(v.col), F.lit(T.CUT), text)))


def effective(v: Value) -> Column:
    """Effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in ("int", "dec"):
        return v.col != 0
    if v.kind == "num":
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return v.col != ""
    if v.kind == "term":
        n = number(v)
        return F.coalesce(truth_literal(v), (n != 0) & ~F.isnan(n), string(v) != "")
    return F.lit(None).cast("boolean")


def term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    kind = {"int": T.INTEGER, "dec": T.DECIMAL, "num": T.DOUBLE, "bool": T.BOOLEAN, "str": T.STRING, "time": T.DATE_TIME}[v.kind]
    return T.literal_column(written(v), kind)


def _compare(op: str, a: Value, b: Value) -> Column:
    apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "term" not in (a.kind, b.kind):
        return apply(a.col, b.col) if a.kind == b.kind or {a.kind, b.kind} <= set(NUMBERS) else F.lit(None).cast("boolean")
    by_type = [apply(f(a), f(b)) for f in (exact, number, moment, truth_literal)]
    if op in ("=", "!="):
        same = term(a) == term(b)
        # Different literals of which one has an unknown datatype cannot be told apart by value.
        known = [T.STRING, T.LANG_STRING, T.BOOLEAN, T.DATE_TIME, *T.NUMERIC]
        foreign = ~F.coalesce(T.datatype(term(a)), F.lit(T.STRING)).isin(known) | ~F.coalesce(T.datatype(term(b)), F.lit(T.STRING)).isin(known)
        unsure = T.is_literal(term(a)) & T.is_literal(term(b)) & foreign & ~same
        return F.coalesce(*by_type, F.when(unsure, F.lit(None).cast("boolean")).otherwise(same if op == "=" else ~same))
    return F.coalesce(*by_type, apply(string(a), string(b)))


def _field(pattern: str) -> Callable[[Value], Value]:
    """A field of a dateTime as it is written, in the literal's own offset."""
    def get(v: Value) -> Value:
        text = F.when(moment(v).isNotNull(), written(v))
        return Value("dec" if "\\." in pattern else "int", F.regexp_extract(text, pattern, 1).try_cast("decimal(20,9)" if "\\." in pattern else "long"))

    return get


_DATE, _TIME = r"^-?\d{4,}-\d{2}-\d{2}T", r"(?:Z|[+-]\d{2}:\d{2})?$"


def _zone(v: Value) -> Column:
    return F.regexp_extract(F.when(moment(v).isNotNull(), written(v)), r"(Z|[+-]\d{2}:\d{2})$", 1)


def _timezone(v: Value) -> Value:
    z = _zone(v)
    hours, minutes = (F.regexp_extract(z, p, 1).try_cast("int") for p in (r"^[+-](\d{2})", r":(\d{2})$"))
    sign = F.when(z.startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    duration = F.when((z == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").when(z != "", text)
    return Value("term", T.literal_column(duration, T.XSD + "dayTimeDuration"))


def _flags(pattern: Column, flags: str) -> Column:
    if not set(flags) <= set("ismxq"):
        raise IncompatibleQueryError(f"flags {flags!r} of a regular expression")
    return F.concat(F.lit(f"(?{flags})"), pattern) if flags else pattern


def _constant(v: object) -> str:
    if isinstance(v, Const) and isinstance(v.value, str):
        return T.parts(v.value)[1] if v.value[:1] == "L" and T.CUT in v.value else v.value
    raise IncompatibleQueryError("the flags of a regular expression must be constant")


def _before(s: Column, part: Column) -> Column:
    at = F.call_function("locate", part, s)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise("")


def _after(s: Column, part: Column) -> Column:
    at = F.call_function("locate", part, s)
    return F.when(at > 0, F.substr(s, at + F.char_length(part))).otherwise("")


def _url(s: Column) -> Column:
    # url_encode writes a blank as +, keeps * and escapes ~; SPARQL escapes all but letters, digits and -_.~
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _cast(kind: str, v: Value) -> Value:
    text = written(v)
    if kind == T.STRING:
        return Value("str", text)
    if kind == T.BOOLEAN:
        by_number = number(v) != 0
        return Value("bool", F.coalesce(truth_literal(v), by_number, string(v).try_cast("boolean")))
    if kind == T.DATE_TIME:
        return Value("term", F.when(text.try_cast("timestamp").isNotNull(), T.literal_column(text, T.DATE_TIME)))
    n = F.coalesce(number(v), truth_literal(v).cast("double"), string(v).try_cast("double"))
    if kind not in (T.INTEGER, T.DECIMAL):
        return Value("num", n)
    plain = F.when(string(v).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$" if kind == T.DECIMAL else r"^\s*[+-]?\d+\s*$"), F.trim(string(v))).try_cast(_EXACT_TYPE)
    whole = F.coalesce(exact(v), F.when(string(v).isNull(), n).try_cast(_EXACT_TYPE), plain)
    if kind == T.DECIMAL:
        return Value("dec", whole)
    return Value("int", F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).try_cast("decimal(38,0)"))


def _hash(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value("str", f(F.encode(string(v), "UTF-8")))


def _text(f: Callable[..., Column]) -> Callable[..., Value]:
    """A function of strings; the result is a string like the first."""
    return lambda *vs: like(vs[0], f(*map(string, vs)))


def _part(f: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    """STRBEFORE and STRAFTER: like the first string if the second is in it, else the plain empty string."""
    def get(v: Value, part: Value) -> Value:
        s, p = string(v), string(part)
        found = like(v, f(s, p))
        if found.kind == "str":
            return found
        return Value("term", F.when(F.contains(s, p), found.col).when(~F.contains(s, p), F.lit(T.literal(""))))

    return get


def _concat(*vs: Value) -> Value:
    """With the language that all arguments share, else a plain string."""
    text = F.concat(*map(string, vs)) if vs else F.lit("")
    if any(v.kind == "str" for v in vs) or not vs:
        return Value("str", text)
    tags = [_language(v) for v in vs]
    same = F.lit(True)
    for t in tags[1:]:
        same = same & (t == tags[0])
    return Value("term", F.when(same & (tags[0] != ""), like(vs[0], text).col).otherwise(T.literal_column(text)))


def _num(f: Callable[..., Column]) -> Callable[..., Value]:
    """A function of a number that keeps its type."""
    return lambda v: Value(v.kind, f(v.col)) if v.kind in ("int", "dec") else Value("num", f(number(v)))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    """By XPath's promotion: integers stay so but for division, a decimal makes decimals, a double doubles."""
    if {a.kind, b.kind} <= {"int", "dec"}:
        wide = lambda v: v.col.cast("decimal(38,0)" if v.kind == "int" else _EXACT_TYPE)
        x, y = wide(a), wide(b)
        kind = "int" if a.kind == b.kind == "int" and op != "/" else "dec"
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x, y)
        return Value(kind, made.try_cast("decimal(38,0)" if kind == "int" else "decimal(38,10)"))
    x, y = number(a), number(b)
    return Value("num", {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op])


def _kind(test: Callable[[Column], Column], native: bool) -> Callable[[Value], Value]:
    return lambda v: Value("bool", test(v.col) if v.kind == "term" else F.when(v.col.isNotNull(), F.lit(native)))


def _language(v: Value) -> Column:
    return T.language(v.col) if v.kind == "term" else F.when(v.col.isNotNull(), F.lit(""))


def _lang_matches(tag: Value, wanted: Value) -> Value:
    a, b = F.lower(string(tag)), F.lower(string(wanted))
    return Value("bool", F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "ISIRI": _kind(T.is_iri, False), "ISURI": _kind(T.is_iri, False), "ISBLANK": _kind(T.is_blank, False), "ISLITERAL": _kind(T.is_literal, True),
    "ISNUMERIC": lambda v: Value("bool", F.when(v.col.isNotNull(), number(v).isNotNull())),
    "SAMETERM": lambda a, b: Value("bool", term(a) == term(b)),
    "STR": lambda v: Value("str", written(v)), "LANG": lambda v: Value("str", _language(v)),
    "DATATYPE": lambda v: Value("term", T.iri_column(T.datatype(term(v)))),
    "IRI": lambda v: Value("term", T.iri_column(written(v))), "URI": lambda v: Value("term", T.iri_column(written(v))),
    "BNODE": lambda *v: Value("term", F.concat(F.lit("B"), string(v[0]) if v else F.uuid())),
    "STRDT": lambda s, d: Value("term", F.concat(F.lit("L"), F.substr(term(d), F.lit(2)), F.lit(T.CUT + T.CUT), string(s))),
    "STRLANG": lambda s, t: Value("term", F.concat(F.lit(f"L{T.LANG_STRING}{T.CUT}"), F.lower(string(t)), F.lit(T.CUT), string(s))),
    "UUID": lambda: Value("term", F.concat(F.lit("Uurn:uuid:"), F.uuid())), "STRUUID": lambda: Value("str", F.uuid()),
    "STRLEN": lambda s: Value("int", F.char_length(string(s))),
    "SUBSTR": lambda s, at, *n: like(s, F.substr(string(s), number(at).cast("int"), *[number(x).cast("int") for x in n])),
    "UCASE": _text(F.upper), "LCASE": _text(F.lower), "CONCAT": _concat, "ENCODE_FOR_URI": lambda s: Value("str", _url(string(s))),
    "STRSTARTS": lambda s, p: Value("bool", F.startswith(string(s), string(p))), "STRENDS": lambda s, p: Value("bool", F.endswith(string(s), string(p))),
    "CONTAINS": lambda s, p: Value("bool", F.contains(string(s), string(p))), "STRBEFORE": _part(_before), "STRAFTER": _part(_after),
    "LANGMATCHES": _lang_matches,
    "ABS": _num(F.abs), "CEIL": _num(F.ceil), "FLOOR": _num(F.floor), "ROUND": _num(lambda x: F.floor(x + F.lit(Decimal("0.5")))), "RAND": lambda: Value("num", F.rand()),
    "NOW": lambda: Value("time", F.current_timestamp()),
    "YEAR": _field(r"^(-?\d{4,})-"), "MONTH": _field(r"^-?\d{4,}-(\d{2})-"), "DAY": _field(r"^-?\d{4,}-\d{2}-(\d{2})T"),
    "HOURS": _field(_DATE + r"(\d{2}):"), "MINUTES": _field(_DATE + r"\d{2}:(\d{2}):"), "SECONDS": _field(_DATE + r"\d{2}:\d{2}:(\d{2}(?:\.\d+)?)" + _TIME),
    "TIMEZONE": _timezone, "TZ": lambda v: Value("str", _zone(v)),
    "MD5": _hash(F.md5), "SHA1": _hash(F.sha1), "SHA256": _hash(lambda c: F.sha2(c, 256)), "SHA384": _hash(lambda c: F.sha2(c, 384)), "SHA512": _hash(lambda c: F.sha2(c, 512)),
}
CASTS = {T.STRING, T.BOOLEAN, T.DATE_TIME, T.INTEGER, T.DECIMAL, T.DOUBLE, T.XSD + "float"}
#: Least and most numbers of arguments where they are not those of the function itself.
ARITY = {"BNODE": (0, 1), "SUBSTR": (2, 3), "CONCAT": (0, 99), "REGEX": (2, 3), "REPLACE": (3, 4), "COALESCE": (1, 99), "IF": (3, 3), "BOUND": (1, 1)}


def evaluate(expr: object, binding: Callable[[str], Value]) -> Value:
    """The value of an expression; ``binding`` gives the column of a variable."""
    if isinstance(expr, Var):
        return binding(expr.name)
    if isinstance(expr, Const):
        v = expr.value
        if isinstance(v, bool):
            return Value("bool", F.lit(v))
        if isinstance(v, (int, float, Decimal)):
            return Value({int: "int", float: "num"}.get(type(v), "dec"), F.lit(v))
        kind, text, datatype, _ = T.parts(v)
        if datatype == T.STRING:
            return Value("str", F.lit(text))
        if datatype in T.NUMERIC and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
            if datatype in EXACT and len(text) <= 27:
                whole = "." not in text
                short = whole and abs(int(text)) < 1 << 63
                return Value("int" if whole else "dec", F.lit(int(text) if short else Decimal(text)))
            return Value("num", F.lit(float(text)))
        return Value("term", F.lit(v))
    op, *args = expr
    value = lambda e: evaluate(e, binding)
    if op in ("&&", "||"):
        a, b = (effective(value(e)) for e in args)
        return Value("bool", a & b if op == "&&" else a | b)
    if op == "!":
        return Value("bool", ~effective(value(args[0])))
    if op in ("=", "!=", "<", ">", "<=", ">="):
        return Value("bool", _compare(op, value(args[0]), value(args[1])))
    if op in ("IN", "NOT IN"):
        found, own = F.lit(False), value(args[0])
        for e in args[1:]:
            found = found | _compare("=", own, value(e))
        return Value("bool", found if op == "IN" else ~found)
    if op in ("+", "-", "*", "/") and len(args) == 2:
        return _arithmetic(op, *map(value, args))
    if op in ("u-", "u+"):
        return _num(lambda x: -x if op == "u-" else x)(value(args[0]))
    if op == "BOUND":
        return Value("bool", value(args[0]).col.isNotNull())
    if op == "IF":
        a, b = value(args[1]), value(args[2])
        same = a.kind == b.kind
        made = F.when(effective(value(args[0])), a.col if same else term(a)).when(~effective(value(args[0])), b.col if same else term(b))
        return Value(a.kind if same else "term", made)
    if op == "COALESCE":
        vs = [value(e) for e in args]
        same = len({v.kind for v in vs}) == 1
        return Value(vs[0].kind if same else "term", F.coalesce(*[v.col if same else term(v) for v in vs]))
    if op == "REGEX":
        return Value("bool", F.rlike(string(value(args[0])), _flags(string(value(args[1])), _constant(args[2]) if len(args) > 2 else "")))
    if op == "REPLACE":
        own = value(args[0])
        return like(own, F.regexp_replace(string(own), _flags(string(value(args[1])), _constant(args[3]) if len(args) > 3 else ""), string(value(args[2]))))
    if op in CASTS:
        return _cast(op, value(args[0]))
    if op not in FUNCTIONS:
        raise IncompatibleQueryError(f"function {op}")
    return FUNCTIONS[op](*map(value, args))


def condition(expr: object, binding: Callable[[str], Value]) -> Column:
    """Rows to keep: an error counts as false."""
    return F.coalesce(effective(evaluate(expr, binding)), F.lit(False))
