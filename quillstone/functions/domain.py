"""Codecs of scientific types: units, quantities, uncertain numbers, references, formulas, reactions, sequences, ontology terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.cluster import ship
from quillstone.functions.codecs import Codec, FloatCodec, IntegerCodec, StringCodec

#: unit -> (scale to the base units, exponents of metre, gram, second, ampere, kelvin, mole, candela). Prefixes are applied to those marked.
_BASE = {
    "m": (1.0, "m"), "g": (1.0, "g"), "s": (1.0, "s"), "A": (1.0, "A"), "K": (1.0, "K"), "mol": (1.0, "mol"), "cd": (1.0, "cd"),
    "l": (1e-3, "m3"), "L": (1e-3, "m3"), "M": (1e3, "mol m-3"), "Hz": (1.0, "s-1"), "N": (1e3, "g m s-2"), "J": (1e3, "g m2 s-2"), "W": (1e3, "g m2 s-3"),
    "Pa": (1e3, "g m-1 s-2"), "V": (1e3, "g m2 s-3 A-1"), "C": (1.0, "A s"), "Da": (1.66053906660e-24, "g"), "cal": (4184.0, "g m2 s-2"),
}
_PLAIN = {"min": (60.0, "s"), "h": (3600.0, "s"), "hr": (3600.0, "s"), "d": (86400.0, "s"), "day": (86400.0, "s"), "molecule": (1 / 6.02214076e23, "mol"), "dimensionless": (1.0, ""), "1": (1.0, ""), "percent": (0.01, "")}
_LONG = {"metre": "m", "meter": "m", "gram": "g", "second": "s", "ampere": "A", "kelvin": "K", "mole": "mol", "candela": "cd", "liter": "l", "litre": "l", "molar": "M", "hertz": "Hz", "newton": "N", "joule": "J", "watt": "W", "pascal": "Pa", "volt": "V", "coulomb": "C", "dalton": "Da", "calorie": "cal", "minute": "min", "hour": "h"}
_PREFIX = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "femto": 1e-15, "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3, "mega": 1e6, "giga": 1e9}


def unit_table() -> dict[str, tuple[float, str]]:
    """Every unit that is known by name, with its scale and dimension text."""
    out = dict(_BASE) | _PLAIN
    for long, short in _LONG.items():
        out[long] = out[short]
    for name in [*_BASE, *_LONG]:
        for p, scale in _PREFIX.items():
            if (len(p) > 2) == (name in _LONG):
                out.setdefault(p + name, (out[name][0] * scale, out[name][1]))
    return out


def dimensions(text: str) -> dict[str, int]:
    import re

    out: dict[str, int] = {}
    for word in text.split():
        m = re.fullmatch(r"([A-Za-z]+)(-?\d+)?", word)
        out[m[1]] = out.get(m[1], 0) + int(m[2] or 1)
    return out


UNITS = unit_table()


def parse_unit(text: str | None) -> tuple[float, str] | None:
    """(scale, canonical dimensions) of a product or quotient of powers such as `mmol / l / s` or `g m^-3`; None where a unit isn't known."""
    import re

    if text is None or not text.strip():
        return None
    scale, dims, sign = 1.0, {}, 1
    for token in re.findall(r"[*/]|\^|[^\s*/^]+", text.replace("**", "^")):
        if token == "*":
            sign = 1
        elif token == "/":
            sign = -1
        elif token == "^":
            continue
        elif re.fullmatch(r"-?\d+", token) and token != "1" and dims is not None and "last" in dims:
            s, d, was = dims["last"]
            power = int(token) - 1
            scale *= s ** (was * power)
            for k, n in d.items():
                dims[k] = dims.get(k, 0) + was * n * power
        else:
            if token not in UNITS:
                return None
            s, d = UNITS[token][0], dimensions(UNITS[token][1])
            scale *= s**sign
            for k, n in d.items():
                dims[k] = dims.get(k, 0) + sign * n
            dims["last"] = (s, d, sign)
            sign = 1
    dims.pop("last", None)
    return scale, " ".join(f"{k}{n}" for k, n in sorted(dims.items()) if n)


def _units(texts: Column) -> Column:
    """Parsed units, each distinct text of a batch once; null where a unit isn't known."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)

    @F.pandas_udf(StructType().add("text", "string").add("scale", "double").add("dims", "string"))
    def parsed(s):
        import pandas as pd

        known = {t: parse_unit(t) for t in s.dropna().unique()}
        rows = [(t, *known[t]) if isinstance(t, str) and known.get(t) else (None, None, None) for t in s]
        return pd.DataFrame(rows, columns=["text", "scale", "dims"])

    return parsed(texts)


@dataclass
class UnitCodec(Codec):
    """A unit of known names, products and powers. choices: those that are allowed, by dimension."""

    choices: list = field(default_factory=list)
    spark_type = "struct<text:string,scale:double,dims:string>"

    def parse(self, c):
        got = _units(F.trim(c.cast("string")))
        return F.when(got["scale"].isNotNull(), got)

    def checks(self, c):
        out = super().checks(c)
        if self.choices:
            out.append(("unit isn't compatible with the choices", c.isNotNull() & ~c["dims"].isin([parse_unit(x)[1] for x in self.choices])))
        return out

    def serialize(self, c):
        return F.coalesce(c["text"], F.lit(""))

    def equal(self, a, b, tol=0.0):
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a["dims"] == b["dims"]) & (a["scale"] == b["scale"]))


@dataclass
class QuantityCodec(UnitCodec):
    """A number and a unit. Zero is a quantity like any other."""

    spark_type = "struct<magnitude:double,unit:struct<text:string,scale:double,dims:string>>"
    _SPLIT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(.*?)\s*$"

    def parse(self, c):
        s = c.cast("string")
        n = F.regexp_extract(s, self._SPLIT, 1).try_cast("double")
        name = F.regexp_extract(s, self._SPLIT, 2)
        unit = _units(F.when(name == "", "dimensionless").otherwise(name))
        return F.when(n.isNotNull() & unit["scale"].isNotNull(), F.struct(n.alias("magnitude"), unit.alias("unit")))

    def checks(self, c):
        out = Codec.checks(self, c)
        if self.choices:
            out.append(("unit isn't compatible with the choices", c.isNotNull() & ~c["unit"]["dims"].isin([parse_unit(x)[1] for x in self.choices])))
        return out

    def serialize(self, c):
        return F.coalesce(F.concat_ws(" ", c["magnitude"].cast("string"), c["unit"]["text"]), F.lit(""))

    def equal(self, a, b, tol=1e-12):
        x, y = a["magnitude"] * a["unit"]["scale"], b["magnitude"] * b["unit"]["scale"]
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a["unit"]["dims"] == b["unit"]["dims"]) & FloatCodec().equal(x, y, tol or 1e-12))


@dataclass
class UncertainFloatCodec(Codec):
    """`n ± s`; a number alone has no deviation."""

    spark_type = "struct<nominal_value:double,std_dev:double>"
    _P = r"^\s*([^±\s]+)\s*(?:(?:±|\+/-)\s*([^±\s]+)\s*)?$"

    def parse(self, c):
        s = c.cast("string")
        n, dev = F.regexp_extract(s, self._P, 1).try_cast("double"), F.regexp_extract(s, self._P, 2)
        return F.when(n.isNotNull() & ((dev == "") | dev.try_cast("double").isNotNull()), F.struct(n.alias("nominal_value"), F.coalesce(dev.try_cast("double"), F.lit(0.0)).alias("std_dev")))

    def serialize(self, c):
        return F.when(c.isNull(), "").otherwise(F.concat_ws(" ± ", c["nominal_value"].cast("string"), c["std_dev"].cast("string")))

    def equal(self, a, b, tol=0.0):
        f = FloatCodec()
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(f.equal(a["nominal_value"], b["nominal_value"], tol) & f.equal(a["std_dev"], b["std_dev"], tol))


@dataclass
class OntoTermCodec(Codec):
    """The id before `!`, without the namespace; terms: the ids that are allowed (larger vocabularies: see operators.validate.foreign_keys)."""

    namespace: str = ""
    terms: list = field(default_factory=list)

    def parse(self, c):
        s = F.trim(F.split(c.cast("string"), "!")[0])
        return F.regexp_replace(s, f"^(?i:{self.namespace}):(?={self.namespace}:)", "") if self.namespace else s

    def checks(self, c):
        out = super().checks(c)
        if self.terms:
            out.append(("term isn't in the vocabulary", c.isNotNull() & ~c.isin(self.terms)))
        return out


_QUOTED = r"'((?:\\.|[^'\\])*)'\s*@\s*'((?:\\.|[^'\\])*)'"


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"(['\\])", r"\\$1")


def _identifier(s: Column) -> Column:
    p = rf"^\s*{_QUOTED}\s*$"
    return F.when(s.rlike(p), F.struct(_unescape(F.regexp_extract(s, p, 2)).alias("namespace"), _unescape(F.regexp_extract(s, p, 1)).alias("id")))


def _identifier_text(c: Column) -> Column:
    return F.concat(F.lit("'"), _escape(c["id"]), F.lit("' @ '"), _escape(c["namespace"]), F.lit("'"))


def identifier_url(c: Column) -> Column:
    """The resolver's address of an identifier."""
    return F.concat(F.lit("https://identifiers.org/"), c["namespace"], F.lit("/"), c["id"])


@dataclass
class IdentifierCodec(Codec):
    spark_type = "struct<namespace:string,id:string>"

    def parse(self, c):
        return _identifier(c.cast("string"))

    def serialize(self, c):
        return F.coalesce(_identifier_text(c), F.lit(""))


@dataclass
class IdentifiersCodec(Codec):
    spark_type = "array<struct<namespace:string,id:string>>"

    def parse(self, c):
        s = c.cast("string")
        found = F.transform(F.regexp_extract_all(s, F.lit(f"({_QUOTED})"), F.lit(1)), _identifier)
        return F.when(s.rlike(rf"^\s*{_QUOTED}(?:\s*,\s*{_QUOTED})*\s*$"), found)

    def serialize(self, c):
        return F.coalesce(F.array_join(F.transform(c, _identifier_text), ", "), F.lit(""))


_DOI = r"(?i)^10.\d{4,9}/[-._;()/:A-Z0-9]+$"


def doi_url(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), c)


def pubmed_url(c: Column) -> Column:
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pubmed/"), c.cast("string"))


@dataclass
class DoiCodec(StringCodec):
    def checks(self, c):
        return [*super().checks(c), ("value must be a DOI", ~self.empty(c) & ~c.rlike(_DOI))]


class _Comma(Codec):
    """A comma-separated list of one kind."""

    item = "string"

    def parse(self, c):
        parts = F.transform(F.split(c.cast("string"), ","), lambda x: F.trim(x))
        cast = F.transform(parts, lambda x: x.try_cast(self.item))
        return F.when(~F.exists(cast, lambda x: x.isNull()), cast)

    def serialize(self, c):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit(""))


@dataclass
class DoisCodec(_Comma):
    spark_type = "array<string>"

    def checks(self, c):
        return [*Codec.checks(self, c), ("values must be DOIs", F.exists(c, lambda x: ~x.rlike(_DOI)))]


@dataclass
class PubMedIdCodec(IntegerCodec):
    min: int | None = 0


@dataclass
class PubMedIdsCodec(_Comma):
    spark_type = "array<bigint>"
    item = "bigint"

    def checks(self, c):
        return [*Codec.checks(self, c), ("values can't be negative", F.exists(c, lambda x: x < 0))]


@dataclass
class ChemicalFormulaCodec(Codec):
    """Element -> count, counts of a repeated element summed, zero counts dropped."""

    spark_type = "map<string,double>"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        parts = F.regexp_extract_all(s, F.lit(r"([A-Z][a-z]?-?[0-9.]*)"), F.lit(1))
        pairs = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z]+", 0).alias("k"), F.coalesce(F.regexp_extract(x, r"-?[0-9.]+$", 0).try_cast("double"), F.lit(1.0)).alias("v")))
        names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
        sums = F.transform(names, lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["v"]).alias("value")))
        return F.when(s.rlike(r"^(?:[A-Z][a-z]?(?:-?(?:\d+\.?\d*|\.\d+))?)+$"), F.map_from_entries(F.filter(sums, lambda e: e["value"] != 0)))

    def serialize(self, c):
        number = lambda v: F.when(v == 1, "").when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], number(e["value"]))), ""), F.lit(""))

    def equal(self, a, b, tol=0.0):
        return self.serialize(a).eqNullSafe(self.serialize(b))


@dataclass
class ChemicalStructureCodec(Codec):
    """`format[/alphabet]: value`. The value itself is opaque text."""

    spark_type = "struct<format:string,alphabet:string,value:string>"
    _P = r"^\s*(inchi|smiles|bpforms|bcforms)(?:/([A-Za-z0-9_]+))?\s*:\s*(.+?)\s*$"

    def parse(self, c):
        s = c.cast("string")
        part = lambda k: F.nullif(F.regexp_extract(s, self._P, k), F.lit(""))
        return F.when(s.rlike(self._P), F.struct(part(1).alias("format"), part(2).alias("alphabet"), part(3).alias("value")))

    def serialize(self, c):
        return F.coalesce(F.concat(c["format"], F.coalesce(F.concat(F.lit("/"), c["alphabet"]), F.lit("")), F.lit(": "), c["value"]), F.lit(""))


_NUM = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


@dataclass
class ReactionEquationCodec(Codec):
    """`[c]: a + (2) b <=> d` or `a[c] <=> b[e]`: participants with stoichiometry, negative on the left. A participant that occurs twice on a side is malformed."""

    spark_type = "array<struct<species:string,compartment:string,stoichiometry:double>>"

    def parse(self, c):
        s = c.cast("string")
        name = r"[A-Za-z0-9_\-]*[A-Za-z_\-][A-Za-z0-9_\-]*"
        one_gbl, one_lcl = rf"(?:\( *{_NUM} *\) *)?{name}", rf"(?:\( *{_NUM} *\) *)?{name} *\[ *{name} *\]"
        side = lambda p: rf"(?:{p}(?: *\+ *{p})*)?"
        gbl = rf"^ *\[ *({name}) *\] *: *{side(one_gbl)} *<=> *{side(one_gbl)} *$"
        lcl = rf"^ *{side(one_lcl)} *<=> *{side(one_lcl)} *$"
        where = F.nullif(F.regexp_extract(s, rf"^ *\[ *({name}) *\] *:", 1), F.lit(""))
        sides = F.split(F.regexp_replace(s, rf"^ *\[ *{name} *\] *:", ""), "<=>")

        def parts(text: Column, sign: float) -> Column:
            items = F.filter(F.transform(F.split(text, r"\+(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")
            return F.transform(
                items,
                lambda x: F.struct(
                    F.regexp_extract(x, rf"^(?:\([^)]*\))? *({name})", 1).alias("species"),
                    F.coalesce(F.nullif(F.regexp_extract(x, rf"\[ *({name}) *\]", 1), F.lit("")), where).alias("compartment"),
                    (F.coalesce(F.regexp_extract(x, rf"^\( *({_NUM}) *\)", 1).try_cast("double"), F.lit(1.0)) * sign).alias("stoichiometry"),
                ),
            )

        left, right = parts(sides[0], -1.0), parts(F.get(sides, 1), 1.0)
        ids = lambda a: F.transform(a, lambda p: F.struct(p["species"], p["compartment"]))
        once = (F.size(F.array_distinct(ids(left))) == F.size(left)) & (F.size(F.array_distinct(ids(right))) == F.size(right))
        return F.when((s.rlike(gbl) | s.rlike(lcl)) & once, F.array_sort(F.concat(left, right)))

    def serialize(self, c):
        places = F.array_distinct(F.transform(c, lambda p: p["compartment"]))
        number = lambda v: F.when(v == 1, "").when(v == F.floor(v), F.concat(F.lit("("), v.cast("bigint").cast("string"), F.lit(") "))).otherwise(F.concat(F.lit("("), v.cast("string"), F.lit(") ")))
        one = F.size(places) == 1
        term = lambda p: F.concat(number(F.abs(p["stoichiometry"])), p["species"], F.when(one, "").otherwise(F.concat(F.lit("["), p["compartment"], F.lit("]"))))
        side = lambda neg: F.array_join(F.transform(F.filter(c, lambda p: (p["stoichiometry"] < 0) == F.lit(neg)), term), " + ")
        return F.coalesce(F.concat(F.when(one, F.concat(F.lit("["), places[0], F.lit("]: "))).otherwise(""), side(True), F.lit(" <=> "), side(False)), F.lit(""))


@dataclass
class FeatureLocCodec(Codec):
    """`start,end,strand`."""

    spark_type = "struct<start:bigint,end:bigint,strand:int>"

    def parse(self, c):
        p = F.transform(F.split(c.cast("string"), ","), lambda x: F.trim(x).try_cast("bigint"))
        got = F.struct(p[0].alias("start"), F.get(p, 1).alias("end"), F.get(p, 2).cast("int").alias("strand"))
        return F.when((F.size(p) == 3) & ~F.exists(p, lambda x: x.isNull()), got)

    def checks(self, c):
        return [*super().checks(c), ("start can't be after end", c["start"] > c["end"])]

    def serialize(self, c):
        return F.when(c.isNull(), "").otherwise(F.concat_ws(",", c["start"], c["end"], c["strand"]))


@dataclass
class SeqCodec(StringCodec):
    max_length: int = 4294967295
    letters = "A-Za-z*.-"

    def checks(self, c):
        return [*super().checks(c), ("value has letters outside the alphabet", ~self.empty(c) & ~c.rlike(f"^[{self.letters}]*$"))]


@dataclass
class DnaSeqCodec(SeqCodec):
    letters = "ACGTNRYSWKMBDHVacgtnryswkmbdhv-"


@dataclass
class RnaSeqCodec(SeqCodec):
    letters = "ACGUNRYSWKMBDHVacgunryswkmbdhv-"


@dataclass
class ProteinSeqCodec(SeqCodec):
    letters = "A-IK-NP-Za-ik-np-z*-"


@dataclass
class FreqPosMatrixCodec(Codec):
    """JSON: letter -> counts by position, all of one length; `_alphabet` is left out."""

    spark_type = "map<string,array<double>>"

    def parse(self, c):
        raw = F.from_json(F.regexp_replace(c.cast("string"), r'"_alphabet"\s*:\s*"[^"]*"\s*,?', ""), self.spark_type)
        return F.when(F.size(F.array_distinct(F.transform(F.map_values(raw), F.size))) <= 1, raw)

    def serialize(self, c):
        return F.coalesce(F.to_json(c), F.lit(""))

    def equal(self, a, b, tol=0.0):
        return F.to_json(F.array_sort(F.map_entries(a))).eqNullSafe(F.to_json(F.array_sort(F.map_entries(b))))


@dataclass
class BasicCodec(StringCodec):
    """A symbolic value as its text, without surrounding blanks."""

    def clean(self, c):
        return F.coalesce(F.trim(c.cast("string")), F.lit(""))


@dataclass
class ExprCodec(BasicCodec):
    pass


@dataclass
class SymbolCodec(BasicCodec):
    pass


__all__ = ["UNITS", "doi_url", "identifier_url", "parse_unit", "pubmed_url"]
