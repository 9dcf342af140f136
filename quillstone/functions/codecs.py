"""Codecs of attribute types. A codec turns text into a typed column, checks it, writes it back and compares it.

clean(text) gives the value, or null where it can't; bad(text) says where text was there but couldn't be cleaned;
checks() gives (message, condition) pairs that hold where a value breaks a constraint. All are built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import text as T

REGISTRY: dict[str, type[Codec]] = {}


@dataclass
class Codec:
    """Text of any kind. none: whether a missing value is allowed; default: what a blank cell becomes."""

    none: bool = True
    default: object = None
    kind = "String"
    spark_type = "string"

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        REGISTRY[cls.__name__.removesuffix("Codec")] = cls
        cls.kind = cls.__name__.removesuffix("Codec")

    def parse(self, c: Column) -> Column:
        return c.cast(self.spark_type)

    def clean(self, c: Column) -> Column:
        blank = F.lit(self.default).cast(self.spark_type) if self.default is not None else self.blank_value()
        return F.when(T.blank(c), blank).otherwise(self.parse(c))

    def blank_value(self) -> Column:
        return F.lit(None).cast(self.spark_type)

    def bad(self, c: Column) -> Column:
        return ~T.blank(c) & self.parse(c).isNull()

    def empty(self, c: Column) -> Column:
        return c.isNull()

    def checks(self, c: Column) -> list[tuple[str, Column]]:
        return [] if self.none else [("value can't be blank", self.empty(c))]

    def serialize(self, c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def key(self, c: Column) -> Column:
        """What makes two values the same for uniqueness."""
        return self.serialize(c)

    def equal(self, a: Column, b: Column, tol: float = 0.0) -> Column:
        return a.eqNullSafe(b)


@dataclass
class BooleanCodec(Codec):
    spark_type = "boolean"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        number = s.try_cast("double")
        return F.when(s.isin("true", "True", "TRUE") | (number == 1), F.lit(True)).when(s.isin("false", "False", "FALSE") | (number == 0), F.lit(False))

    def bad(self, c):
        return ~T.blank(c) & self.parse(c).isNull() & ~F.isnan(F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0)))


@dataclass
class EnumCodec(Codec):
    """choices: name -> value. Text matches a name, a number matches a value; the column holds the name."""

    choices: dict = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.choices, (list, tuple)):
            self.choices = {str(n): k + 1 for k, n in enumerate(self.choices)}

    def parse(self, c):
        s = F.trim(c.cast("string"))
        out = F.when(s.isin(list(self.choices)), s)
        for name, value in self.choices.items():
            if isinstance(value, (int, float)):
                out = out.when(s.try_cast("double") == float(value), F.lit(name))
        return out

    def checks(self, c):
        return [*super().checks(c), ("value isn't one of the choices", c.isNotNull() & ~c.isin(list(self.choices)))]


@dataclass
class FloatCodec(Codec):
    """A blank is NaN. Bounds are inclusive and don't hold for NaN."""

    min: float | None = None
    max: float | None = None
    nan: bool = True
    spark_type = "double"

    def parse(self, c):
        return F.trim(c.cast("string")).try_cast("double")

    def blank_value(self):
        return F.lit(float("nan"))

    def empty(self, c):
        return c.isNull() | F.isnan(c)

    def checks(self, c):
        out = [] if self.nan else [("value can't be NaN", self.empty(c))]
        if self.min is not None:
            out.append((f"value must be at least {self.min:g}", ~F.isnan(c) & (c < self.min)))
        if self.max is not None:
            out.append((f"value must be at most {self.max:g}", ~F.isnan(c) & (c > self.max)))
        return out

    def serialize(self, c):
        return F.when(self.empty(c), "").otherwise(c.cast("string"))

    def equal(self, a, b, tol=0.0):
        """Equal, both NaN, or off by less than tol relative to the left value (absolute where that is 0)."""
        same = a.eqNullSafe(b)
        if not tol:
            return same
        close = F.when(a == 0, F.abs(b) < tol).otherwise(F.abs((a - b) / a) < tol)
        return same | F.coalesce(close & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


@dataclass
class PositiveFloatCodec(FloatCodec):
    def checks(self, c):
        return [*super().checks(c), ("value must be positive", ~F.isnan(c) & (c <= 0))]


@dataclass
class IntegerCodec(Codec):
    """Whole numbers, written as such or as decimals without a fraction. Beyond 64 bits is an error. A missing value is checked as in other types."""

    min: int | None = None
    max: int | None = None
    spark_type = "bigint"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        d = s.try_cast("double")
        whole = F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.cast("bigint"))
        return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint")).otherwise(whole), F.lit(None))

    def checks(self, c):
        out = super().checks(c)
        if self.min is not None:
            out.append((f"value must be at least {self.min}", c < self.min))
        if self.max is not None:
            out.append((f"value must be at most {self.max}", c > self.max))
        return out


@dataclass
class PositiveIntegerCodec(IntegerCodec):
    def checks(self, c):
        return [*super().checks(c), ("value must be positive", c <= 0)]


@dataclass
class StringCodec(Codec):
    """A blank is the empty string."""

    min_length: int = 0
    max_length: int = 255

    def clean(self, c):
        return F.coalesce(c.cast("string"), F.lit(self.default or ""))

    def bad(self, c):
        return F.lit(False)

    def empty(self, c):
        return c.isNull() | (c == "")

    def checks(self, c):
        n = F.length(c)
        out = [] if self.none else [("value can't be blank", self.empty(c))]
        if self.min_length:
            out.append((f"value must have at least {self.min_length} characters", n < self.min_length))
        return [*out, (f"value must have at most {self.max_length} characters", n > self.max_length)]


@dataclass
class LongStringCodec(StringCodec):
    max_length: int = 4294967295


@dataclass
class RegexCodec(StringCodec):
    """The pattern may match anywhere in the text; ignore_case also holds for uniqueness."""

    pattern: str = ""
    ignore_case: bool = False

    def checks(self, c):
        p = ("(?i)" if self.ignore_case else "") + self.pattern
        return [*super().checks(c), ("value doesn't match the pattern", ~c.rlike(p) & ~(self.empty(c) if self.none else F.lit(False)))]

    def key(self, c):
        return F.lower(c) if self.ignore_case else c


@dataclass
class SlugCodec(StringCodec):
    """1 to 200 letters, digits and underscores that aren't a number (decimal, hexadecimal or scientific)."""

    max_length: int = 200

    def checks(self, c):
        word, number = c.rlike("^[A-Za-z0-9_]{1,200}$"), c.rlike("(?i)^([0-9]+|0x[0-9a-f]+|[0-9]+e[0-9]+)$")
        return [("value must be a slug", c.isNull() | ~word | number)]

    def key(self, c):
        return F.lower(c)


@dataclass
class UrlCodec(StringCodec):
    max_length: int = 65535

    def checks(self, c):
        host = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}|localhost|\d{1,3}(?:\.\d{1,3}){3}"
        return [*super().checks(c), ("value must be a URL", ~self.empty(c) & ~c.rlike(rf"^(?i:https?|ftp)://(?:{host})(?::\d+)?(?:[/?#]\S*)?$"))]


@dataclass
class EmailCodec(StringCodec):
    def checks(self, c):
        return [*super().checks(c), ("value must be an e-mail address", ~self.empty(c) & ~c.rlike(r"^[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))]


@dataclass
class LocalPathCodec(StringCodec):
    """A path as text; whether it exists depends on the machine and isn't checked on a cluster."""


#: Dates, with times of day or without, as people and programs write them; brackets hold what may be missing.
_DAYS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d.M.yyyy")
STAMPS = (
    *(f"{d}[ H:mm[:ss[.SSSSSSSSS]][[ ]XXX]]" for d in _DAYS), "yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]][XXX]", "yyyy-M-d'T'H:mm[:ss[.SSSSSSSSS]][XX]", "yyyyMMdd['T'HHmm[ss]][XXX]",
    *(f"{d} h:mm[:ss] a" for d in _DAYS), "yyyy-MM", "MMMM yyyy", "MMM yyyy",
)


def stamp(s: Column) -> Column:
    """The moment that text in one of the usual ways of writing it means, null for others; one with an offset is as the session's time zone has it."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", ""), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    text = F.when(s.rlike("[A-Za-z]{3}"), F.initcap(bare)).otherwise(F.upper(s))
    text = F.regexp_replace(F.regexp_replace(text, r"\b[Aa]m\b", "AM"), r"\b[Pp]m\b", "PM")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in STAMPS])


@dataclass
class DateCodec(Codec):
    """Text in one of the usual ways of writing a date (STAMPS), without a time of day other than midnight; a number n is the day n - 1 days after 1 January 1900."""

    spark_type = "date"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        n = s.try_cast("double")
        serial = F.when((n == F.floor(n)) & n.between(1, 2958465), F.date_add(F.lit("1900-01-01").cast("date"), (n - 1).cast("int")))
        t = stamp(s)
        return F.coalesce(serial, F.when(F.date_trunc("day", t) == t, t.cast("date")))

    def checks(self, c):
        return [*super().checks(c), ("year must be from 1900 to 10000", ~F.year(c).between(1900, 10000))]

    def serialize(self, c):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


@dataclass
class TimeCodec(Codec):
    """Seconds of the day. Text h:m or h:m:s, or a fraction of a day."""

    spark_type = "int"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        p = F.transform(F.split(s, ":"), lambda x: x.try_cast("int"))
        sum_ = p[0] * 3600 + p[1] * 60 + F.coalesce(F.get(p, 2), F.lit(0))
        clock = F.when(s.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$") & (p[0] < 24) & (p[1] < 60) & (F.coalesce(F.get(p, 2), F.lit(0)) < 60), sum_)
        part = F.round(s.try_cast("double") * 86400).cast("int")
        return F.coalesce(clock, F.when(part.between(0, 86399), part))

    def serialize(self, c):
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        return F.when(c.isNull(), "").otherwise(F.concat_ws(":", two(F.floor(c / 3600)), two(F.floor(c / 60) % 60), two(c % 60)))


@dataclass
class DateTimeCodec(Codec):
    spark_type = "timestamp_ntz"

    def parse(self, c):
        s = F.trim(c.cast("string"))
        n = s.try_cast("double")
        days, rest = F.floor(n), F.round((n - F.floor(n)) * 86400)
        serial = F.when(n.between(1, 2958465), F.timestamp_seconds(F.unix_date(F.date_add(F.lit("1900-01-01").cast("date"), (days - 1).cast("int"))) * 86400 + rest))
        return F.coalesce(stamp(s), serial).cast("timestamp_ntz")

    def serialize(self, c):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


@dataclass
class RangeCodec(Codec):
    """`a - b` or one number. Zero to zero is a range like any other; a minus sign right after the separator or at the start makes a number negative."""

    spark_type = "struct<min:double,max:double>"
    _NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"

    def parse(self, c):
        p = rf"^\s*({self._NUMBER})(?:\s*-\s*({self._NUMBER}))?\s*$"
        s = c.cast("string")
        a = F.regexp_extract(s, p, 1).try_cast("double")
        b = F.coalesce(F.regexp_extract(s, p, 2).try_cast("double"), a)
        return F.when(s.rlike(p), F.struct(a.alias("min"), b.alias("max")))

    def checks(self, c):
        return [*super().checks(c), ("minimum can't be above maximum", c["min"] > c["max"])]

    def serialize(self, c):
        lo, hi = c["min"].cast("string"), c["max"].cast("string")
        return F.when(c.isNull(), "").when(c["min"] == c["max"], lo).otherwise(F.concat_ws(" - ", lo, hi))

    def equal(self, a, b, tol=0.0):
        f = FloatCodec()
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(f.equal(a["min"], b["min"], tol) & f.equal(a["max"], b["max"], tol))


@dataclass
class ListCodec(Codec):
    type: str = "string"
    separator: str = ","
    min_length: int = 0
    max_length: int | None = None

    @property
    def spark_type(self):
        return f"array<{self.type}>"

    def blank_value(self):
        return F.array().cast(self.spark_type)

    def parse(self, c):
        items = T.split_list(c.cast("string"), self.separator)
        if self.type == "string":
            return items
        cast = F.transform(items, lambda x: x.try_cast(self.type))
        return F.when(~F.exists(cast, lambda x: x.isNull()), cast)

    def empty(self, c):
        return c.isNull() | (F.size(c) == 0)

    def checks(self, c):
        out = super().checks(c)
        if self.min_length:
            out.append((f"list must have at least {self.min_length} items", F.coalesce(F.size(c), F.lit(0)) < self.min_length))
        if self.max_length is not None:
            out.append((f"list must have at most {self.max_length} items", F.size(c) > self.max_length))
        return out

    def serialize(self, c):
        return F.coalesce(T.join_list(F.transform(c, lambda x: x.cast("string")), self.separator), F.lit(""))


@dataclass
class ArrayCodec(Codec):
    """Numbers in JSON, within bounds of length."""

    min_length: int = 0
    max_length: int | None = None
    spark_type = "array<double>"

    def parse(self, c):
        got = F.from_json(c.cast("string"), "array<double>")
        return F.when(c.cast("string").rlike(r"^\s*\[") & ~F.exists(got, lambda x: x.isNull()), got)

    def checks(self, c):
        out = super().checks(c)
        if self.min_length:
            out.append((f"array must have at least {self.min_length} items", F.size(c) < self.min_length))
        if self.max_length is not None:
            out.append((f"array must have at most {self.max_length} items", F.size(c) > self.max_length))
        return out

    def serialize(self, c):
        return F.coalesce(F.to_json(c), F.lit(""))


@dataclass
class TableCodec(ArrayCodec):
    """A table in JSON: column -> index -> number."""

    spark_type = "map<string,map<string,double>>"

    def parse(self, c):
        return F.from_json(c.cast("string"), self.spark_type)

    def checks(self, c):
        return Codec.checks(self, c)

    def key(self, c):
        return F.to_json(F.array_sort(F.map_entries(c)))

    def equal(self, a, b, tol=0.0):
        return self.key(a).eqNullSafe(self.key(b))


@dataclass
class JsonCodec(Codec):
    """Any JSON, kept as its text."""

    def parse(self, c):
        return F.when(F.try_parse_json(c.cast("string")).isNotNull(), c.cast("string"))


class NoTypeError(ValueError):
    """A type that isn't registered, or an option that it doesn't have."""


#: Options that say something of the column, not of its values, or that only the libraries behind a type understand.
ELSEWHERE = {"verbose_name", "description", "help", "init_value", "none_value", "primary", "unique", "unique_case_insensitive", "default_cleaned_value", "enum_class", "registry", "ontology", "namespace", "namespaces", "primary_units", "primary_structures", "dtype", "default_for_export", "language"}


def codec(kind: str, **options) -> Codec:
    """The codec of a type by name; a module prefix (`chem.ChemicalFormula`) is left out."""
    import quillstone.functions.domain  # noqa: F401 - registers its types

    name = kind.rsplit(".", 1)[-1]
    if name not in REGISTRY:
        raise NoTypeError(f"no attribute type {kind!r}")
    cls = REGISTRY[name]
    known = set(cls.__dataclass_fields__)
    if bad := set(options) - known - ELSEWHERE:
        raise NoTypeError(f"{kind} has no option {sorted(bad)}")
    return cls(**{k: v for k, v in options.items() if k in known})
