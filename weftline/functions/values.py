"""JSON values as comparable structs, normalization and coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_text import object_entries
from .text import comparable

NUMBER = r"^[+-]?(\d+(_\d+)*)?(\.\d*(_\d+)*)?([eE][+-]?\d+)?$"
#: Canonical value: kind is null, num, str or json; booleans are the numbers 0 and 1, as equality takes them. whole holds
#: numbers from 2**53 on exactly, and form tells whole numbers (int) and booleans (bool) from others; it is no part of equality.
CANONICAL = "struct<kind:string,num:double,str:string,whole:decimal(38,0),form:string>"
EXACT = float(1 << 53)


def _value(kind: str, num: Column | None = None, text: Column | None = None, whole: Column | None = None, form: str | None = None) -> Column:
    cast = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(F.lit(kind).alias("kind"), cast(num, "double").alias("num"), cast(text, "string").alias("str"), cast(whole, "decimal(38,0)").alias("whole"), F.lit(form).cast("string").alias("form"))


def key(v: Column) -> Column:
    """What equality compares of a canonical value."""
    return F.struct(v["kind"], v["num"], v["whole"], v["str"])


def float_text(n: Column) -> Column:
    """A double as text: 1.0, 12.5, 1e+16; shortest digits, an exponent from 1e16 on and below 0.0001."""
    plain = F.regexp_replace(F.regexp_replace(n.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    java = n.cast("string")
    mantissa = F.regexp_replace(F.regexp_replace(java, "E.*$", ""), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    far = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    special = F.when(F.isnan(n), "nan").when(n == float("inf"), "inf").when(n == float("-inf"), "-inf")
    return F.coalesce(special, F.when((n != 0) & ((F.abs(n) >= 1e16) | (F.abs(n) < 1e-4)), far).otherwise(plain))


def canonical(v: Column) -> Column:
    """A variant as a struct that <=> compares: numbers with numbers and booleans, never with strings."""
    kind = F.schema_of_variant(v)
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    # the parser takes whole numbers of 64 bits as such and larger ones as decimals; a decimal of fewer digits had a point
    exact = F.try_variant_get(v, "$", "decimal(38,0)")
    large = lambda c: F.when(F.abs(number) >= EXACT, c)
    return F.when(kind == "VOID", _value("null")).when(kind == "BOOLEAN", _value("num", number, form="bool")).when(kind.rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))"), _value("num", number, whole=large(exact), form="int")).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), _value("num", number, whole=large(number.try_cast("decimal(38,0)")))).when(kind == "STRING", _value("str", text=text)).when(v.isNotNull(), _value("json", text=F.to_json(v)))


def number_text(c: Column) -> Column:
    """The number that a text spells, with underscores between digits allowed; else null."""
    return F.when(c.rlike(NUMBER) & c.rlike(r"\d"), F.regexp_replace(c, "_", "").try_cast("double"))


def normalized(value: Column) -> Column:
    """A canonical value as strict comparison sees it: numeric text is a number, null, none and empty text are null."""
    s = comparable(value["str"])
    n = number_text(s)
    digits = F.when(s.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(s, "_", "").try_cast("decimal(38,0)"))
    text = F.when(F.lower(s).isin("null", "none", ""), _value("null")).when(digits.isNotNull(), _value("num", n, whole=F.when(F.abs(digits) >= 1 << 53, digits), form="int")).when(n.isNotNull(), _value("num", n)).otherwise(_value("str", text=s))
    # true as a JSON boolean is the number 1 here, and text "true" stays text
    return F.when(value["kind"] == "str", text).otherwise(value)


def almost_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Equality of canonical values; numbers within tolerance."""
    if not tolerance:
        return key(a).eqNullSafe(key(b))
    both = (a["kind"] == "num") & (b["kind"] == "num")
    return F.when(F.coalesce(both, F.lit(False)), F.abs(a["num"] - b["num"]) <= tolerance).otherwise(key(a).eqNullSafe(key(b)))


# Texts that mean true and false.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def coerce(v: Column, schema: Column) -> Column:
    """A canonical value as its declared schema wants it, as a canonical value; null where it can't be."""
    schema = F.lower(schema)
    text = F.trim(v["str"])
    number = F.when(v["kind"] == "num", v["num"]).when(v["kind"] == "str", number_text(text))
    true = F.when(v["kind"] == "num", v["num"] != 0).when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
    none = _value("null")
    real = F.when(number.isNotNull(), _value("num", number, whole=v["whole"])).otherwise(none)
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    whole = F.when(number.isNotNull(), _value("num", cut, whole=v["whole"], form="int")).otherwise(none)
    flag = F.when(true.isNotNull(), _value("num", true.cast("double"), form="bool")).otherwise(none)
    return F.when(v["kind"] == "null", none).when(schema.isin("double", "float"), real).when(schema.isin("integer", "long", "int"), whole).when(schema.isin("boolean", "bool"), flag).otherwise(_value("str", text=as_text(v)))


def as_text(v: Column) -> Column:
    """Plain text of a canonical value: None, True, False, every digit of a whole number, 1.0, text as it is."""
    whole = F.coalesce(v["whole"], v["num"].try_cast("decimal(38,0)")).cast("string")
    number = F.when(v["form"] == "bool", F.when(v["num"] != 0, "True").otherwise("False")).when(v["form"] == "int", whole).otherwise(float_text(v["num"]))
    return F.when(v["kind"] == "null", "None").when(v["kind"] == "num", number).otherwise(v["str"])


def cast_generated(v: Column, schema: Column) -> Column:
    """As coerce, but what can't be converted stays as text, text of no truth value counts as true, and values of a schema that is none of those stay as they are."""
    c = coerce(v, schema)
    known = F.lower(F.coalesce(schema, F.lit(""))).isin("double", "float", "integer", "long", "int", "boolean", "bool", "string")
    lost = (c["kind"] == "null") | c["kind"].isNull()
    flag = F.lower(schema).isin("boolean", "bool") & (v["kind"] == "str")
    return F.when(~known, v).when(flag & lost, _value("num", (F.length(F.trim(v["str"])) > 0).cast("double"), form="bool")).when(lost, _value("str", text=as_text(v))).otherwise(c)


def explode_object(df: DataFrame, json: str, keep: list[str], prefix: str = "") -> DataFrame:
    """One row per key of the JSON object in column json: keep, key and value (canonical). Explicit nulls are rows, the last of repeated keys counts; what is no object gives none."""
    rows = df.select(*keep, F.explode(object_entries(json)).alias("__e"))
    return rows.select(*keep, F.col("__e.key").alias(prefix + "key"), F.col("__e.value").alias(prefix + "value"))
