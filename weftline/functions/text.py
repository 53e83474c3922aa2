"""Scalar text functions: each takes and returns Columns."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .json_text import is_array, is_object, json_shape

SPACES = r"(?U)\s+"
#: Dashes that count as a hyphen (U+2010, U+2012, U+2013, U+2014, U+2212).
DASHES = "[‐‒–—−]"


def squeeze(c: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def normalize(c: Column) -> Column:
    return squeeze(F.lower(c))


def comparable(c: Column) -> Column:
    """Text as strict comparison sees it: trimmed, dashes as hyphens, white space squeezed; case counts."""
    return squeeze(F.regexp_replace(c, DASHES, "-"))


def dtmi_component(c: Column) -> Column:
    """The component of dtmi:<group>:<component>;<version>, else ''."""
    # fixed value: the id's pattern
    return F.regexp_extract(F.trim(c), r"^dtmi:([^:;]+):([^;]+);[0-9]+$", 2)


def dtmi_group(c: Column) -> Column:
    """The second part of an id of at least three parts led by dtmi, else ''."""
    parts = F.split(F.trim(c), ":")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "dtmi"), F.trim(F.get(parts, F.lit(1)))).otherwise("")


def safe_name(c: Column, default: str = "subsystem") -> Column:
    """Letters, digits and single underscores, none at the ends, 60 characters at most."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[^0-9A-Za-z_]", "_"), "_+", "_")
    s = F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(60))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def subsystem_name(identifier: Column, display_name: Column, fallback: Column) -> Column:
    """The last part of an id without its version, else the display name, else fallback; as a safe name."""
    tail = F.element_at(F.split(F.get(F.split(identifier, ";"), F.lit(0)), ":"), -1)
    first = F.coalesce(F.nullif(F.trim(tail), F.lit("")), F.nullif(F.trim(display_name), F.lit("")), fallback)
    return safe_name(first)


def json_fenced_or_braced(c: Column) -> Column:
    """The first fenced JSON object, else from the first { to the last }, else the trimmed text."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    # fixed value: the pattern of a fenced object
    return F.coalesce(found(r"(?s)```json\s*(\{.*?\})\s*```"), found(r"(?s)(\{.*\})"), F.trim(c))


def json_object_slice(c: Column) -> Column:
    """Text led by { as it is, else from the first { to the last }; {} where that is no JSON object."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = F.when(t.startswith("{"), t).otherwise(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    return F.when(is_object(s), s).otherwise("{}")


def json_array_slice(c: Column) -> Column:
    """The text if it is a JSON array, else from its first [ to its last ]; null if that is none."""
    whole, part = F.trim(c), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(is_array(whole), whole).when(is_array(part), part)


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; parts of a second are cut off."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%02d:%02d", m, F.pmod(s, F.lit(60))))


def duration(seconds: Column) -> Column:
    """1h01m01s, 1m05s or 5s; rounded half to even."""
    s = F.bround(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def progress_bar(done: Column, total: Column, elapsed: Column, width: int = 24) -> Column:
    """[####----] percent, elapsed time and what is left at the mean pace; a total below 1 counts as 1."""
    t = F.when(total <= 0, 1).otherwise(total)
    share = F.least(F.lit(1.0), done / t)
    n = F.floor(share * width).cast("int")
    left = F.coalesce(F.try_divide(elapsed, done), F.lit(0.0)) * F.greatest(t - done, F.lit(0))
    return F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n), F.lit("] "), F.format_string("%.1f%%", share * 100), F.lit(" "), clock(elapsed), F.lit(" ETA "), clock(left))


def strip_fences(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```\w*", ""), r"```$", ""))


def python_block(c: Column) -> Column:
    """The code between the first ```python and the next fence, or the end, trimmed; null without one."""
    code = F.regexp_extract(c, r"(?s)```python(.*?)(?:```|\z)", 1)
    return F.when(c.contains("```python"), F.regexp_replace(code, r"^\s+|\s+$", ""))


def display_id(is_object: Column, identifier: Column, display_name: Column) -> Column:
    """Both in quotes, null as empty: single ones, unless the text holds a single quote and no double one; a quote that ends the text early is escaped."""

    def quoted(c: Column) -> Column:
        s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
        double = s.contains("'") & ~s.contains('"')
        return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.when(is_object, F.concat(F.lit("@id="), quoted(identifier), F.lit(", displayName="), quoted(display_name))).otherwise("<non-dict interface>")


def fill_template(template: str, **columns: Column) -> Column:
    """A prompt: {name} in template is replaced by the column of that name, null by nothing. What a column holds is not looked at again; other braces stay."""
    parts = re.split("(" + "|".join(r"\{" + re.escape(name) + r"\}" for name in columns) + ")", template) if columns else [template]
    return F.concat(*(F.coalesce(columns[p[1:-1]].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def field_list(fields: Column) -> Column:
    """- name (schema) lines of an array of structs of name and schema."""
    return F.array_join(F.transform(fields, lambda x: F.format_string("- %s (%s)", x["name"], x["schema"])), "\n")


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def query_length(c: Column) -> Column:
    """Code points; null counts as empty."""
    return F.coalesce(F.char_length(c), F.lit(0))


def capped(a: Column, most: int) -> Column:
    """The first most items of an array of text, trimmed, blank ones left out before counting."""
    return F.slice(F.filter(F.transform(a, lambda x: squeeze_ends(x)), lambda x: x != ""), 1, most)


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def minified_json(c: Column) -> Column:
    """JSON text without white space outside of strings; keys keep their order and text its letters."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


@F.pandas_udf(StringType())
def pretty_json(c: pd.Series) -> pd.Series:
    """JSON text indented by 2, keys in their order; for reports. What is no JSON stays as it is."""

    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s), ensure_ascii=False, indent=2)
        except ValueError:
            return s

    return c.map(one)


@F.pandas_udf(StringType())
def _literal(c: pd.Series) -> pd.Series:
    """The JSON of a literal of Python syntax, null for anything else."""

    def one(s):
        try:
            return None if s is None else json.dumps(ast.literal_eval(s), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return c.map(one)


def json_or_literal(c: Column, strict: bool = False) -> Column:
    """JSON text of a text that holds JSON, or else a literal of Python syntax.

    strict cuts out the first object or list where the text does not begin with one, and what is neither raises an
    error; otherwise the whole text is taken and what is neither comes back as it is.
    """
    t = squeeze_ends(c)
    if strict:
        brace, bracket = F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.regexp_extract(t, r"(?s)(\[.*\])", 1)
        first = F.when(brace == "", bracket).when(bracket == "", brace).when(F.locate("{", t) < F.locate("[", t), brace).otherwise(bracket)
        t = F.when(t.startswith("{") | t.startswith("[") | (first == ""), t).otherwise(first)
    good = json_shape(t).isNotNull()
    other = _literal(F.when(~good, t))
    bad = F.raise_error(F.concat(F.lit("neither JSON nor a literal: "), c)) if strict else c
    return F.when(c.isNull(), None).when(good, t).when(other.isNotNull(), other).otherwise(bad)
