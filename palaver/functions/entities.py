"""Character references decoded inside the JVM.

A text is cut into references and what lies between; a reference is a number or a name. The
names are Python's own table, as one constant map that is looked up by first letter, then name.
"""

from __future__ import annotations

import functools
import html
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference, or a stretch without one.
_TOKENS = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Numbers below this one have characters of their own (or none) where Python says so.
_LOW = 0xA0


@functools.cache
def _names() -> str:
    """JSON of {first letter: {name: characters}}; a name has its semicolon, if it needs one."""
    out: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        out.setdefault(name[0], {})[name] = value
    return json.dumps(out)


@functools.cache
def _short_names() -> str:
    """A pattern of the names that need no semicolon, longest first."""
    return "^(" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


@functools.cache
def _low_numbers() -> str:
    return json.dumps([html.unescape(f"&#{n};") for n in range(_LOW)])


def _character(number: Column) -> Column:
    """The character of a number of at most seven digits."""
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    low = F.get(F.from_json(F.lit(_low_numbers()), "array<string>"), number.cast("int"))
    wrong = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(number < _LOW, low).when(wrong, F.lit("�")).when(nothing, F.lit("")).otherwise(plain)


def _numbered(token: Column) -> Column:
    digits = F.regexp_extract(token, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    of_hex = F.rlike(token, F.lit("^&#[xX]"))
    # longer numbers are no characters, and would not fit
    safe = F.when(F.length(digits) > 7, F.lit("9999999")).when(digits == "", F.lit("0")).otherwise(digits)
    return _character(F.when(of_hex, F.conv(safe, 16, 10)).otherwise(safe).cast("long"))


def _named(token: Column) -> Column:
    name = F.substring(token, 2, 64)
    whole = F.try_element_at(F.try_element_at(F.from_json(F.lit(_names()), "map<string,map<string,string>>"), F.substring(name, 1, 1)), name)
    short = F.regexp_extract(name, _short_names(), 1)
    known = F.try_element_at(F.try_element_at(F.from_json(F.lit(_names()), "map<string,map<string,string>>"), F.substring(short, 1, 1)), short)
    rest = F.substring(name, F.length(short) + 1, F.lit(64))
    return F.coalesce(whole, F.when(short != "", F.concat(known, rest)), token)


def _once(text: Column) -> Column:
    one = lambda t: F.when(~F.startswith(t, F.lit("&")) | (t == "&"), t).when(F.startswith(t, F.lit("&#")), _numbered(t)).otherwise(_named(t))
    cut = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), one), "")
    return F.when(F.contains(text, F.lit("&")), cut).otherwise(text)


def decoded(text: Column, times: int = 1) -> Column:
    """References decoded so many times, as ``html.unescape`` does. Each result is made once and then looked at."""
    held = F.array(text)
    for _ in range(times):
        held = F.transform(held, _once)
    return F.get(held, 0)
