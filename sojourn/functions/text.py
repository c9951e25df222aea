"""Text rules of the export formats and of the naming step, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.constants import UNKNOWN_PLACE
from sojourn.functions.geo import valid_coordinate

#: Characters that count as white space in the export's own rules, as a character class.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
DECIMAL_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x) -> Column:
    """Half-up rounding towards plus infinity, as BIGINT."""
    return F.floor(_col(x) + F.lit(0.5)).cast("bigint")


def blank_to_null(x) -> Column:
    return F.nullif(_col(x), F.lit(""))


def trimmed(x) -> Column:
    """Without white space at both ends: blanks, tabs, line ends, no-break and other Unicode spaces."""
    return F.regexp_replace(_col(x), f"^[{WHITE}]+|[{WHITE}]+$", "")


def parse_latlng(value) -> Column:
    """First two decimal numbers of a text as ``struct(lat, lng)``; NULL when out of range or absent."""
    numbers = F.regexp_extract_all(_col(value), F.lit(DECIMAL_NUMBER), F.lit(0))
    lat = F.try_element_at(numbers, F.lit(1)).try_cast("double")
    lng = F.try_element_at(numbers, F.lit(2)).try_cast("double")
    return F.when(valid_coordinate(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))


def read_location(value) -> Column:
    """A coordinate text that may be wrapped as ``{"latLng": ...}``."""
    value = _col(value)
    wrapped = F.when(value.startswith("{"), F.get_json_object(value, "$.latLng"))
    return parse_latlng(F.coalesce(wrapped, value))


def iso_seconds(text) -> Column:
    """ISO text to whole epoch seconds (millisecond precision, rounded half up)."""
    millis = F.floor(F.unix_micros(F.try_to_timestamp(_col(text))) / F.lit(1000))
    return js_round(millis / F.lit(1000.0))


def millis_seconds(number) -> Column:
    """Epoch milliseconds to whole epoch seconds."""
    return js_round(_col(number).try_cast("double") / F.lit(1000.0))


def to_seconds(text) -> Column:
    """ISO text or a bare epoch-millisecond number (read as text) to epoch seconds."""
    text = _col(text)
    return F.when(text.rlike(r"^-?\d{5,}(?:\.\d+)?$"), millis_seconds(text)).otherwise(iso_seconds(text))


def normalise_label(text) -> Column:
    label = F.upper(trimmed(text))
    return F.nullif(F.nullif(label, F.lit("")), F.lit("UNKNOWN"))


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Every character that decomposes to one ASCII letter or digit plus combining marks U+0300-U+036F."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if parts != char and len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def category_token(text) -> Column:
    """Category text to a machine token: accents off, lower case, other runs to ``_``, blank to NULL."""
    source, target = _accented()
    plain = F.regexp_replace(F.translate(_col(text), source, target), "[\\u0300-\\u036f]", "")
    joined = F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_")
    return blank_to_null(F.btrim(joined, F.lit("_")))


def district_pick(city_district, borough, suburb, neighbourhood, quarter) -> Column:
    return F.coalesce(*map(_col, (city_district, borough, suburb, neighbourhood, quarter)))


def venue_district(neighbourhood) -> Column:
    return blank_to_null(trimmed(neighbourhood))


def resolved_name(name, road, house_number, display_name) -> Column:
    street = F.concat_ws(" ", blank_to_null(road), blank_to_null(house_number))
    head = F.try_element_at(F.split(_col(display_name), ","), F.lit(1))
    return F.coalesce(blank_to_null(name), blank_to_null(street), blank_to_null(head), F.lit(UNKNOWN_PLACE))


def display_name(name, lat, lng) -> Column:
    return F.coalesce(_col(name), F.format_string("%.3f, %.3f", _col(lat), _col(lng)))
