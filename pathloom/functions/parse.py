"""Reading of tag values that people typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Kilometres of a mile, and km/h outside and inside towns.
MILE = 1.609
RURAL, URBAN = 80.0, 50.0
#: The tags that may tell a speed limit, in order.
SPEED_TAGS = ("maxspeed", "maxspeed:type", "zone:maxspeed", "source:maxspeed")


def lenient_number(value: Column) -> Column:
    """The first word of ``value`` as a number, with a comma or a point; null if the whole word isn't one."""
    word = F.replace(F.get(F.split(F.regexp_replace(value, r"^\s+", ""), r"\s+"), F.lit(0)), F.lit(","), F.lit("."))
    return F.when(word.rlike(NUMBER), word.try_cast("double"))


def speed_limit(value: Column) -> Column:
    """km/h of one speed tag, null if it tells none."""
    kind = F.lower(F.trim(F.element_at(F.split(value, ":"), -1)))
    number = lenient_number(F.when(kind.startswith("zone"), F.substring(kind, 5, 1 << 20)).otherwise(kind))
    return F.when(kind == "rural", RURAL).when(kind == "urban", URBAN).otherwise(F.when(value.contains("mph"), number * MILE).otherwise(number))


def allowed_speed(tags: Column | dict[str, Column]) -> Column:
    """km/h by the first speed tag that tells one."""
    return F.coalesce(*[F.when(tags[k] != "", speed_limit(tags[k])) for k in SPEED_TAGS])


def xml_text(value: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value
