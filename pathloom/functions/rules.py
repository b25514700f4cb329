"""Which ways can be run on: refusals by named rule, cost and quality, as columns over a tag map.

A way is judged by its tags alone, at one of the levels strict, normal and tolerant. The rules stand in a
fixed order; the first that holds is the reason of the refusal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.parse import SPEED_TAGS, allowed_speed, lenient_number

LEVELS = ("strict", "normal", "tolerant")


# Fixed values of the rules.
BASE_COST = {
    "footway": 1.00, "pedestrian": 1.00, "cycleway": 1.05, "path": 1.10, "living_street": 1.10, "residential": 1.15,
    "unclassified": 1.20, "track": 1.25, "service": 1.35, "road": 1.60, "bridleway": 1.70, "tertiary": 1.90,
    "tertiary_link": 1.90, "secondary": 3.20, "secondary_link": 3.20, "steps": 4.00,
}
HARD = frozenset({
    "asphalt", "paved", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone", "unhewn_cobblestone", "chipseal",
    "metal", "wood", "compacted", "fine_gravel", "gravel", "pebblestone", "rock", "bricks", "grass_paver",
})
SOFT = frozenset({"ground", "dirt", "earth", "unpaved", "shells"})
RISKY = frozenset({"grass", "woodchips", "clay", "soil", "sand", "dirt/sand"})
FORBIDDEN_SURFACE = frozenset({"mud", "sand", "snow", "ice", "salt", "water", "fine_sand"})
PRIVATE_SERVICE = frozenset({"driveway", "parking_aisle", "drive-through", "emergency_access", "slipway", "bus", "busway"})
BLOCKING = frozenset({"vegetation", "log", "fallen_tree", "tree", "rockfall", "landslide", "boulder", "debris"})
BARRIERS = frozenset({
    "wall", "fence", "hedge", "retaining_wall", "city_wall", "ditch", "jersey_barrier", "full-height_turnstile", "sally_port", "spikes",
    "hampshire_gate", "guard_rail",
})
SHARED_ROADS = frozenset({"unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "road"})
FOOTWAY_SIDES = frozenset({"yes", "both", "left", "right", "separate"})
NATURAL = frozenset({"path", "track", "bridleway"})
CLOSED = frozenset({"no", "private", "customers", "permit", "military", "delivery"})
LAND_WORK = frozenset({"agricultural", "forestry"})
FOOT_ALLOWED = frozenset({"yes", "designated", "permissive", "official"})


@dataclass(frozen=True)
class Rules:
    """The sets and bounds that may be changed; the defaults are those of the library."""

    base_cost: dict[str, float] = field(default_factory=lambda: dict(BASE_COST))
    danger_speed: float = 70.0
    least_width: float = 0.6
    hard: frozenset[str] = HARD
    soft: frozenset[str] = SOFT
    risky: frozenset[str] = RISKY
    forbidden_surface: frozenset[str] = FORBIDDEN_SURFACE
    private_service: frozenset[str] = PRIVATE_SERVICE
    blocking: frozenset[str] = BLOCKING
    barriers: frozenset[str] = BARRIERS
    shared_roads: frozenset[str] = SHARED_ROADS
    footway_sides: frozenset[str] = FOOTWAY_SIDES
    natural: frozenset[str] = NATURAL
    closed: frozenset[str] = CLOSED
    land_work: frozenset[str] = LAND_WORK
    foot_allowed: frozenset[str] = FOOT_ALLOWED

    def __post_init__(self):
        """Sets may be given as any collection of texts; a single text is an error rather than a set of letters."""
        for name, kind in self.__annotations__.items():
            if "frozenset" in str(kind):
                value = getattr(self, name)
                if isinstance(value, str):
                    raise TypeError(f"{name} must be a collection of texts")
                object.__setattr__(self, name, frozenset(value))


DEFAULT = Rules()


def _facts(rules: Rules) -> dict[str, tuple[str, frozenset[str] | None]]:
    """What the rules ask of single tags: name -> (tag, its values), or None for any value."""
    of = lambda *values: frozenset(values)
    # The values in of(...) are fixed values of the rules too.
    return {
        "highway": ("highway", frozenset(rules.base_cost)), "natural": ("highway", rules.natural), "shared": ("highway", rules.shared_roads),
        "area": ("area", of("yes")), "indoor": ("indoor", of("yes")), "storey": ("level", None),
        "foot refused": ("foot", of("no", "private", "destination")), "foot allowed": ("foot", rules.foot_allowed),
        "foot invited": ("foot", of("yes", "designated", "official")), "foot designated": ("foot", of("designated")),
        "closed": ("access", rules.closed | rules.land_work), "private service": ("service", rules.private_service), "alley": ("service", of("alley")),
        "side": ("sidewalk", rules.footway_sides), "side both": ("sidewalk:both", rules.footway_sides), "side left": ("sidewalk:left", rules.footway_sides), "side right": ("sidewalk:right", rules.footway_sides),
        "no side": ("sidewalk", of("no", "none")), "lit": ("lit", None), "unlit": ("lit", of("no")),
        "ford": ("ford", None), "no ford": ("ford", of("no")), "seasonal": ("seasonal", None), "not seasonal": ("seasonal", of("no")),
        "overgrown": ("overgrown", of("yes")), "flooded": ("flooded", of("yes")), "informal": ("informal", of("yes")),
        "abandoned": ("abandoned", of("yes")), "disused": ("disused", of("yes")), "obstacle": ("obstacle", rules.blocking),
        "seen badly": ("trail_visibility", of("bad", "horrible", "no")), "seen partly": ("trail_visibility", of("intermediate")), "seen well": ("trail_visibility", of("excellent", "good")),
        "graded": ("sac_scale", None), "hiking": ("sac_scale", of("hiking")),
        "too rough": ("smoothness", of("horrible", "very_horrible", "impassable")), "rough": ("smoothness", of("bad", "very_bad")),
        "very rough": ("smoothness", of("very_bad")), "smooth": ("smoothness", of("excellent", "good", "intermediate")),
        "worn": ("tracktype", of("grade4", "grade5")), "firm": ("tracktype", of("grade1", "grade2")),
        "hard": ("surface", rules.hard), "soft": ("surface", rules.soft | rules.risky), "risky": ("surface", rules.risky), "forbidden": ("surface", rules.forbidden_surface),
        "named": ("name", None), "nameless": ("name", of("")), "cycled": ("bicycle", of("designated", "yes")),
    }


#: The tags whose text is read, beside those of which only facts are asked.
TEXTS = (*SPEED_TAGS, "highway", "width", "est_width")


def facts(tags: Column, rules: Rules = DEFAULT) -> Column:
    """A bit for each fact about the tags. One look-up per tag in a table of (tag, value), so that the rules are
    tests of bits and their generated code stays small."""
    any_value: dict[str, int] = {}
    by_value: dict[str, dict[str, int]] = {}
    for bit, (tag, values) in enumerate(_facts(rules).values()):
        if values is None:
            any_value[tag] = any_value.get(tag, 0) | 1 << bit
        for value in values or ():
            table = by_value.setdefault(tag, {})
            table[value] = table.get(value, 0) | 1 << bit
    long_map = lambda table: F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for item in sorted(table.items()) for x in item])
    present = long_map(any_value)
    told = F.create_map(*[x for tag, table in sorted(by_value.items()) for x in (F.lit(tag), long_map(table))])
    none = F.lit(0).cast("long")
    of_entry = lambda e: F.coalesce(told[e["key"]][e["value"]], none).bitwiseOR(F.when(e["value"].isNotNull(), F.coalesce(present[e["key"]], none)).otherwise(none))
    return F.aggregate(F.coalesce(F.map_entries(tags), F.array().cast("array<struct<key:string,value:string>>")), none, lambda bits, e: bits.bitwiseOR(of_entry(e)))


def prepared(ways: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """``ways`` (with a map tags) and what the rules look at more than once, each computed once: the facts as
    bits, a few texts as columns, then speed, width, exposure and ground."""
    judge = Judge(rules=rules)
    out = ways.withColumns({"_facts": facts(F.col("tags"), rules), **{_column(k): F.col("tags")[k] for k in TEXTS}})
    out = out.withColumns({"_speed": allowed_speed({k: F.col(_column(k)) for k in SPEED_TAGS}), "_width": judge.width(), "_ground": judge.ground()})
    return out.withColumn("_exposure", judge.exposure())


def unprepared(ways: DataFrame) -> DataFrame:
    return ways.drop("_facts", *map(_column, TEXTS), "_speed", "_width", "_ground", "_exposure")


def _column(tag: str) -> str:
    return "_tag_" + tag.replace(":", "_")


class Judge:
    """The rules as columns over a prepared table; its columns level and marked tell how a way is judged."""

    def __init__(self, rules: Rules = DEFAULT):
        self.rules = rules
        self.level, self.marked = F.col("level"), F.col("marked")
        self.bits = {name: 1 << k for k, name in enumerate(_facts(rules))}

    def _any(self, *names: str) -> Column:
        """Whether one of the facts holds."""
        mask = 0
        for name in names:
            mask |= self.bits[name]
        return F.col("_facts").bitwiseAND(F.lit(mask).cast("long")) != 0

    def _but(self, name: str, other: str) -> Column:
        """Whether the first fact holds and the other doesn't."""
        return F.col("_facts").bitwiseAND(F.lit(self.bits[name] | self.bits[other]).cast("long")) == F.lit(self.bits[name]).cast("long")

    def width(self) -> Column:
        width, other = F.col(_column("width")), F.col(_column("est_width"))
        return lenient_number(F.when(F.coalesce(width != "", F.lit(False)), width).otherwise(other))

    def exposure(self) -> Column:
        """danger, uncertain or null: what a runner risks on a shared road without a space of their own."""
        safe = ~self._any("shared") | self._any("foot designated", "side", "side both", "side left", "side right")
        speed = F.col("_speed")
        return F.when(safe, None).when(speed >= self.rules.danger_speed, "danger").when(speed.isNotNull() | self._but("lit", "unlit"), None).otherwise("uncertain")

    def ground(self) -> Column:
        """Of the ground: hard, soft or unknown."""
        return F.when(self._any("hard", "firm"), "hard").when(self._any("soft"), "soft").otherwise("unknown")

    def kept_up(self) -> Column:
        """A proof of maintenance, which natural paths need at the normal level."""
        return self._any("seen well", "cycled", "smooth") | self._but("named", "nameless") | self._but("lit", "unlit") | F.coalesce(self.marked, F.lit(False))

    def refusal(self) -> Column:
        """The name of the first rule that refuses the way, or null."""
        any_, but = self._any, self._but
        tolerant, strict, normal = (self.level == x for x in ("tolerant", "strict", "normal"))
        unproven = any_("natural") & (F.col("_ground") != "hard")
        ordered = (
            ("highway", ~any_("highway")),
            ("area", any_("area")),
            ("indoor", any_("indoor", "storey")),
            ("foot", any_("foot refused")),
            ("access", but("closed", "foot allowed")),
            ("service", but("private service", "foot invited") & ~tolerant),
            ("danger", (F.coalesce(F.col("_exposure"), F.lit("")) == "danger") & ~tolerant),
            ("ford", but("ford", "no ford")),
            ("overgrown", any_("overgrown")),
            ("seasonal", but("seasonal", "not seasonal")),
            ("flooded", any_("flooded")),
            ("informal", any_("informal")),
            ("abandoned", any_("abandoned", "disused")),
            ("obstacle", any_("obstacle")),
            ("visibility", any_("seen badly") | (strict & any_("seen partly"))),
            ("sac_scale", but("graded", "hiking")),
            ("smoothness", any_("too rough") | (strict & any_("rough")) | (~tolerant & any_("very rough") & any_("natural"))),
            ("tracktype", any_("worn")),
            ("width", F.coalesce(F.col("_width") < self.rules.least_width, F.lit(False))),
            ("surface", any_("forbidden")),
            ("risky_surface", any_("risky") & ~tolerant),
            ("soft_path", unproven & strict),
            ("unproven_path", unproven & normal & ~self.kept_up()),
        )
        return F.coalesce(*[F.when(holds, name) for name, holds in ordered])

    def base_cost(self) -> Column:
        pairs = [F.lit(x) for item in self.rules.base_cost.items() for x in item]
        return F.create_map(*pairs)[F.col(_column("highway"))]

    def cost(self) -> Column:
        """Metres count this many times; below 1 for the best marked trails."""
        quality, shared, exposure, speed = F.col("_ground"), self._any("shared"), F.col("_exposure"), F.col("_speed")
        factors = (
            F.when(quality == "soft", 1.15).when((quality == "unknown") & self._any("natural"), 1.45),
            F.when(self._any("seen well"), 0.90),
            F.when(self._but("named", "nameless") & self._any("natural"), 0.95),
            F.when(self.marked, 0.85),
            F.when(self._any("private service"), 2.0).when(self._any("alley"), 1.3),
            F.when(shared & self._any("no side"), 1.8),
            F.when(shared & (speed >= self.rules.danger_speed), 1.6),
            F.when(shared & (exposure == "danger"), 3.0).when(shared & (exposure == "uncertain"), 1.5),
        )
        out = self.base_cost()
        for factor in factors:
            out = out * F.coalesce(factor, F.lit(1.0))
        return out

    def label(self) -> Column:
        """marked, or the quality of the ground; street where nothing is said of a paved kind of way."""
        quality = F.col("_ground")
        return F.when(self.marked, "marked").when((quality == "unknown") & ~self._any("natural"), "street").otherwise(quality)

    def verdict(self, reason: str) -> Column:
        """Struct of cost, highway and quality, or null if the column ``reason`` has a refusal."""
        kept = F.struct(self.cost().alias("cost"), F.col(_column("highway")).alias("highway"), self.label().alias("quality"))
        return F.when(F.col(reason).isNull(), kept)


def impassable(tags: Column, rules: Rules = DEFAULT) -> Column:
    """Whether a barrier node stops a runner."""
    of = lambda key, values: F.coalesce(tags[key].isin(*sorted(values)), F.lit(False))
    shut = of("foot", ("no", "private")) | of("locked", ("yes",)) | of("access", rules.closed) | of("barrier", rules.barriers)
    return F.coalesce(tags["barrier"] != "", F.lit(False)) & ~of("foot", rules.foot_allowed) & shut
