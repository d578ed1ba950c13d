"""Search options as text (`city=..&p=lat,lon&dir=to&t=7:30`): read into a ReachQuery, written back; the same for columns of texts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of day, vehicles and their route types, the last minute of a day.
DAYS = ("workday", "saturday", "sunday")
VEHICLES = {"bus": (3, 11, 700, 800), "tram": (0, 900), "metro": (1,), "train": (2,)}
LAST_MIN = 23 * 60 + 59
TIME = r"^([0-9]{1,2}):([0-9]{2})$"
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@dataclass(frozen=True)
class City:
    """What holds for a city where the text says nothing."""

    point: tuple[float, float]
    point2: tuple[float, float]
    vehicles: tuple[str, ...] = tuple(VEHICLES)


@dataclass(frozen=True)
class ReachQuery:
    """A search: where from or to, when and how."""

    city: str
    point: tuple[float, float]
    point2: tuple[float, float]
    compare: bool = False
    direction: str = "from"
    walk: bool = True
    mode: str = "time"
    time_min: int = 480
    day: str = "workday"
    stats: bool = False
    safe: bool = False
    vehicles: dict[str, bool] = field(default_factory=dict)

    @property
    def route_types(self) -> tuple[int, ...] | None:
        """Route types that may be taken; None: all."""
        if all(self.vehicles.values()):
            return None
        return tuple(t for v, on in self.vehicles.items() if on for t in VEHICLES[v])

    @property
    def walk_only(self) -> bool:
        return not any(self.vehicles.values())

    @classmethod
    def from_params(cls, text: str, cities: dict[str, City], default: str) -> ReachQuery:
        """What is missing or not valid keeps its default; times past 23:59 are cut to it; of repeated names the first counts."""
        given: dict[str, str] = {}
        for name, value in parse_qsl(text.lstrip("?"), keep_blank_values=True):
            given.setdefault(name, value)
        key = given["city"] if given.get("city") in cities else default
        city = cities[key]
        out = cls(key, _point(given.get("p"), city.point), _point(given.get("p2"), city.point2), vehicles=dict.fromkeys(city.vehicles, True))
        time = re.match(TIME, given.get("t", ""), re.ASCII)
        on = given["veh"].split(",") if "veh" in given else list(city.vehicles)
        return replace(
            out,
            compare=given.get("cmp") == "1",
            direction="to" if given.get("dir") == "to" else "from",
            walk=given.get("walk") != "0",
            mode="general" if given.get("mode") == "general" else "time",
            time_min=min(int(time[1]), 23) * 60 + min(int(time[2]), 59) if time else out.time_min,
            day=given["day"] if given.get("day") in DAYS else out.day,
            stats=given.get("st") == "1",
            safe=given.get("safe") == "1",
            vehicles={v: v in on for v in city.vehicles},
        )

    def to_params(self) -> str:
        """The text in its one form: points to five places, times only in the mode with times, vehicles only if some are off."""
        at = lambda p: f"{p[0]:.5f},{p[1]:.5f}"
        parts = [("city", self.city), ("p", at(self.point))]
        parts += [("cmp", "1"), ("p2", at(self.point2))] if self.compare else []
        parts += [("dir", self.direction), ("walk", "1" if self.walk else "0"), ("mode", self.mode)]
        parts += [("t", f"{self.time_min // 60:02d}:{self.time_min % 60:02d}"), ("day", self.day)] if self.mode == "time" else []
        parts += [("st", "1")] if self.stats and not self.compare else []
        parts += [("safe", "1")] if self.safe else []
        on = [v for v, x in self.vehicles.items() if x]
        parts += [("veh", ",".join(on))] if len(on) < len(self.vehicles) else []
        return "&".join(f"{k}={quote(v, safe='')}" for k, v in parts)


def _point(text: str | None, default: tuple[float, float]) -> tuple[float, float]:
    parts = (text or "").split(",")
    if len(parts) != 2 or not all(re.match(NUMBER, x, re.ASCII) for x in parts):
        return default
    point = float(parts[0]), float(parts[1])
    return point if all(map(math.isfinite, point)) else default


def parsed(text: Column, default: City) -> Column:
    """A struct of a text's options (no city list: ``default`` holds for all); names may not be repeated."""
    given = F.str_to_map(F.regexp_replace(text, r"^\?", ""), F.lit("&"), F.lit("="))
    value = lambda k: F.try_url_decode(F.regexp_replace(given[k], r"\+", "%20"))
    one_of = lambda k, known, other: F.when(value(k).isin(*known), value(k)).otherwise(other)
    flag = lambda k: F.coalesce(value(k) == "1", F.lit(False))

    def point(k: str, other: tuple[float, float]) -> Column:
        part = F.split(value(k), ",")
        good = (F.size(part) == 2) & part[0].rlike(NUMBER) & part[1].rlike(NUMBER)
        return F.when(good, F.struct(F.trim(part[0]).try_cast("double").alias("lat"), F.trim(part[1]).try_cast("double").alias("lon"))).otherwise(F.struct(F.lit(other[0]).alias("lat"), F.lit(other[1]).alias("lon")))

    time = lambda i, most: F.least(F.regexp_extract(value("t"), TIME, i).try_cast("int"), F.lit(most))
    minute = F.when(value("t").rlike(TIME), time(1, 23) * 60 + time(2, 59)).otherwise(480)
    on = F.coalesce(F.split(value("veh"), ","), F.array(*map(F.lit, default.vehicles)))
    vehicles = F.filter(F.array(*map(F.lit, default.vehicles)), lambda v: F.array_contains(on, v))
    return F.struct(
        point("p", default.point).alias("p"), point("p2", default.point2).alias("p2"), flag("cmp").alias("compare"), one_of("dir", ["to"], "from").alias("direction"),
        F.coalesce(value("walk") != "0", F.lit(True)).alias("walk"), one_of("mode", ["general"], "time").alias("mode"), minute.alias("time_min"), one_of("day", DAYS, "workday").alias("day"),
        flag("st").alias("stats"), flag("safe").alias("safe"), vehicles.alias("vehicles"),
    )


def written(o: Column, city: Column, default: City) -> Column:
    """The text of a struct as ``parsed`` gives it."""
    at = lambda p: F.format_string("%.5f%%2C%.5f", p["lat"], p["lon"])
    timed = o["mode"] == "time"
    part = lambda met, text: F.when(met, text)
    return F.concat_ws(
        "&",
        F.concat(F.lit("city="), F.url_encode(city)), F.concat(F.lit("p="), at(o["p"])), part(o["compare"], F.concat(F.lit("cmp=1&p2="), at(o["p2"]))),
        F.concat(F.lit("dir="), o["direction"]), F.concat(F.lit("walk="), F.when(o["walk"], "1").otherwise("0")), F.concat(F.lit("mode="), o["mode"]),
        part(timed, F.format_string("t=%02d%%3A%02d&day=%s", F.floor(o["time_min"] / 60), o["time_min"] % 60, o["day"])),
        part(o["stats"] & ~o["compare"], F.lit("st=1")), part(o["safe"], F.lit("safe=1")),
        part(F.size(o["vehicles"]) < len(default.vehicles), F.concat(F.lit("veh="), F.array_join(o["vehicles"], "%2C"))),
    )
