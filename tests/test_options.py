"""Option texts: defaults, invalid values, clamping, and the way back."""

import pytest

from wayspan.plans.options import City, ReachQuery

CITIES = {"here": City((52.2, 21.0), (52.3, 21.1), ("bus", "tram")), "there": City((50.0, 19.0), (50.1, 19.1))}


def read(text):
    return ReachQuery.from_params(text, CITIES, "here")


def test_defaults():
    q = read("")
    assert (q.city, q.point, q.point2, q.direction, q.walk, q.mode, q.time_min, q.day) == ("here", (52.2, 21.0), (52.3, 21.1), "from", True, "time", 480, "workday")
    assert not (q.compare or q.stats or q.safe) and q.vehicles == {"bus": True, "tram": True} and q.route_types is None and not q.walk_only
    assert read("?city=there").point == (50.0, 19.0) and read("city=nowhere").city == "here"


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ("p=1.5,-2", "point", (1.5, -2.0)), ("p=1.5", "point", (52.2, 21.0)), ("p=a,b", "point", (52.2, 21.0)), ("p=1,nan", "point", (52.2, 21.0)), ("p=1,inf", "point", (52.2, 21.0)), ("p=1%2C2", "point", (1.0, 2.0)),
        ("dir=to", "direction", "to"), ("dir=TO", "direction", "from"), ("walk=0", "walk", False), ("walk=no", "walk", True), ("mode=general", "mode", "general"), ("mode=x", "mode", "time"),
        ("t=7:05", "time_min", 425), ("t=29:99", "time_min", 1439), ("t=7:5", "time_min", 480), ("t=123:00", "time_min", 480), ("t=", "time_min", 480),
        ("day=sunday", "day", "sunday"), ("day=monday", "day", "workday"), ("cmp=1", "compare", True), ("cmp=true", "compare", False), ("st=1", "stats", True), ("safe=1", "safe", True),
        ("veh=tram,ship", "vehicles", {"bus": False, "tram": True}), ("veh=", "vehicles", {"bus": False, "tram": False}), ("t=8:00&t=9:00", "time_min", 480),
    ],
)
def test_values(text, name, value):
    assert getattr(read(text), name) == value


def test_vehicles():
    assert read("veh=tram").route_types == (0, 900) and read("veh=").walk_only


def test_way_back():
    assert read("").to_params() == "city=here&p=52.20000%2C21.00000&dir=from&walk=1&mode=time&t=08%3A00&day=workday"
    assert read("mode=general&st=1&safe=1&veh=bus").to_params() == "city=here&p=52.20000%2C21.00000&dir=from&walk=1&mode=general&st=1&safe=1&veh=bus"
    assert read("cmp=1&st=1&t=5:09").to_params() == "city=here&p=52.20000%2C21.00000&cmp=1&p2=52.30000%2C21.10000&dir=from&walk=1&mode=time&t=05%3A09&day=workday"
    for text in ("city=there&p=1,2&cmp=1&p2=3,4&dir=to&walk=0&t=23:59&day=saturday&veh=metro", "mode=general", "safe=1&st=1&veh="):
        q = read(text)
        again = read(q.to_params())
        assert again.to_params() == q.to_params() and (again.point, again.vehicles, again.time_min) == (q.point, q.vehicles, q.time_min)
