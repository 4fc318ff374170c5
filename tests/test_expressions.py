"""Expression operators on a little harbour: two quays that share some berths."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshset import errors
from meshset.engine import Engine
from meshset.functions.registry import RangeFunction
from meshset.model import EDGES, LATEST, NODES, TAGS, Topology
from meshset.operators import sets, strings
from meshset.plans import syntax as s

NORTH, SOUTH = list("zebra"), list("bravoexy")  # shared: z no; e, b, r, a yes


@pytest.fixture(scope="module")
def engine(spark):
    links = [("north", f"berth.{x}") for x in NORTH] + [("south", f"berth.{x}") for x in SOUTH]
    names = sorted({b for _, b in links})
    nodes = [("primary", n, "CLUSTER", 1, LATEST) for n in ("north", "south")] + [("primary", n, "HOST", 1, LATEST) for n in names]
    edges = [("primary", a, b, k, k, 1, LATEST) for k, (a, b) in enumerate(links)]
    tags = [("primary", n, k, o, v, 1, LATEST) for n, k, o, v in [("south", "ADMIN_NODE", 0, "mate"), ("north", "crane", 0, "tall"), ("north", "crane", 1, "wide"), ("north", "depth", 0, "9")]]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    common = RangeFunction(2, lambda ctx, bags: sets.intersection(*bags))
    return Engine(Topology(make(nodes, NODES), make(edges, EDGES), make(tags, TAGS)), functions={"common": common})


def berths(letters):
    return [f"berth.{x}" for x in sorted(letters)]


#: What an expression gives, in this order.
CASES = {
    "%north,%south": berths(set(NORTH) | set(SOUTH)),
    "%north,-%south": berths("z"),
    "%north,-/[ez]$/": berths("abr"),
    "%north,&%south": berths("aber"),
    "%north,&/[ez]$/": berths("ez"),
    "%north,&!/[ez]$/": berths("abr"),
    "%north,-!/[ez]$/": berths("ez"),
    "%south,&/[[:alpha:]][.][x-z]/": berths("xy"),
    "buoy3..12": [f"buoy{n:02d}" for n in range(3, 13)],
    "buoy08..11": [f"buoy{n:02d}" for n in range(8, 12)],
    "buoy20..7": [f"buoy{n}" for n in range(20, 28)],
    "buoy3..5port": [f"buoy{n}port" for n in range(3, 6)],
    "buoy1..buoy010left": [f"buoy{n:03d}left" for n in range(1, 11)],
    "12..3": [f"{n}" for n in range(12, 16)],
    "*berth.z": ["north"],
    "*berth.a": ["north", "south"],
    "^berth.x": ["mate"],
    "{red,green,red}": ["green", "red"],
    "tug{4,2}boat": ["tug2boat", "tug4boat"],
    "pier{1..3}": ["pier1", "pier2", "pier3"],
    "%{north,south}": berths(set(NORTH) | set(SOUTH)),
    "common(%north; %south)": berths("aber"),
    "north:crane": ["tall", "wide"],
    "north:KEYS": ["crane", "depth"],
    "clusters(berth.v)": ["south"],
    "expand_hosts(north)": berths(NORTH),
    "common(onlyone)": [],
    "common": ["common"],
    "/tide/": ["tide"],
    "'low tide',\"high\"": ["high", "low tide"],
    "has(crane;wide)": ["north"],
    "mem(north;9)": ["depth"],
    "": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_expression(engine, text):
    assert engine.expand_range_expression("", text) == CASES[text]


def test_products(engine):
    got = engine.expand_range_expression("", "(%north){1,2}(%north)")
    assert got == sorted(f"{a}{k}{b}" for a in berths(NORTH) for k in "12" for b in berths(NORTH))


def test_errors(engine):
    with pytest.raises(errors.NodeNotFound):
        engine.expand_range_expression("", "%west")
    for bad in ("%a)", "quay1..3.example.com", "a..b", "x,&/[/", '"open', "1..99999999999"):
        with pytest.raises(errors.InvalidRangeExpression):
            engine.expand_range_expression("", bad)


def test_quotes_in_an_environment(engine):
    """A name is data, whatever it holds."""
    for env in ("o'clock", 'a"b', "back\\slash", "`tick`"):
        assert engine.expand_range_expression(env, "bell") == ["bell"]
        assert engine.expand_range_expression(env, "expand(bell)") == []


def test_tokens_and_trees():
    assert s.tokens('"a \\"b\\" 7"') == [("literal", 'a "b" 7')]
    assert s.tokens(r"/up\/down/") == [("regex", "up/down")]
    assert s.tokens(r"/\w/") == [("regex", "w")]
    assert s.tokens(r"/\w\//", strict_escapes=False) == [("regex", r"\w/")]
    assert [k for k, _ in s.tokens("tug7,-8sail")] == ["word", ",-", "word"]
    assert [k for k, _ in s.tokens("!-&^;:*%(){}")] == list("!-&^;:*%(){}")
    assert s.parse("%{%dock}:TIDE") == s.Expand(s.KeyExpand(s.Brace(s.Null(), s.Expand(s.Word("dock")), s.Null()), "TIDE"))
    assert s.parse("x,y,&z") == s.Intersection(s.Union(s.Word("x"), s.Word("y")), s.Word("z"))
    assert s.parse("North.sea") == s.Word("North.sea")
    assert s.parse("q4..6r") == s.Sequence("q4", "6r")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from("abc")), st.lists(st.sampled_from("abc")))
def test_multiplicities(spark, a, b):
    bag = lambda xs: spark.createDataFrame([(x,) for x in xs], "value string")
    count = lambda df: Counter(r[0] for r in df.collect())
    left, right = Counter(a), Counter(b)
    assert count(sets.union(bag(a), bag(b))) == left | right
    assert count(sets.difference(bag(a), bag(b))) == left - right
    assert count(sets.intersection(bag(a), bag(b))) == left & right


def test_values_with_very_many_copies(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 25_001), ("c", 10_000), ("d", 0)], "value string, times long")
    assert dict(sets.repeated(rows).groupBy("value").count().collect()) == {"a": 3, "b": 25_001, "c": 10_000}


def test_bounds():
    assert strings.bounds("mast8", "31") == ("mast", 8, 31, 2, "")
    assert strings.bounds("700", "44") == ("", 700, 744, 3, "")
