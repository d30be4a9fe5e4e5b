"""Definitions: no Spark job runs here."""

import pytest

import caseloom as cl
from caseloom.errors import AlreadyDefinedEntityError, AttributeValidationError, IncompatibleEntityError, UndefinedEntityError
from caseloom.values import fixed
from caseloom import protocol


# How an orchard's flow may know an entity, and with which other ones it varies or is computed.
ALONE = ("declared", "one", "several", "derived", "attached")
TOGETHER = {"pair member": "slope", "output": "crates"}
NAMES = {"declared": "fruit", "one": "year", "several": "trees", "derived": "harvest", "attached": "yield", "pair member": "soil", "output": "bushels"}


@pytest.fixture
def orchard():
    b = cl.FlowBuilder("orchard")
    for n in ("fruit", "soil", "slope", "yield"):
        b.declare(n)
    b.assign("year", 1987)
    b.assign("trees", values=[120, 80])
    b.add_case("soil", "loam", "slope", 7)
    b.add_case("soil", "clay", "slope", 0).then_set("yield", 2.5)

    @b
    def harvest(trees, year):
        return trees * year

    @b
    @cl.outputs("bushels", "crates")
    def _(harvest):
        return harvest // 40, harvest // 12

    return b


def values(b, name):
    d = b._state.get(name)
    return [v.value for v in b._state.groups[d.group].values_of(name)] if d.group is not None else None


def outcome(act):
    """The error's type, or None."""
    try:
        act()
    except Exception as e:
        return type(e)
    return None


@pytest.mark.parametrize("kind", NAMES)
def test_each_kind_by_the_rule(orchard, kind):
    """What varies or is computed together stays together; what is derived or attached has no cases of its own."""
    b, name, apart = orchard, NAMES[kind], kind in ALONE
    before = b._state
    assert outcome(lambda: b.declare(name)) == outcome(lambda: b.assign(name, 5)) == AlreadyDefinedEntityError
    may_have_cases = kind in ("declared", "one", "several")
    assert outcome(lambda: b.add_case(name, "new")) == (None if may_have_cases else IncompatibleEntityError)
    if may_have_cases:
        old = {"declared": [], "one": [1987], "several": [120, 80]}[kind]
        assert values(b, name) == [*old, "new"]
        assert outcome(lambda: b.add_case(name, "new")) == IncompatibleEntityError
        b._state = before
    case = b.add_case("trees", 9)
    assert outcome(lambda: case.then_set(name, "x")) == (None if kind == "declared" else IncompatibleEntityError)
    b._state = before
    for act in (lambda: b.set(name, "apple"), lambda: b.set(name, values=["apple", "pear"]), lambda: b.clear_cases(name)):
        assert outcome(act) == (None if apart else IncompatibleEntityError)
        assert values(b, name) in ([None, ["apple"], ["apple", "pear"]] if apart else [values(b, name)])
        b._state = before
    # An output may go alone, a member of a pair of cases may not.
    assert outcome(lambda: b.delete(name)) == (IncompatibleEntityError if kind == "pair member" else None)
    b._state = before
    if not apart:
        both = (name, TOGETHER[kind])
        b.clear_cases(*both)
        assert all(b._state.get(n).is_declared_only for n in both)
        assert outcome(lambda: b.delete(*both)) is None and not set(both) & set(b._state.entities)


def test_unknown_names(orchard):
    b = orchard
    case = b.add_case("trees", 3)
    for act in (lambda: b.set("bark", 1), lambda: b.add_case("bark", 1), lambda: b.delete("bark"), lambda: b.clear_cases("bark"), lambda: case.then_set("bark", 1)):
        assert outcome(act) == UndefinedEntityError


def test_one_value_or_several(orchard):
    for act in (lambda: orchard.assign("pest"), lambda: orchard.assign("pest", 1, values=[2]), lambda: orchard.set("year"), lambda: orchard.add_case("fruit"), lambda: orchard.add_case()):
        assert outcome(act) == ValueError
    assert outcome(lambda: orchard.assign("pest", values=["moth", "moth"])) == IncompatibleEntityError and "pest" not in orchard._state.entities
    orchard.assign("pest", values=["moth", "mite"])
    orchard.set("pest", values=[])
    assert orchard._state.get("pest").is_declared_only


def test_cases_name_their_whole_group(orchard):
    b = orchard
    b.add_case("slope", 3, "soil", "loam")  # in any order
    assert values(b, "slope") == [7, 0, 3]
    for bad in (("soil", "sand"), ("soil", "loam", "slope", 7), ("soil", "sand", "slope", 1, "fruit", "fig"), ("soil", "sand", "fruit", "fig"), ("fruit", "fig", "year", 1999)):
        assert outcome(lambda bad=bad: b.add_case(*bad)) == IncompatibleEntityError
    assert outcome(lambda: b.add_case("soil", 1, "soil", 2)) == ValueError
    again = b.add_case("soil", "sand", "slope", 1)
    again.then_set("yield", 1.5)
    assert outcome(lambda: again.then_set("yield", 1.5)) == IncompatibleEntityError
    assert [v.value for _, v in b._state.get("yield").attached[1]] == [2.5, 1.5]


def test_what_is_built_is_whole(orchard):
    orchard.build()
    orchard.delete("year")
    assert outcome(orchard.build) == UndefinedEntityError
    ring = cl.FlowBuilder("ring")
    ring(cl.output("seed")(lambda tree: tree))
    assert outcome(ring.build) == UndefinedEntityError
    ring(cl.output("tree")(lambda seed: seed))
    with pytest.raises(ValueError, match="circular"):
        ring.build()


def test_functions_and_their_decorators(orchard):
    def weight(trees):
        return trees * 8

    assert orchard(weight) is weight
    with pytest.raises(TypeError):
        orchard(lambda *trees: 1)
    for wrap in (cl.gather("trees", into="rows"), cl.docs("a tree", "a bush")):
        with pytest.raises(ValueError):
            orchard(wrap(lambda gather_df: 1))
    assert outcome(lambda: cl.persist(True)(cl.persist(False)(weight))) == AttributeValidationError
    assert outcome(lambda: cl.version(1)(cl.version(2)(lambda: 1))) == ValueError


def test_key_spaces(orchard):
    orchard(cl.output("all_trees")(cl.gather("trees", "harvest")(lambda gather_df, soil: 1)))
    state = orchard.build()._state
    from caseloom.plans.evaluate import Evaluator

    wanted = {"harvest": {"trees", "year"}, "crates": {"trees", "year"}, "soil": {"soil", "slope"}, "yield": {"soil", "slope"}, "all_trees": {"year", "soil", "slope"}, "fruit": {"fruit"}}
    assert {n: set(Evaluator(None, state, None).keys_of(n)) for n in wanted} == wanted


def test_tokens_tell_types_apart():
    codec = protocol.picklable()
    tokens = [fixed(v, codec).token for v in (1, "1", 1.0, True, b"1", [1], (1,), "a/b", "A/b", "x" * 100, "x" * 101)]
    assert len(set(tokens)) == len(tokens)
    assert fixed({1, 2, 3}, protocol.sets()).token == fixed({3, 2, 1}, protocol.sets()).token


# Ways in which a flow may know "fuel", some of them together with "price".
KINDS = ("absent", "declared", "one value", "two values", "derived", "derived pair", "case pair")


def knowing(kind, name):
    b = cl.FlowBuilder(name)
    if kind == "declared":
        b.declare("fuel")
    elif kind == "one value":
        b.assign("fuel", "coal")
    elif kind == "two values":
        b.assign("fuel", values=["gas", "oil"])
    elif kind == "derived":
        b(cl.output("fuel")(lambda: "peat"))
    elif kind == "derived pair":
        b(cl.outputs("fuel", "price")(lambda: ("wood", 12)))
    elif kind == "case pair":
        b.declare("fuel")
        b.declare("price")
        b.add_case("fuel", "wind", "price", 0)
    return b


def merged(old, new, keep):
    """The side whose "fuel" must stay, or the error: what is absent or only declared gives way, then ``keep``
    decides; and entities that vary together stay or go together."""
    weak = ("absent", "declared")
    if new in weak:
        side = "new" if old == "absent" else "old"
    elif old in weak:
        side = "new"
    elif keep == "error":
        return ValueError
    else:
        side = keep
    # "price" goes by the same rule; it is in a pair alone where the other side does not know it.
    loser = old if side == "new" else new
    if loser.endswith("pair"):
        other = new if side == "new" else old
        if not other.endswith("pair") and other not in weak:
            return IncompatibleEntityError
    return side


@pytest.mark.parametrize("keep", ["error", "old", "new"])
@pytest.mark.parametrize("old", KINDS)
@pytest.mark.parametrize("new", KINDS)
def test_merge_outcomes(keep, old, new):
    a, b = knowing(old, "here"), knowing(new, "there")
    mine, theirs = a._state.entities.get("fuel"), b._state.entities.get("fuel")
    wanted = merged(old, new, keep)
    if isinstance(wanted, type):
        with pytest.raises(wanted):
            a.merge(b.build(), keep=keep)
        assert a._state.entities.get("fuel") is mine
        return
    a.merge(b.build(), keep=keep)
    got, kept = a._state.entities.get("fuel"), mine if wanted == "old" else theirs
    if kept is None:
        assert got is None
    else:
        assert (got.group, got.function and got.function.call) == (kept.group, kept.function and kept.function.call)


def test_merge_names():
    a, b = cl.FlowBuilder("same"), cl.FlowBuilder("same")
    with pytest.raises(ValueError):
        a.merge(b.build())
    a.merge(b.build(), allow_name_match=True)
    c = cl.FlowBuilder("other")
    a.merge(c.build())
    assert a.build().name == "same"
    with pytest.raises(ValueError):
        a.merge(c.build(), keep="both")
