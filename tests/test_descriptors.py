"""Descriptors: random trees are printed with random spacing and brackets, read back, and broken by small changes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.descriptors import Draft, Group, Name, entity_name, parse
from caseloom.errors import MalformedDescriptorError

NAMES = st.from_regex(r"\A[A-Za-z_][A-Za-z0-9_]{0,6}\Z").map(Name)
TREES = st.recursive(NAMES, lambda inner: st.lists(inner, max_size=4).map(lambda parts: Group(tuple(parts))), max_leaves=8)


def written(node, rnd, top=True):
    """The node as text, with spaces, brackets and last commas that mean nothing."""
    gap = lambda: " " * rnd.randint(0, 2)
    if isinstance(node, Name):
        text = gap() + node.name + gap()
    elif isinstance(node, Draft):
        text = f"{gap()}<{written(node.part, rnd)}>{gap()}"
    elif not node.parts:
        return f"{gap()}({gap()}){gap()}"
    else:
        text = ",".join(written(p, rnd, False) for p in node.parts)
        text += "," + gap() if len(node.parts) == 1 or rnd.random() < 0.3 else ""
        if not top:
            text = f"{gap()}({text}){gap()}"
    return f"({text})" if rnd.random() < 0.2 else text


@settings(max_examples=300, deadline=None)
@given(TREES, st.booleans(), st.randoms(use_true_random=False))
def test_what_is_written_is_read(tree, draft, rnd):
    node = Draft(tree) if draft else tree
    assert parse(written(node, rnd)) == node
    assert parse(str(node)) == node and str(parse(str(node))) == str(node)
    assert node.entities() == tree.entities()


@settings(max_examples=300, deadline=None)
@given(TREES, st.randoms(use_true_random=False), st.sampled_from(["open", "close", "comma", "name", "character", "draft"]))
def test_what_is_broken_is_refused(tree, rnd, how):
    text = str(tree)
    at = rnd.randint(0, len(text))
    broken = {
        "open": "(" + text,
        "close": text + ")",
        "comma": "," + text,
        "name": f"{text} z" if not text.endswith(",") else f"{text},",
        "character": text[:at] + rnd.choice("+-/;:.[]{}'") + text[at:],
        "draft": rnd.choice([f"<{text}", f"{text}>", f"<<{text}>>"]),
    }[how]
    with pytest.raises(MalformedDescriptorError) as e:
        parse(broken)
    assert repr(broken) in str(e.value)


@pytest.mark.parametrize("text", ["", "  ", "<>", "7up", "a<b>", "(<a)>"])
def test_other_texts_are_refused(text):
    with pytest.raises(MalformedDescriptorError):
        parse(text)


def test_random_bytes_never_crash():
    rnd = random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choices("ab ,()<>9_", k=rnd.randint(0, 8)))
        try:
            node = parse(text)
        except MalformedDescriptorError:
            continue
        assert parse(str(node)) == node


@settings(max_examples=100, deadline=None)
@given(NAMES)
def test_entity_names(name):
    assert entity_name(f" {name.name} ") == name.name
    with pytest.raises(ValueError):
        entity_name(f"{name.name},")
