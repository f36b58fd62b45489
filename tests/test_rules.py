import pytest

from samewise.plans.rules import Condition, all_of, any_of, ed, from_rows, from_tuples, js, parse_rule


def test_dnf_distributes():
    r = (js("a", 0.5) | ed("b", 1)) & (js("c", 0.7) | ed("d", 2))
    assert [[c.left for c in b] for b in r.blocks] == [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]


def test_same_attribute_twice_and_repeats():
    r = js("a", 0.5) & ed("a", 2) & js("a", 0.5)
    assert len(r.blocks) == 1 and len(r.blocks[0]) == 2
    assert (r | r).blocks == r.blocks


def test_forms_agree():
    want = (js("a", 0.8) & js("b", 0.7)) | (js("c", 0.7) & ed("a", 2))
    assert parse_rule("a|JS|0.8,b|js|0.7; c|JS|.7, a|ED|2") == want
    assert from_tuples([[("a", "a", "JS", 0.8), ("b", "b", "JS", 0.7)], [("c", "c", "JS", 0.7), ("a", "a", "ED", 2.0)]]) == want
    rows = [dict(and_block=b, attr_name=n, rule_type=t, threshold=x) for b, n, t, x in ((2, "c", "JS", 0.7), (1, "a", "JS", 0.8), (1, "b", "JS", 0.7), (2, "a", "ED", 2.0))]
    assert from_rows(rows) == want
    assert any_of([all_of([js("a", 0.8), js("b", 0.7)]), all_of([js("c", 0.7), ed("a", 2)])]) == want


@pytest.mark.parametrize(("kind", "t"), [("XX", 0.5), ("JS", 0.0), ("JS", 1.1), ("ED", -1)])
def test_refuses(kind, t):
    with pytest.raises(ValueError):
        Condition("a", kind, t, "a")
