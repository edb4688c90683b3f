"""Skip edges look past the first number with the same last digits (operator 6)."""

from netvigil.llm import pii


def test_skip_edge_passes_over_a_number_that_only_shares_its_end():
    text = "call 111 123 4567 or +49 222 123 4567 or 222 123 4567 now"
    nodes = pii.mentions(text, pii.base_spans(text))
    assert [n.key for n in nodes] == ["1111234567", "492221234567", "2221234567"]
    assert pii.skip_edges(nodes) == [(1, 2)]


def test_skip_edges_go_to_the_first_of_their_kind():
    text = "333 123 4567; 222 123 4567; 123 4567; 222 123 4567; 9 222 123 4567"
    nodes = pii.mentions(text, [])
    assert pii.skip_edges(nodes) == [(0, 2), (1, 3), (1, 4)]
