from __future__ import annotations

from hypothesis import given, settings, strategies as st

from gridcast.llm.edits import bounded, distance

WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


def table(a, b):
    """All distances from prefixes of a to prefixes of b, the plain way."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS, st.integers(0, 14))
def test_distance_equals_the_plain_table(a, b, most):
    d = table(a, b)
    assert distance(a, b) == d[-1][-1]
    assert distance(a, b, free_end=True) == min(d[-1])
    assert bounded(a, b, most) == (d[-1][-1] if d[-1][-1] <= most else None)
    assert bounded(a, b, most, free_end=True) == (min(d[-1]) if min(d[-1]) <= most else None)
