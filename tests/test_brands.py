import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mailsieve.functions import text
from mailsieve.operators import brands


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_segments_find_every_near_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 12)))

    def edited(w):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("abcde") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abcde") + w[k + 1 :]])
        return w

    targets = sorted({word() for _ in range(40)})
    cores = sorted({edited(rng.choice(targets)) for _ in range(600)} | {""})
    known = spark.createDataFrame(list(enumerate(targets)), "brand_id int, target string")
    got = {(r.core, r.target, r.distance) for r in brands.near_targets(spark.createDataFrame([(c,) for c in cores], "core string"), known).collect()}
    want = {(c, t, d) for c in cores for t in targets if min(len(c), len(t)) >= 5 and 1 <= (d := levenshtein(c, t)) <= 2 and (d == 1 or min(len(c), len(t)) >= 8)}
    assert want and got == want


@settings(max_examples=300, deadline=None)
@given(st.text("abcπ", max_size=8), st.text("abcπ", max_size=8))
def test_alignment_distance_lies_between_its_bounds(a, b):
    d = text.edit_distance(a, b, 20)
    assert d == text.edit_distance(b, a, 20)
    assert levenshtein(a, b) / 2 <= d <= levenshtein(a, b)
    assert (d == 0) == (a == b)
    assert text.edit_distance(a, b, 1) == min(d, 2)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_folding_keeps_the_length(value):
    assert len(text.folded_of(value)) == len(value)
