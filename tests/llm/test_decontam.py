"""How many edits of an item are found: all within the budget, against distances by brute force."""

import random

import pytest

from cohortloom.llm import decontam

from .test_operators import edit_distance

WORDS = "the old river runs past seven quiet houses before it turns north and reaches a wide harbour where small boats wait for rain".split()


def edited(text, share, rng):
    out = list(text)
    for _ in range(int(len(out) * share)):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice(([rng.choice("abcxyz ")], [], [out[i], rng.choice("abcxyz ")]))
    return "".join(out)


@pytest.mark.parametrize("share", [0.02, 0.05, 0.08, 0.12])
def test_recall_by_share_of_edits(share):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS, k=k))) for i, k in enumerate((8, 20, 40, 60))]
    matcher = decontam.Matcher(items)
    found = within = 0
    for _ in range(40):
        n, item = rng.choice(items)
        text = decontam.normal("before it " + edited(item, share, rng) + " after it")
        distance = edit_distance(item, text)
        got = {k: d for k, d, _ in matcher.find(text)}
        if distance <= decontam.budget(len(item)):
            assert got.get(n) == distance
            within += 1
        else:
            assert n not in got
        found += n in got
    if share <= decontam.ERROR_RATE:
        assert found == within >= 38  # white space made one may add an edit


def test_runs_of_characters_rule_out_no_item():
    rng = random.Random(1)
    items = [(0, " ".join(rng.choices(WORDS, k=30)))]
    matcher = decontam.Matcher(items)
    for _ in range(100):
        text = edited(items[0][1], rng.choice((0.05, 0.1, 0.2)), rng)
        assert matcher.could_hold(0, text) or edit_distance(items[0][1], text) > decontam.budget(len(items[0][1]))
    assert not matcher.could_hold(0, " ".join(rng.choices(WORDS[:6], k=30)))


def test_budget_is_the_stated_share():
    assert [decontam.budget(n) for n in (0, 15, 16, 100, 284, 1000)] == [0, 0, 1, 8, 22, 80]
