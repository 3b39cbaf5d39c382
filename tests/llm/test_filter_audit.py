"""Filter audits against all orders applied one after the other."""

from itertools import permutations

import pytest

from cohortloom.llm import filter_audit


def fails(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        first = least.get(t)
        out.append((len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum(c.isascii() and c.isupper() for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), first is not None and (i is None or i > first)))
    return out


def brute(rows, labels):
    failed, out = fails(rows), []
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone, stay = [x for x in left if x[1][k]], [x for x in left if not x[1][k]]
                row = [part, "".join("ABCDE"[i] for i in order), step, len(stay), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                out.append(row)
                left = stay
    return out


def made():
    long = " ".join(f"word{i}" for i in range(210))
    texts = [None, "", long, long + " $", long.upper(), "same " * 220, "SAME " * 220, "a\tb c\nd", "É É", long + "\x85x", "one # two", long]
    rows = [(i % 9 if i % 7 else None, t, ("en", "de", None, "")[i % 4], 0) for i, t in enumerate(texts * 4)]
    rows += [(100, long, "en", 0), (100, long, "en", 0), (50, "only", "fr", 0)]
    labels = [(0, 1, 0), (1, 0, 1), (2, None, None), (1, 1, None), (None, 1, 1), (100, 1, 1), (50, 0, 0)]
    return rows, labels


def test_audit_against_orders_applied(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int").repartition(3)
    counts = filter_audit.mask_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(counts).collect()
    want = {tuple(r[:3]): r for r in brute(rows, labels)}
    assert len(got) == 4 * 600
    for r in got:
        total = sum(x[4] for x in want.values() if x[0] == r["part"] and x[1][x[2] - 1] == r["filter_order"][r["step"] - 1])
        assert tuple(r) == (*want[tuple(r)[:3]], total)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_swaps_reach_every_order_once(size):
    order, seen = list(range(size)), [tuple(range(size))]
    for i in filter_audit.neighbour_swaps(size):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) and set(seen) == set(permutations(range(size)))


def test_diagram_after_swaps_is_the_diagram_of_that_order():
    counts = {0: (5, 1), 3: (2, 0), 6: (2, 0), 7: (9, 4)}
    d = filter_audit.Diagram(counts, 3)
    assert all(len(set(level)) == len(level) for level in d.levels)
    for i in (0, 1, 0):
        d.swap(i)
    assert d.order == [2, 1, 0]
    turned = {sum(1 << 2 - b for b in range(3) if m >> b & 1): c for m, c in counts.items()}
    other = filter_audit.Diagram(turned, 3)
    assert [len(x) for x in d.levels] == [len(x) for x in other.levels]
    assert [x[1:] for x in d.steps()] == [x[1:] for x in other.steps()]


def test_no_documents(spark):
    none = filter_audit.mask_counts(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.audit(none).count() == 0
