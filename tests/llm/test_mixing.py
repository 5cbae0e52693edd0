import random
import re

import numpy as np
import pytest

from gridloom.llm.mixing import fill, mixed, take


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size."""
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed=0, n=400):
    r = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "", "zz"]
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, r.randint(1, 300)])), r.choice(sources if r.random() < 0.6 else ["a"])) for i in range(n)] + [(n, None, "a"), (n + 1, "w " * 5000, "b")]


@pytest.mark.parametrize("seed", range(3))
def test_sources_meet_their_targets(docs, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: r for r in take(docs(rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in order}
    want = dict(zip(order, targets(list(sizes.values()), [1 + k % 3 for k in range(len(order))], 3), strict=True))
    assert np.isclose(sum(want.values()), sum(sizes.values()))
    taken = dict.fromkeys(order, 0)
    for i, t, s in rows:
        r = got[i]
        assert r["size"] == size(t) and r["source_size"] == sizes[s] and np.isclose(r["target"], want[s])
        assert r["taken"] in {k * size(t) for k in range(4)}
        taken[s] += r["taken"]
    for s in order:
        # near, or nothing that still fits is left
        gap = want[s] - taken[s]
        fits = [i for i, t, x in rows if x == s and 0 < size(t) <= gap - 0.5 and got[i]["taken"] < 3 * size(t)]
        assert -0.5 <= gap and (gap <= max(3, 0.01 * want[s]) or not fits), (s, taken[s], want[s])
    again = {r["doc_id"]: r["taken"] for r in take(docs(rows[::-1]).repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_targets_stop_at_three_times_the_source():
    got = targets([10, 1000, 5], [1, 2, 3], 3)
    assert got == [30, 970, 15]
    assert targets([0, 0], [1, 2], 3) == [0, 0] and targets([], [], 3) == []
    assert np.isclose(sum(targets([5, 7, 1, 90], [1, 2, 3, 1], 3)), 103)


@pytest.mark.parametrize("seed", range(20))
def test_budgets_are_filled_to_the_word_where_that_is_possible(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, 6))
    counts = rng.integers(1, 5, len(lengths))
    budget = int(rng.integers(0, (lengths * counts).sum() + 5))
    got = fill(lengths, counts, budget)
    assert (got >= 0).all() and (got <= counts).all()
    reachable = {0}
    for length, n in zip(lengths, counts, strict=True):
        reachable = {s + k * int(length) for s in reachable for k in range(int(n) + 1)}
    assert int((got * lengths).sum()) == max(s for s in reachable if s <= budget)


@pytest.mark.parametrize("seed", range(12))
def test_long_documents_fill_a_budget_as_well_as_any_choice(seed):
    """Lengths beyond a million words against all sums there are."""
    rng = np.random.default_rng(seed)
    lengths = np.unique(np.append(rng.integers(1_000_000, 4_000_000, 5), rng.integers(1, 9, 1)))
    counts = rng.integers(1, 4, len(lengths))
    budget = int(rng.integers(1, (lengths * counts).sum()))
    got = fill(lengths, counts, budget)
    reachable = {0}
    for length, n in zip(lengths, counts, strict=True):
        reachable = {s + k * int(length) for s in reachable for k in range(int(n) + 1)}
    assert (got >= 0).all() and (got <= counts).all() and int((got * lengths).sum()) == max(s for s in reachable if s <= budget)


@pytest.mark.parametrize(
    ("lengths", "counts", "budget", "best"),
    [([4000001, 2999999], [2, 2], 2999999, 2999999), ([2500003, 1700001, 5], [2, 2, 1], 4200004, 4200004), ([3000001, 3000000], [2, 2], 3000001, 3000001), ([70000, 69999, 3], [10**6, 10**6, 1], 7 * 10**9 + 139999, 7 * 10**9 + 139999), ([10, 20], [10**9, 10**9], 10**9 + 7, 10**9)],
)
def test_budgets_that_long_documents_meet(lengths, counts, budget, best):
    got = fill(np.array(lengths), np.array(counts), budget)
    assert (got <= counts).all() and sum(int(a) * b for a, b in zip(got, lengths, strict=True)) == best


def test_huge_lengths_and_counts():
    lengths, counts = np.array([1, 7, 10**6, 3 * 10**8]), np.array([10**12, 10**10, 5, 3])
    total = int((lengths * counts).sum())
    for budget in (total // 3, total - 1, 10**9):
        got = fill(lengths, counts, budget)
        assert (got <= counts).all() and (1 - 1e-6) * budget <= int((got * lengths).sum()) <= budget


def test_rows_appear_as_often_as_they_are_taken(docs):
    rows = corpus(5, 150)
    df = docs(rows)
    want = {r["doc_id"]: r["copies"] for r in take(df).collect()}
    out = mixed(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: k for i, k in want.items() if k}


def test_odd_tables(docs):
    assert take(docs([])).count() == 0 and mixed(docs([])).count() == 0
    got = take(docs([(None, "a b", None), (1, "", None), (2, "c", "x"), (2, "c", "x")])).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) <= 12
    assert all(r["taken"] == 0 for r in take(docs([(1, None, "a"), (2, " ", None)])).collect())
