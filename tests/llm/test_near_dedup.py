import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import near_dedup
from gridloom.llm.near_dedup import deduplicated, edit_distance, near_clusters, sketches_of
from gridloom.llm.text import Words


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, share, vocabulary):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        k, at = r.randrange(3), r.randrange(len(out))
        if k == 0:
            out.insert(at, r.choice(vocabulary))
        elif k == 1 and len(out) > 1:
            out.pop(at)
        else:
            out[at] = r.choice(vocabulary)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_the_alignment_is_exact(seed):
    r = random.Random(seed)
    for _ in range(300):
        vocabulary = list(range(1, r.choice([3, 6, 30])))
        a = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        b = edited(r, a, r.random() * 0.3, vocabulary) if a and r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        most, d = r.randint(0, 15), levenshtein(a, b)
        assert edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (d if d <= most else None)


def test_sketches_see_the_order_of_words():
    words = [f"w{k}" for k in range(200)]
    same = sketches_of(Words(pa.array([" ".join(words), "\n".join(words), " ".join(words[100:] + words[:100]), "one two"])), 5, 64)
    assert same[0].tolist() == [0, 1, 2]
    assert (same[1][0] == same[1][1]).all()
    # the same k-mers in another order: about half of the sketches differ
    assert 0.2 < (same[1][0] != same[1][2]).mean() < 0.8


def clusters(rows, threshold=0.8):
    """Brute force over all pairs."""
    words = {i: (t or "").split() for i, t in rows}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            longer = max(len(words[i]), len(words[j]))
            if longer and (words[i] == words[j] or min(len(words[i]), len(words[j])) >= 5 and levenshtein(words[i], words[j]) <= (1 - threshold) * longer + 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(docs, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, bases = [], []
    for i in range(50):
        if bases and r.random() < 0.5:
            rows.append((i, " ".join(edited(r, r.choice(bases), 0.03, vocabulary))))
        else:
            bases.append([r.choice(vocabulary) for _ in range(r.randint(40, 120))])
            rows.append((i, " ".join(bases[-1])))
    rows += [(100, rows[0][1]), (101, ""), (102, None), (103, "  \n"), (104, "one two"), (105, "one  two"), (106, "one three")]
    got = {x["doc_id"]: x["cluster_id"] for x in near_clusters(docs(rows)).collect()}
    assert got == clusters(rows)


def test_a_large_group_of_near_copies_is_one_cluster(docs):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(i, " ".join(edited(r, base, 0.01, vocabulary))) for i in range(400)] + [(1000 + i, " ".join(r.choices(vocabulary, k=150))) for i in range(50)]
    got = {x["doc_id"]: (x["cluster_id"], x["kept"]) for x in near_clusters(docs(rows)).collect()}
    assert all(got[i] == (0, i == 0) for i in range(400)) and all(got[1000 + i] == (1000 + i, True) for i in range(50))


def test_kept_rows_null_and_repeated_ids(docs):
    text = " ".join(f"w{k}" for k in range(50))
    df = docs([(None, text), (None, None), (3, text), (4, text + " more"), (7, "other words"), (7, "other words")])
    kept = deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] or 0) for x in kept.collect()) == [0, 0, 3, 7, 7]
    assert near_clusters(docs([])).count() == 0 and deduplicated(docs([])).count() == 0


def test_every_similar_pair_of_a_bucket_ends_connected(docs, monkeypatch):
    """Scattered edits of one base: pairs lie around the threshold, and few are similar to the least member."""
    monkeypatch.setattr(near_dedup, "_BLOCK", 64, raising=False)
    r = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = [[f"x{i}_{p}" if p in at else w for p, w in enumerate(base)] for i in range(150) for at in [set(r.sample(range(200), 23))]]
    h = [np.array([hash(w) for w in t]) for t in texts]
    have, sketch = sketches_of(Words(pa.array([" ".join(t) for t in texts])), 5, 32)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sketch[i] == sketch[j]).any() and (h[i] != h[j]).sum() <= 40:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {x["doc_id"]: x["cluster_id"] for x in near_clusters(docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert all(got[i] == got[root[i]] for i in got)
    assert len(set(got.values())) <= len(set(root)) < 20


def test_scattered_edits_at_the_threshold_are_found(docs):
    r = random.Random(8)
    rows, want = [], {}
    for words, edits in ((5, 1), (6, 1), (10, 1), (10, 2), (14, 2), (15, 3), (30, 6), (50, 10), (300, 60)):
        for t in range(20):
            base = [f"w{words}_{edits}_{t}_{p}" for p in range(words)]
            at = set(r.sample(range(words), edits))
            i = len(rows)
            rows += [(i, " ".join(base)), (i + 1, " ".join(f"x{p}" if p in at else w for p, w in enumerate(base)))]
            want[i + 1] = i
    got = {x["doc_id"]: x["cluster_id"] for x in near_clusters(docs(rows)).collect()}
    assert {i: got[i] for i in want} == want


@pytest.mark.parametrize("partners", [1, 64])
def test_open_buckets_cost_a_row_a_document_and_a_look_a_pair(docs, monkeypatch, partners):
    """Documents that share many buckets are joined by their ids once, and each pair is given once; held back ones are found too."""
    monkeypatch.setattr(near_dedup, "_PARTNERS", partners, raising=False)
    tables, write, look = [], near_dedup.materialise, near_dedup._may_link

    def written(df, name):
        found = write(df, name)
        tables.append((name, found.count()))
        return found

    monkeypatch.setattr(near_dedup, "materialise", written)
    r = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = [[f"x{i}_{p}" if p in at else w for p, w in enumerate(base)] for i in range(60) for at in [set(r.sample(range(200), 21 if i < 30 else 45))]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x["cluster_id"] for x in near_clusters(docs(rows)).collect()}
    h = [np.array([hash(w) for w in t]) for t in texts]
    buckets = np.concatenate([sketches_of(Words(pa.array([t for _, t in rows])), k, n)[1] for k, n in ((5, 16), (3, 40))], axis=1)
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if (buckets[i] == buckets[j]).any() and (h[i] != h[j]).sum() <= 40:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert all(got[i] == got[root[i]] for i in got)
    assert max(n for name, n in tables if name in ("open-members", "open-rows")) <= 60
    batches = [pa.RecordBatch.from_pydict({"task": [1, 1, 2, 2], "doc_id": [1, 2, 1, 2], "component": [1, 2, 1, 2], "n": [9] * 4, "bucket": [5, 5, 6, 6], "side": [0] * 4, "counted": [bytes(256)] * 4, "buckets": [[6, 5], [5, 6], [6, 5], [5, 6]]})]
    batches += [pa.RecordBatch.from_pydict({"task": [3, 3], "doc_id": [1, 3], "component": [1, 1], "n": [9] * 2, "bucket": [7, 7], "side": [0] * 2, "counted": [bytes(256)] * 2, "buckets": [[7], [7]]})]
    assert [x for b in look(0.8, partners)(batches) for x in b.to_pylist()] == [{"a": 1, "b": 2, "bucket": None}]


def test_words_one_by_one_never_rule_out_a_similar_pair():
    r = random.Random(4)
    for _ in range(20):
        vocabulary = [f"w{k}" for k in range(r.choice([3, 30, 3000]))]
        base = r.choices(vocabulary, k=60)
        texts = [edited(r, base, r.random() * 0.5, vocabulary) for _ in range(12)] + [[]]
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(13)), "text": [" ".join(t) for t in texts]})
        slots = [np.frombuffer(x, np.uint16) for b in near_dedup._slots([batch]) for x in b.column("slots").to_pylist()]
        left, right = (np.array(x) for x in zip(*[(i, j) for i in range(13) for j in range(i + 1, 13)], strict=True))
        apart = np.array([levenshtein(texts[i], texts[j]) for i, j in zip(left, right, strict=True)])
        assert near_dedup._share_enough(slots, left, right, apart).all()
        assert not near_dedup._share_enough(slots, left, right, np.full(len(left), -1)).any()


@pytest.mark.parametrize("seed", range(3))
def test_columns_of_bits_equal_the_plain_distance(seed):
    r = random.Random(seed)
    for _ in range(100):
        vocabulary = list(range(r.choice([2, 6, 30])))
        a, b = ([r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(2))
        most, d = r.randint(0, 60), levenshtein(a, b)
        assert near_dedup._by_columns(a, b, most) == (d if d <= most else None)


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_one_task_and_rounds_find_the_same_components(spark, monkeypatch, small):
    from gridloom.llm import components

    monkeypatch.setattr(components, "_SMALL", small, raising=False)
    r = random.Random(9)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            x, y = sorted((root[a], root[b]))
            root = {i: x if v == y else v for i, v in root.items()}
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["component"] for x in found.collect()} == root
    assert hasattr(found, "_gridloom_path")
