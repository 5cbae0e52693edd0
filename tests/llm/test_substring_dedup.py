import hashlib
import random
import re

import pytest

from gridloom.llm.substring_dedup import remove_repeats, repeated_spans


def brute(rows, size):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][a : a + size]), i)
    out = {}
    for i, w in words.items():
        kept = [True] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                kept[a : a + size] = [False] * size
        left = " ".join(x for x, k in zip(w, kept, strict=True) if k)
        out[i] = (len(w), kept.count(False), hashlib.sha256(left.encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([3, 50, 400]))]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(4, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice([" ", "\n", "  \t", "  "]).join(parts)))
    rows += [(n, rows[3][1]), (n + 1, ""), (n + 2, None), (n + 3, " \n "), (n + 4, "x " * 3000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(docs, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs(rows), window=12, anchor=5).collect()}
    assert got == brute(rows, 12)


def test_a_passage_of_every_document_is_kept_once(docs):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs(rows)).collect()}
    assert got == {i: 60 * (i > 0) for i in range(300)}


def test_spans_are_long_and_name_their_source(docs):
    passage = " ".join(f"p{k}" for k in range(100))
    _, _, spans = repeated_spans(docs([(1, f"x {passage}"), (2, f"y y {passage} z")]))
    row = spans.first()
    assert spans.count() == 1 and (row["doc_id"], row["start"], row["n"], row["src"], row["src_start"]) == (2, 2, 100, 1, 1)


def test_null_and_repeated_ids(docs):
    text = " ".join(f"p{k}" for k in range(70))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(docs([(None, text), (5, text), (5, text), (5, text + " q"), (9, text)])).collect())
    # rows of one id do not remove each other's words, and a null id is nobody's source and loses nothing
    assert got == [(False, 5, 0), (False, 5, 0), (False, 5, 0), (False, 9, 70), (True, 0, 0)]


def test_an_empty_table(docs):
    assert remove_repeats(docs([])).count() == 0
