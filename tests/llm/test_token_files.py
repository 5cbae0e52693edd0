import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridloom.llm import tokens  # noqa: E402
from gridloom.llm.packing import pack, packed, solve  # noqa: E402
from gridloom.llm.token_files import _local, read_tokens, write_tokens  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|> <|endoftext", "|> x <| endoftext |>", "", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "Ġx Ġ", "don't stop", "x<|endoftext|> y", "  z", "tab\t b", "a\u00a0 b", "x\u2003 y", "é è  ê\n\n z ", "a\x1c b", "\x85 b q", "日本 語 です", "a" * 50_000, "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def corpus(seed=0, n=200):
    r = random.Random(seed)
    alphabet = "abcdefghij éèß  \n.,!?'0123"
    return [(i, "".join(r.choices(alphabet, k=r.choice([0, 5, 50, 3000, 12_000])))) for i in range(n)] + list(enumerate(ODD, 10_000))


def test_cached_pieces_give_the_library_s_ids(library, monkeypatch):
    code = tokens.Encoder(VOCABULARY)
    texts = [t for _, t in corpus(1, 60)]
    for most in (700_000, 50):  # a cache that is emptied again and again
        monkeypatch.setattr(tokens, "_MOST", most)
        for _ in range(2):
            ids, counts = code.encode_column(pa.array(texts, pa.string()))
            at = np.append(0, np.cumsum(counts))
            for k, t in enumerate(texts):
                assert ids[at[k] : at[k + 1]].tolist() == library(t), t
    assert code.encode_column(pa.array([], pa.string()))[1].tolist() == []


def test_files_give_back_every_document(spark, docs, library):
    rows = corpus(2)
    random.Random(1).shuffle(rows)
    folder = write_tokens(docs(rows).repartition(5), VOCABULARY, partitions=4)
    got = sorted(tuple(r) for r in read_tokens(spark, folder).collect())
    want, start = [], 0
    for i, t in sorted(rows):
        ids = library(t) + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    names = os.listdir(_local(folder))
    assert sum(n.endswith(".ids") for n in names) == 4 and not any(n.startswith(".") for n in names)
    size = sum(os.path.getsize(os.path.join(_local(folder), n)) for n in names if n.endswith(".ids"))
    assert size == 2 * start  # sixteen bits suffice for this vocabulary


def test_files_of_odd_tables(spark, docs):
    assert read_tokens(spark, write_tokens(docs([]), VOCABULARY)).count() == 0
    repeated = read_tokens(spark, write_tokens(docs([(1, "b"), (1, "a"), (1, "a"), (0, None)]), VOCABULARY)).collect()
    assert sorted(r["start"] for r in repeated) == [0, 1, 3, 5]
    with pytest.raises(Exception, match="without an id"):
        write_tokens(docs([(None, "a")]), VOCABULARY)


def test_damaged_files_are_noticed(spark, docs):
    folder = write_tokens(docs([(1, "some text")]), VOCABULARY)
    name = next(n for n in os.listdir(_local(folder)) if n.endswith(".ids"))
    with open(os.path.join(_local(folder), name), "ab") as f:
        f.write(b"xx")
    with pytest.raises(Exception, match="not what its index says"):
        read_tokens(spark, folder).collect()


def bound(lengths, capacity):
    """A number of sequences that no packing can do without."""
    lengths = np.asarray(lengths)
    best = -(-int(lengths.sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        large, middle, small = lengths[lengths > capacity - k], lengths[(lengths <= capacity - k) & (lengths > capacity / 2)], lengths[(lengths <= capacity / 2) & (lengths >= k)]
        free = len(middle) * capacity - int(middle.sum())
        best = max(best, len(large) + len(middle) + max(0, -(-(int(small.sum()) - free) // capacity)))
    return best


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_fill_sequences_without_gaps(docs, library, capacity):
    rows = corpus(3, 120)
    got = packed(docs(rows).repartition(3), VOCABULARY, capacity=capacity).collect()
    ids = {i: library(t) + [0] for i, t in rows}
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(found)):
            assert (piece, start) == (k, at) and (k == 0 or length == capacity)
            at += length
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.02 * bound([r["length"] for r in got], capacity) + 1


def test_packing_odd_tables(docs):
    assert packed(docs([]), VOCABULARY).count() == 0
    got = packed(docs([(None, None), (1, "a b"), (1, "a b"), (2, "")]), VOCABULARY).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 3, 3] and len({r["sequence_id"] for r in got}) == 1
    assert sorted(r["offset"] for r in got) == sorted({r["offset"] for r in got})


def best_fit(counts: np.ndarray, capacity: int) -> list:
    """Best fit decreasing over a histogram: equal pieces and equal sequences move together."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    open_at = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(counts[length - 1])
        while left:
            at = int(open_at[length:].argmax()) + length
            if open_at[at]:
                pattern, n = room[at][-1]
                used = min(n, left)
                room[at][-1][1] -= used
                if room[at][-1][1] == 0:
                    room[at].pop()
                    open_at[at] = bool(room[at])
                room[at - length].append([(*pattern, length), used])
                open_at[at - length] = True
                left -= used
            else:
                each = capacity // length
                n, per = (left // each, each) if left >= each else (1, left)
                room[capacity - per * length].append([(length,) * per, n])
                open_at[capacity - per * length] = True
                left -= n * per
    return [(p, n) for group in room for p, n in group if n]


@pytest.mark.parametrize("seed", range(6))
def test_the_program_is_near_the_bound_and_not_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = [rng.integers(1, 257, 900), rng.integers(60, 120, 900), rng.integers(100, 130, 900), rng.geometric(0.02, 900).clip(1, 256), np.full(500, 128), rng.choice([86, 85, 171], 900)][seed]
    counts = np.bincount(lengths, minlength=capacity + 1)[1:]
    patterns = pack(counts, capacity)
    found = np.zeros(capacity, np.int64)
    for pattern, n in patterns:
        assert sum(pattern) <= capacity and n > 0
        np.add.at(found, np.array(pattern) - 1, n)
    assert (found == counts).all()
    used = sum(n for _, n in patterns)
    assert used <= sum(n for _, n in best_fit(counts, capacity))
    if seed in (0, 3, 4):  # where that bound is near the truth
        assert used <= 1.03 * bound(lengths, capacity) + 1


def test_hot_lengths_keep_the_table_of_patterns_small():
    counts = np.zeros(64, np.int64)
    counts[[63, 31, 15, 4]] = [10**9, 10**9, 3 * 10**8, 7]
    patterns = pack(counts, 64)
    assert len(patterns) < 30 and sum(n for _, n in patterns) >= 15 * 10**8


def optimum(lengths, capacity):
    """The least number of sequences, by trying all of them."""
    lengths, least = sorted(lengths, reverse=True), len(lengths)

    def place(k, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if k == len(lengths):
            least = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            at = rooms.index(room)
            place(k + 1, [*rooms[:at], room - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return least


def test_small_cases_are_optimal():
    for seed in range(150):
        rng = np.random.default_rng(seed)
        capacity = int(rng.choice([12, 20, 50, 100]))
        lengths = rng.integers(int(rng.integers(1, max(2, capacity // 3))), capacity + 1 if seed % 2 else capacity // 2 + 2, int(rng.integers(1, 12))).clip(1, capacity)
        program = solve(np.bincount(lengths, minlength=capacity + 1)[1:], capacity)
        assert program.sequences == (best := optimum(lengths.tolist(), capacity))
        assert program.bound <= min(best, program.value) + 1e-6


@pytest.mark.parametrize(("lengths", "most", "gap"), [([683, 682, 690, 500, 341, 1024, 1025], 0.975, 0.04), (range(300, 901), 0.99, 0.02), (range(600, 1100), 0.985, 0.085), (range(1, 400), 1.0, 0.0005)])
def test_the_program_beats_best_fit_where_pieces_are_large(lengths, most, gap):
    counts = np.bincount(np.random.default_rng(0).choice(list(lengths), 20_000), minlength=2049)[1:]
    program = solve(counts, 2048)
    assert program.sequences <= most * sum(n for _, n in best_fit(counts, 2048)) and program.gap <= gap
    assert program.bound - 1e-6 <= program.value <= program.sequences + 1e-6 and program.sequences <= program.value + 10


def test_the_histograms_of_the_tables_pack_to_the_bound():
    import pyarrow.dataset as ds

    code = tokens.Encoder(VOCABULARY)
    for sf, near in (("sf0.001", 0), ("sf0.01", 0), ("sf0.1", 1)):
        text = ds.dataset(f"/root/testdata/{sf}/documents.parquet").to_table(columns=["text"]).column("text").combine_chunks()
        n = code.encode_column(text)[1] + 1
        pieces = np.concatenate([(n - 1) % 2048 + 1, np.full(int(((n - 1) // 2048).sum()), 2048)])
        program = solve(np.bincount(pieces, minlength=2049)[1:], 2048)
        assert program.sequences <= -(-int(pieces.sum()) // 2048) + near
        assert program.sequences <= sum(k for _, k in best_fit(np.bincount(pieces, minlength=2049)[1:], 2048))
