import hashlib
import itertools
import random
import time

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm.bpe import Encoder, Lanes, Merges, Prefixes, bpe_round_trip, rank_file, split_pattern
from quern.llm.mtree import MTree, top_k

from .cases import empty, odd, odd_rows


def brute(rows, queries, k=5):
    """Sorted answers; every row is a candidate, and the vectors of one query id share its ranks."""
    found = {}
    for qid, q in dict.fromkeys((i, tuple(v)) for i, v in queries):
        found.setdefault(qid, []).extend((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid and len(v) == len(q))
    return sorted((qid, n, i, -s) for qid, scored in found.items() for n, (s, i) in enumerate(sorted(scored)[:k], 1))


def floors(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, [0.0] * 8), (401, [1.0] * 3), (402, [2.0] * 3)]
    bad = [(500, None), (501, [None] + [1.0] * 7), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (None, rows[0][1])]
    rows += [rows[7]] * 3 + [rows[50], (50, rows[3][1]), (100, rows[100][1])]  # repeated rows, and an id with two vectors
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    df = df.select("*", *(F.lit(-1).alias(c) for c in ("id", "v", "block", "length", "asks", "number", "most", "score", "rank", "query_id")))
    whole = [(i, floors(v)) for i, v in rows]
    want = brute(whole, [(i, v) for i, v in whole if i % 50 == 0 or i == 401])
    for block in (24_000, 50):
        got = top_k(df, df.where("vec_id % 50 = 0 or vec_id = 401"), rows_per_block=block)
        assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == want
    assert top_k(df.limit(0), df.limit(0)).collect() == []
    assert top_k(df, df.limit(0)).collect() == [] and top_k(df.limit(0), df).collect() == []


def test_large_components(spark):
    df = spark.createDataFrame([(0, [2.0**21, -3.0]), (1, [2.0**22 + 0.5, 1.0]), (2, [-(2.0**22), 7.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in top_k(df, df).collect()}
    whole = {0: (2**29, -768), 1: (2**30 + 128, 256), 2: (-(2**30), 1792)}
    assert got == {(i, j): a[0] * b[0] + a[1] * b[1] for i, a in whole.items() for j, b in whole.items() if i != j}
    for huge in (1e30, 2.0**24):
        both = df.unionByName(spark.createDataFrame([(5, [huge, huge])], "vec_id long, embedding array<double>"))
        with pytest.raises(OverflowError):
            top_k(both, both)


@pytest.mark.parametrize("seed", range(10))
def test_trees_leave_out_distances_and_no_answers(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, 4)) * 2000
    v = np.floor(centres[r.integers(0, 8, 2000)] + r.normal(size=(2000, 4)) * 30)
    tree = MTree(v, np.arange(2000), page=16)
    tree.computed = 0
    for q in range(0, 2000, 100):
        scores = v @ v[q]
        order = [int(i) for i in np.lexsort((np.arange(2000), -scores)) if i != q][:5]
        assert [i for _, i in tree.search(v[q], q, 5)] == order
    assert tree.computed < 20 * 2000


@pytest.fixture(scope="module")
def encoder():
    e = Encoder(rank_file(), split_pattern())
    return e, tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=e.merges.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_equal_the_librarys(encoder, text):
    e, t = encoder
    ids = e.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text) and e.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24))
def test_pieces_of_any_bytes(encoder, data):
    e, t = encoder
    assert e.piece(data) == (t._encode_single_piece(data) if data else [])


def test_many_pieces_side_by_side(encoder):
    e, t = encoder
    r, tokens = random.Random(3), list(e.merges.ranks)
    pieces = [b"".join(r.choice(tokens) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    pieces += [bytes(r.choices(b"ab \xc3\xa9", k=r.randint(1, 30))) for _ in range(500)] + [b"na" * 3000, *tokens[::500], b"x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.pieces(pieces)] == [t._encode_single_piece(p) for p in pieces]
    with pytest.raises(ValueError):
        Lanes(Merges({b"a": 0, b"b": 1, b"ab": 2})).encode([b"abab"] * 100 + [b"abc"])


def test_ranks_that_no_merge_makes():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ca": 4, b"bca": 5}  # abc is made by no merge
    merges = Merges(ranks)
    pieces = [bytes(x) for n in range(1, 7) for x in itertools.product(b"abc", repeat=n)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Lanes(merges).encode(pieces)] == [merges.encode(p) for p in pieces]


def test_new_spellings_cost_no_step_for_a_byte(encoder):
    e, _ = encoder
    r = random.Random(4)
    words = {"".join(r.choices("aeinorstlu", k=r.randint(6, 14))) for _ in range(20_000)}
    e.encode([" ".join(f"{w}x" for w in sorted(words)[:500])])  # the tables are made
    begun = time.process_time()
    want = {w: np.array(e.piece(f" {w}".encode()), "<u4").tobytes() for w in words}
    alone = time.process_time() - begun
    e.merges._apart.clear()
    begun = time.process_time()
    e.encode(["".join(f" {w}" for w in words)])
    assert time.process_time() - begun < 0.6 * alone
    assert all(e.kept[f" {w}"] == ids for w, ids in want.items())


def test_appends_and_edits(encoder):
    e, _ = encoder
    r, tokens = random.Random(5), list(e.merges.ranks)
    for _ in range(60):
        data = b"".join(r.choice(tokens) for _ in range(r.randint(0, 60)))
        p = Prefixes(e.merges)
        for i in range(0, len(data), 7):
            p.append(data[i : i + 7])
        assert p.ids() == e.merges.encode(data)
        a = r.randint(0, len(data))
        b, new = min(len(data), a + r.randint(0, 5)), r.choice([b"", r.choice(tokens)])
        anew = p.replace(a, b, new)
        whole = Prefixes(e.merges, data[:a] + new + data[b:])
        assert p.data == whole.data and p.last == whole.last and anew <= len(whole.data) - a
    long = Prefixes(e.merges, b" the quick brown fox" * 200)
    assert long.replace(100, 101, b"X") < 3 * e.merges.longest


def test_round_trip_of_odd_rows(spark, encoder):
    _, t = encoder
    rows = bpe_round_trip(odd(spark), ranks=rank_file(), pattern=split_pattern(), keep_ids=True).collect()
    want = sorted(str((i, len(x := t.encode_ordinary(text or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), x)) for i, text, *_ in odd_rows())
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids))) for r in rows) == want
    assert bpe_round_trip(empty(spark), ranks=rank_file(), pattern=split_pattern()).collect() == []
