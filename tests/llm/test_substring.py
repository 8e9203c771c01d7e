import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from quern.llm import substring
from quern.llm.fmindex import FMIndex, repeated_windows, suffix_ranks
from quern.llm.substring import anchors, anchors_of, repeated_words, without_repeats

from .cases import empty, odd, odd_rows, prose, pruned, words


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeated_words(df).collect()}
    assert rows == dict(enumerate(pruned(texts)))


def passages():
    shared, other = prose(50, 90), prose(51, 36)
    out = [prose(i, 40) + " " + shared + " " + prose(100 + i, 30) for i in range(12)]
    out += [prose(i, 20) + " " + " ".join(words(shared)[5:70]) + " " + other for i in range(200, 206)]
    out += [other + " " + other, prose(7, 34), prose(7, 34), prose(8, 35), prose(8, 35), " ".join(["same"] * 200), "", None, prose(60, 500), prose(60, 500)]
    return out


def test_whole_corpus_against_brute_force(spark):
    check(spark, passages())


def test_frequent_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    check(spark, passages())


def test_odd_rows(spark):
    rows = repeated_words(odd(spark)).collect()
    texts = [r[1] for r in odd_rows()]
    want = pruned(texts)
    assert len(rows) == len(texts)
    by_id = {}
    for r, w in zip(odd_rows(), want, strict=True):
        by_id.setdefault(r[0], []).append(w)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) in by_id[r.doc_id]
    assert repeated_words(empty(spark)).collect() == []


def test_pruned_documents(spark):
    df = odd(spark)
    out = without_repeats(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    want = dict(zip((r[0] for r in odd_rows()), pruned([r[1] for r in odd_rows()]), strict=True))
    for i, text in ((r[0], r[1]) for r in odd_rows() if r[0] is not None):
        n, gone, _ = want[i]
        if n and gone == n:
            assert i not in texts
        else:
            assert texts[i] == text if not gone else len(words(texts[i])) == n - gone
    assert without_repeats(empty(spark)).collect() == []


def test_ids_that_repeat_or_are_null(spark):
    shared, other = prose(50, 90), prose(51, 60)
    clean = prose(1, 30) + " " + prose(2, 400)
    rows = [(1, prose(3, 5) + " " + shared), (1, clean), (1, prose(4, 200) + " " + other), (2, shared + " " + prose(5, 40)), (None, other + " " + prose(6, 50)), (None, prose(7, 80)), (None, None), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = pruned([t for _, t in rows])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeated_words(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    left = {(r.doc_id, len(words(r.text))) for r in without_repeats(df).collect()}
    assert left == {(i, n - gone) for (i, _), (n, gone, _) in zip(rows, want, strict=True)}
    assert (1, clean) in {(r.doc_id, r.text) for r in without_repeats(df).collect()}


def test_a_passage_of_many_documents_leaves_its_places_behind(spark, monkeypatch):
    """A shard is handed different stretches and counts, however many documents share them."""
    search = substring._search

    def counted(window):
        run = search(window)

        def counting(batches):
            def passing():
                for b in batches:
                    assert b.num_columns == 5
                    yield b

            return run(passing())

        return counting

    monkeypatch.setattr(substring, "_search", counted)
    monkeypatch.setattr(substring, "MERGED", 4000)
    monkeypatch.setattr(substring, "HOT", 20)
    shared = prose(50, 60)
    texts = [prose(i, 5) + " " + shared + " " + prose(1000 + i, 5) for i in range(150)]
    check(spark, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60))
def test_anchors_own_each_window_once(symbols):
    w = np.array(symbols, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at, first, last = anchors(w, 10, 3)
    owned = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    assert owned == list(range(max(0, len(w) - 9)))
    assert all(b <= p <= a + 7 and p <= b + 7 for p, a, b in zip(at, first, last, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=8))
def test_anchors_of_many_texts_are_those_of_each(texts):
    every = [np.array(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    *found, at = anchors_of(np.concatenate(every), begins, 10, 3)
    for k, w in enumerate(every):
        hashes, *places = (f[at[k] : at[k + 1]] for f in found)
        for got, want in zip((hashes, *(p - begins[k] for p in places)), anchors(w, 10, 3), strict=True):
            assert got.tolist() == want.tolist()


def test_a_changed_word_costs_no_reading_for_each_end(monkeypatch):
    """Ends between the changed word and the last are settled by halves, not one by one."""
    r, steps = np.random.default_rng(2), []
    extend = FMIndex.extend
    monkeypatch.setattr(FMIndex, "extend", lambda self, symbols, lo, hi: steps.append(len(symbols)) or extend(self, symbols, lo, hi))
    seqs = []
    for _ in range(100):
        seq = r.integers(1, 1000, 69)
        changed = seq.copy()
        changed[38] = seq[38] % 999 + 1
        seqs += [seq, changed]
    text = np.concatenate([np.append(s, 0) for s in seqs])
    begin = np.arange(len(seqs)) * 70
    found = repeated_windows(FMIndex(text, np.ones(len(seqs), int)), text, begin, begin + 69, begin + 35, 35)
    for b in begin:
        assert found[b : b + 35].tolist() == [i <= 3 for i in range(35)]
    assert sum(steps) < 150 * len(seqs) and len(steps) < 250


def test_shards_are_as_many_as_different_stretches_need(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 1000)
    shards, deal = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *by: (shards.append(n) if by == ("route",) else None) or deal(self, n, *by))
    shared = prose(50, 120)
    check(spark, [prose(i, 5) + " " + shared + " " + prose(1000 + i, 5) for i in range(150)])
    assert len(shards) == 1 and shards[0] <= 25


@pytest.mark.parametrize("seed", range(20))
def test_index_against_counting(seed):
    r = np.random.default_rng(seed)
    seqs = [r.integers(1, 4, r.integers(6, 11)) for _ in range(r.integers(1, 8))]
    weights = r.integers(1, 3, len(seqs)) if seed % 3 == 0 else np.ones(len(seqs), int)
    text = np.concatenate([np.append(s, 0) for s in seqs])
    end = np.cumsum([len(s) + 1 for s in seqs]) - 1
    begin = end - [len(s) for s in seqs]
    found = repeated_windows(FMIndex(text, weights), text, begin, end, begin + 6, 6)
    count: dict[tuple, int] = {}
    for s, w in zip(seqs, weights, strict=True):
        for i in range(len(s) - 5):
            count[tuple(s[i : i + 6])] = count.get(tuple(s[i : i + 6]), 0) + w
    for s, b in zip(seqs, begin, strict=True):
        assert [bool(x) for x in found[b : b + len(s) - 5]] == [count[tuple(s[i : i + 6])] >= 2 for i in range(len(s) - 5)]


def test_an_index_takes_about_the_entropy_of_its_text():
    r = np.random.default_rng(1)
    text = np.append(np.minimum(r.zipf(1.2, 40_000), 30_000), 0)
    index = FMIndex(text, np.ones(1, int))
    share = np.bincount(text) / len(text)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    held = sum(b.words.nbytes + b.counts.nbytes for b in [x[1] for x in index.classes] + [x[0] for x in index.levels])
    assert 8 * held / len(text) < 1.5 * (entropy + 6) < 1.5 * int(text.max()).bit_length() * 1.5
    plain = [int(x) for x in text]
    for size in (1, 2, 3):  # counts of strings by backward search
        for at in range(0, 300, 37):
            want, lo, hi = plain[at : at + size], np.array([0]), np.array([len(text)])
            for x in reversed(want):
                lo, hi = index.extend(np.array([x]), lo, hi)
            assert hi[0] - lo[0] == sum(plain[i : i + size] == want for i in range(len(plain) - size))


def test_suffix_order():
    text = np.array([2, 1, 2, 1, 2, 0])
    rank = suffix_ranks(np.where(text == 0, 0, text + 1))
    want = sorted(range(6), key=lambda i: list(text[i:]))
    assert [int(x) for x in np.argsort(rank)] == want
