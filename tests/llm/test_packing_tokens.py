import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import packing
from quern.llm.huffman import Codec, canonical_codes, code_lengths, read_ids, write_ids
from quern.llm.packing import best_fit, local_search, pack
from quern.llm.tokens import Numbers, opened, word_file

from .cases import empty, odd, odd_rows, prose

ODD = ["", " ", "\n\n", "a\x01b \x01", "<|endoftext|> x<|startoftext|>y", "<|STARTOFTEXT|> Ab", "İstanbul. ΣΑΣ, É́cole éa.", "\x1c\x85\xa0a　b\x0bc\x0cd", "don't I'll DON'T", "x,. y.,", "ǅ, ß. ﬁ. 한글, กำ.", "1,234.5 ...", "́ a", "a ́b, ́", "ªº ⓐ Ⅳ", "x" * 500, "각", "中文，。", "it's, 'S. x's.", "ΑΣ. ΑΣ"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from([50, 60, 100]))
def test_local_search_keeps_items_and_never_adds_bins(lengths, capacity):
    first = best_fit(lengths, capacity)
    out = local_search([list(b) for b in first], lengths, capacity)
    assert sorted(i for b in out for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in out) and len(out) <= len(first)


def test_local_search_empties_bins_that_best_fit_leaves():
    better = 0
    for seed in range(400):
        r = random.Random(seed)
        lengths = [r.randint(10, 60) for _ in range(40)]
        first = best_fit(lengths, 100)
        better += len(first) - len(local_search([list(b) for b in first], lengths, 100))
    assert better > 0


@pytest.mark.parametrize(("n", "most"), [(1024, 338), (4096, 1340)])
def test_local_search_of_many_lengths_near_a_third_of_a_bin(n, most):
    """Best fit leaves 350 and 1,392 bins; the sum of lengths needs 326 and 1,301."""
    r = random.Random(0)
    lengths = [r.randint(400, 900) for _ in range(n)]
    first = best_fit(lengths, 2048)
    began = time.process_time()
    out = local_search(first, lengths, 2048)
    assert time.process_time() - began < 5
    assert sorted(i for b in out for i in b) == list(range(n)) and len(out) <= most
    assert all(sum(lengths[i] for i in b) <= 2048 for b in out)


def packed(spark, df):
    rows = pack(df, tokenizer=word_file()).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    return rows, sequences


def test_packing_of_odd_rows(spark):
    rows, sequences = packed(spark, odd(spark))
    tk = opened(word_file()).tokenizer
    want = []
    for i, text, *_ in odd_rows():
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert len(sequences) == -(-sum(r.length for r in rows) // 2048)
    assert pack(empty(spark), tokenizer=word_file()).collect() == []


def test_packing_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows, sequences = packed(spark, spark.createDataFrame([(i, prose(i, 30 + 11 * (i % 60))) for i in range(150)], "doc_id long, text string"))
    assert {r.doc_id for r in rows} == set(range(150))
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_rounds_end_when_nothing_fits_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rounds, written = [], packing.cut

    def counted(df, name):
        rounds.append(name)
        assert len(rounds) < 20, "the same table again and again"
        return written(df, name)

    monkeypatch.setattr(packing, "cut", counted)
    text = next(t for n in range(200, 4000, 10) if len(opened(word_file()).tokenizer.encode(t := prose(1, n), add_special_tokens=False).ids) > 1400)
    rows, sequences = packed(spark, spark.createDataFrame([(i, text) for i in range(100)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in rows) == list(range(100)) and len(sequences) == 100


def test_repeated_rows_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows, sequences = packed(spark, spark.createDataFrame([(7, prose(1, 300))] * 200, "doc_id long, text string").coalesce(1))
    groups = Counter(r.sequence_id >> 20 for r in rows if r.sequence_id >> 56 == 1)
    assert len(rows) == 200 and len(groups) == 10 and max(groups.values()) <= 40


def test_tokens_equal_the_librarys():
    t = opened(word_file())
    texts = ODD + [prose(i, 50) for i in range(20)]
    for _ in range(2):  # learned, then known
        ids, at = t.encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text
    ids, at = t.encode([])
    assert len(ids) == 0 and list(at) == [0]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_any_text(text):
    t = opened(word_file())
    ids, _ = t.encode([text])
    assert ids.tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_numbers_of_colliding_keys():
    n = Numbers(4)
    keys = np.array([1, 2, 3, 5, 1 << 63, (1 << 63) + 1, (1 << 64) - 1], np.uint64)
    n.add(keys[:4])
    n.add(keys[4:])
    assert n.find(keys).tolist() == list(range(7)) and n.find(np.array([7, 9], np.uint64)).tolist() == [-1, -1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(6, 20))
def test_code_lengths_are_least_within_the_limit(counts, limit):
    c = np.array(counts, np.int64)
    lengths = code_lengths(c, limit).astype(int)
    used = c > 0
    assert (lengths[~used] == 0).all() and (lengths <= limit).all()
    if used.sum() > 1:
        assert sum(2.0**-b for b in lengths[used]) == 1
        heap = sorted(c[used].tolist())
        total = 0
        while len(heap) > 1:
            total += heap[0] + heap[1]
            heap = sorted([heap[0] + heap[1], *heap[2:]])
        assert (lengths * c).sum() >= total and (limit < 16 or (lengths * c).sum() == total)
    codes = {format(int(x), f"0{b}b") for x, b in zip(canonical_codes(lengths), lengths, strict=True) if b}
    assert len(codes) == used.sum() and not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize(("n", "m"), [(0, 5), (1, 5), (255, 4), (256, 4), (257, 4), (5000, 300), (3000, 1)])
def test_codec_round_trip(n, m):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, m - 1)
    codec = Codec(code_lengths(np.bincount(ids, minlength=m)))
    data, checks = codec.encode(ids)
    assert (codec.decode(data, n, checks) == ids).all()


def test_token_files(spark, tmp_path):
    write_ids(odd(spark), str(tmp_path / "ids"), tokenizer=word_file())
    rows = read_ids(spark, str(tmp_path / "ids")).collect()
    tk = opened(word_file()).tokenizer
    start, want = 0, []
    for i, text, *_ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4")), ids))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in sorted(rows, key=lambda r: r.start)] == want
    write_ids(empty(spark), str(tmp_path / "none"), tokenizer=word_file())
    assert read_ids(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("kind", ["string", "decimal(10,2)", "double", "date", "smallint", "int"])
def test_token_files_of_any_ids(spark, tmp_path, kind):
    ids = [None, 3, 1, 2, 3]
    df = spark.createDataFrame([(None if i is None else f"2020-01-0{i}" if kind == "date" else str(i), prose(n, 9)) for n, i in enumerate(ids)], "i string, text string")
    write_ids(df.select(df.i.cast(kind).alias("own"), "text"), str(tmp_path / "ids"), tokenizer=word_file(), id_col="own")
    rows = sorted(read_ids(spark, str(tmp_path / "ids"), id_col="own").collect(), key=lambda r: r.start)
    assert [None if r.own is None else int(str(r.own)[-1] if kind == "date" else float(r.own)) for r in rows] == [None, 1, 2, 3, 3]


def test_a_hot_id_is_dealt_over_ranges(spark, tmp_path):
    df = spark.createDataFrame([(7, prose(1, 40))] * 300 + [(i, prose(i, 40)) for i in range(20)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_ids(df.repartition(4), str(tmp_path / "ids"), tokenizer=word_file())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == 320
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    held = spark.read.parquet(str(tmp_path / "ids" / "blocks")).select("shard", F.size("docs").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    assert held.agg(F.max("n")).first()[0] < 200
