import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.llm import packing, wavelet
from sparkwright.llm.tokens import tokenizer, tokenizer_path
from tests.llm.packing_checks import check_packing, packed, whole_ids


@pytest.fixture(scope="module")
def whole():
    return whole_ids()


WHOLE = whole_ids()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé'ſİ .,*<|>09́\n　")), max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    assert tokenizer(tokenizer_path()).encode_bytes(text) == packed(WHOLE(text))


def test_packing_of_odd_rows(odd, whole):
    rows = packing.pack(odd).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], whole) == 0


def test_packing_of_documents_leaves_no_padding(sample, whole):
    rows = packing.pack(sample).collect()
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in sample.collect()], whole) == 0


def test_packing_holds_all_limits(spark, whole):
    rows = [(k, "word " * (k % 37), k % 11) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss long")
    limits = packing.Limits(tokens=64, segments=3, loss_tokens=16)
    out = packing.pack(docs, loss_col="loss", limits=limits).collect()
    check_packing(out, [(a, b) for a, b, _ in rows], whole, limits)
    loss = sum(r["loss_tokens"] for r in out)
    assert loss == sum(min(c, len(whole(b)) + 1) for _, b, c in rows)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 70000)), max_size=3000))
def test_wavelet_matrix_answers(values):
    ids = np.array(values, dtype=np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert w.decode().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 5)):
        v = values[i]
        assert w.access(i) == v
        before = values[:i].count(v)
        assert w.rank(v, i) == before and w.count(v) == values.count(v)
        assert w.select(v, before) == i and w.select(v, w.count(v)) == -1
    assert w.count(70001) == values.count(70001)


def check_shards(out, docs, whole):
    want, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = packed([*whole(text), 2])
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 100])
def test_wavelet_shards_round_trip(odd, sample, whole, shard_tokens):
    for docs in (odd, sample):
        out = wavelet.round_trip(docs, shard_tokens=shard_tokens).collect()
        check_shards(out, [(r["doc_id"], r["text"]) for r in docs.collect()], whole)


def test_written_shards_count_and_locate_a_token(spark, odd, whole, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(odd, path, shard_tokens=100)
    docs = [(r["doc_id"], [*whole(r["text"]), 2]) for r in odd.collect()]
    every = Counter(t for _, ids in docs for t in ids)
    for token in (2, every.most_common(2)[1][0], every.most_common()[-1][0], 49_000_000):
        assert sum(r["n_found"] for r in wavelet.count_token(spark, path, token).collect()) == every[token]
        got = Counter((r["doc_id"], r["offset"]) for r in wavelet.locate_token(spark, path, token).collect())
        assert got == Counter((d, k) for d, ids in docs for k, t in enumerate(ids) if t == token)


def test_wavelet_shards_of_an_empty_table(spark):
    assert wavelet.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_piece_that_waits_is_measured_once(monkeypatch):
    """A sequence looks at the demands that are kept, so the work does not grow with pieces times sequences."""
    measured = []
    demand = packing.Piece.demand
    monkeypatch.setattr(packing.Piece, "demand", lambda self: measured.append(self.doc_id) or demand(self))
    sizes = [1 + i * 37 % 900 for i in range(1500)]
    packer = packing.Packer(packing.Limits())
    for i, n in enumerate(sizes):
        packer.add(i, bytes(4 * n))
    packer.finish()
    assert sum(end - start for _, start, end, *_ in packer.out) == sum(sizes)
    assert len(measured) <= len(sizes) + len(packer.out)


def test_pieces_of_one_token_wait_beyond_the_pool():
    packer = packing.Packer(packing.Limits(2048, 4096, 2048))
    for i in range(5000):
        packer.add(i, bytes(4))
    packer.finish()
    lengths = Counter(sequence for _, _, _, sequence, _ in packer.out)
    assert sorted(lengths.values()) == [8, 128, 256, 512, 2048, 2048]
    assert sorted(piece.doc_id for piece, *_ in packer.out) == list(range(5000))


def test_short_pieces_need_no_padding():
    """Sequences that the number of segments ends, not their tokens, still have lengths that are powers of two."""
    for limits, loss in ((packing.Limits(), None), (packing.Limits(2048, 7, 2048), None), (packing.Limits(2048, 256, 100), 2)):
        packer = packing.Packer(limits)
        for i in range(600):
            packer.add(i, bytes(4 * 3), loss)
        packer.finish()
        sizes, seen = {}, {}
        for piece, start, end, sequence, offset in packer.out:
            assert offset == sizes.get(sequence, 0) and start == seen.get(piece.doc_id, 0)
            sizes[sequence], seen[piece.doc_id] = offset + end - start, end
        assert set(seen.values()) == {3} and len(seen) == 600
        assert all(n & (n - 1) == 0 for n in sizes.values())
