"""Checks of packed pieces that several tests share."""

import struct
import zlib

from tokenizers import Tokenizer

from sparkwright.llm import packing
from sparkwright.llm.tokens import tokenizer_path


def whole_ids():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def check_packing(rows, docs, whole, limits=packing.Limits()):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert r["length"] > 0
        if "ids" in r:
            assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r["loss_tokens"] for r in pieces) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    want = {}
    for doc_id, text in docs:
        ids = packed([*whole(text), 1])
        want.setdefault(doc_id, []).append(ids)
    got = {}
    for (doc_id, _), pieces in by_doc.items():
        got.setdefault(doc_id, []).extend(pieces)
    assert set(got) == set(want)
    for doc_id, texts in want.items():
        pieces = sorted(got[doc_id], key=lambda r: (r["start"], r["length"]))
        assert sum(r["length"] for r in pieces) * 4 == sum(map(len, texts))
        if len(texts) == 1:
            for r in pieces:
                a, b = 4 * r["start"], 4 * (r["start"] + r["length"])
                assert zlib.crc32(texts[0][a:b]) == r["ids_crc32"]
            assert {r["doc_tokens"] for r in pieces} == {len(texts[0]) // 4}
    return padding
