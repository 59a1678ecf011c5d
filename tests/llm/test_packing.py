import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from factweir.llm import packing
from factweir.llm.entries import tokenizer_path
from factweir.llm.tokens import WordTokenizer
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.brute import HOSTILE, docs


PLAIN, CACHED = Tokenizer.from_file(tokenizer_path()), WordTokenizer(tokenizer_path())


def _expand(slots, capacity):
    bins = defaultdict(list)
    for s in slots:
        for b in range(s.bins):
            for c in range(s.copies):
                bins[s.first_bin + b].append((s.offset + c * s.length, s.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 97), st.integers(1, 40), max_size=30))
def test_plan_is_valid_and_near_the_bound(counts):
    bins = _expand(packing.plan_packing(counts, 97), 97)
    got = defaultdict(int)
    for parts in bins.values():
        for _, n in parts:
            got[n] += 1
    assert dict(got) == counts
    total, large = sum(n * c for n, c in counts.items()), sum(c for n, c in counts.items() if 2 * n > 97)
    bound = max(-(-total // 97), large)
    assert len(bins) <= 1.5 * bound + 1
    assert all(sum(3 * n > 97 for _, n in parts) <= 2 for parts in bins.values())


def test_plan_beats_first_fit_on_mixed_lengths():
    rng = random.Random(3)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(4096, int(rng.lognormvariate(6, 1.2)) + 1)] += 1
    bins = _expand(packing.plan_packing(counts, 4096), 4096)
    assert len(bins) <= 1.01 * sum(n * c for n, c in counts.items()) / 4096 + 2


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aBé1,'!<| \n.×ÿɏ\u0301İ—·²", max_size=40)), max_size=6))
def test_cached_tokens_equal_the_tokenizer(texts):
    t, cached = PLAIN, CACHED
    cached._clear()
    texts = [x.encode("utf-8", "replace").decode() for x in texts] + ["Don't <|endoftext|> stop_now 3rd\u00a0x e\u0301", ""]
    for _ in range(2):
        got = [x.tolist() for x in cached.encode_all(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_match_the_tokenizer(spark):
    rows = list(enumerate(HOSTILE)) + [(3, "word"), (3, "word"), (None, "no id")]
    pieces = packing.tokenised_pieces(docs(spark, rows), tokenizer_path(), capacity=64)
    packed = packing.pack(pieces, capacity=64).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, k, a, len(p := ids[a : a + 64]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    got = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in packed]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64


def test_sequences_hold_the_ids(spark):
    frame = docs(spark, [(1, "one two three"), (2, "four five"), (3, None)])
    packed = packing.pack(packing.tokenised_pieces(frame, tokenizer_path(), 16).drop("ids"), 16)
    whole = packing.sequences(frame, packed, tokenizer_path(), 16).collect()
    t = Tokenizer.from_file(tokenizer_path())
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in ("one two three", "four five", None))
    assert sum(len(w.ids) // 4 for w in whole) == total


def test_no_rows(spark):
    assert packing.pack(packing.tokenised_pieces(docs(spark, []), tokenizer_path())).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 3])
def test_tiny_capacities(capacity):
    _expand(packing.plan_packing({n: 5 for n in range(1, capacity + 1)}, capacity), capacity)
