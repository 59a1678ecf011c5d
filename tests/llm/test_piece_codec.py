import hashlib
import random

import numpy as np
from factweir.llm import entries
from factweir.llm.piece_codec import PieceCodec, codec, decode_pieces, encode_pieces
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tests.llm import brute

MODEL = entries.tokenizer_path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
AWKWARD = [" ", "▁", " ▁ ▁▁x", "\n\n  a", "<s></s><0x0A>", "ﬁ①Ａ", "你好 世界", "😀" * 50, "a\x00b", "�", "x" * 5000, "=" * 999, " " * 777, "    " * 50 + "y", "aaaa bbbb " * 3000, "ab" * 3000 + " c"]


def ids(text):
    return np.frombuffer(codec(MODEL).encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ▁aeithnosrGRS\t\n.,-=_*#'\"012ßéñ你好ﬁ①😀\x00", max_size=80) | st.text(max_size=40))
def test_any_text_is_encoded_as_the_library_does(text):
    assert ids(text) == LIBRARY.encode(text)


def test_pieces_side_by_side_and_ties_of_equal_scores():
    draw, pieces = random.Random(5), list(codec(MODEL).ids)
    equal = [p for p, s in codec(MODEL).scores.items() if list(codec(MODEL).scores.values()).count(s) > 1][:16]
    for k in range(3000):
        text = "".join(draw.choice(pieces if k % 2 else [*equal, "a", "▁"]) for _ in range(draw.randint(1, 7)))
        assert ids(text) == LIBRARY.encode(text), text


def test_caches_start_anew_without_a_change(monkeypatch):
    from factweir.llm import piece_codec

    monkeypatch.setattr(piece_codec, "_KEPT_WORDS", 7)
    monkeypatch.setattr(piece_codec, "_KEPT_PAIRS", 11)
    monkeypatch.setattr(piece_codec, "_STRETCH", 40)
    own, text = PieceCodec(MODEL), "the words that come again and again, the words  that\tcome once. " * 20
    assert [np.frombuffer(own.encode(text), np.int32).tolist() for _ in range(2)] == [LIBRARY.encode(text)] * 2
    assert len(own) <= 7 and len(own.pairs) <= 11


def test_tables_with_awkward_rows(spark):
    texts = [*brute.HOSTILE, *AWKWARD, *AWKWARD]
    docs = brute.docs(spark, [(i if i % 5 else None, t) for i, t in enumerate(texts)]).withColumn("TEXT_", F.lit(1)).withColumn("IDS", F.lit(2))
    got = decode_pieces(encode_pieces(docs, MODEL), MODEL).collect()
    want = [(i if i % 5 else None, LIBRARY.encode(t or "") + [LIBRARY.eos_id()]) for i, t in enumerate(texts)]
    want = [(i, x, LIBRARY.decode(x)) for i, x in want]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
    assert sorted(len(r.ids) for r in encode_pieces(docs, MODEL, end_id=False).collect()) == sorted(len(x) - 1 for _, x, _ in want)


def test_bytes_that_are_no_utf8(spark):
    raw = b"ab\xff\xfecd \xe2\x82 \xf0\x9f\x98"
    docs = spark.createDataFrame([(1, raw)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    assert list(encode_pieces(docs, MODEL, end_id=False).first().ids) == LIBRARY.encode(raw)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs:
        x = LIBRARY.encode(r.text or "") + [2]
        want.append((r.doc_id, len(x), hexed(" ".join(map(str, x))), hexed(LIBRARY.decode(x))))
    assert sorted(map(tuple, entries.op11_sentencepiece(spark, data).collect())) == sorted(want)
