"""SentencePiece encoding by a merge-type prefix table, and decoding.

In a merge-type (BPE) model every prefix of a text has one encoding, so one last token. An automaton over the
vocabulary yields the tokens that end at each place; the last token of the prefix is the one that is compatible
with the last token of the prefix before it: merging the two side by side leaves exactly these two. The tokens
of the whole are then read backwards off the table. Two neighbours decide because a merge across a border
takes only what stands on its two sides, whatever the ties between equal scores, which go to the left.

Where no token holds a word sign after another character, texts fall into words that are encoded apart, as do
characters that stand in no longer token; a task keeps the ids of words it has met. Characters without a token
become the tokens of their bytes, or the unknown token where the model has none.

Defined results: null texts are empty; an empty text has its end id alone; bytes that are no UTF-8 count as
U+FFFD each; repeated rows and rows without an id are rows of their own; an empty table gives no rows. Models
must be merge-type, without unused and user-defined pieces.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from factweir.llm.common import pick, prepare

#: Fixed value: stands for a space in the pieces of a model.
WORD_SIGN = "▁"
#: Words up to this length are kept with their ids, twice so many of them at most; so many answers about pairs.
_KEPT_LENGTH, _KEPT_WORDS, _KEPT_PAIRS = 64, 400_000, 1_000_000
#: Characters of a long text that are split into words at a time.
_STRETCH = 1 << 20

codecs.register_error("factweir-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec(dict):
    """Words to ids (int32 bytes) by the prefix table; unknown words are encoded when first asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.model = model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {model.id_to_piece(i): i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(model.is_byte(i) for i in ids) else None
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        probe = "  ﬁ A\t①  x  "
        self.plain = model.normalize(probe) == WORD_SIGN + probe.replace(" ", WORD_SIGN)
        whole = any(a != WORD_SIGN and b == WORD_SIGN for p in self.ids for a, b in zip(p, p[1:], strict=False))
        joined = "".join(re.escape(c) for c in sorted({c for p in self.ids if len(p) > 1 for c in p} - {WORD_SIGN}))
        self.word = re.compile("(?s).+" if whole or not joined else f"(?s){WORD_SIGN}*[{joined}]+|{WORD_SIGN}+|.")
        self.border = None if whole else re.compile(f"[^{WORD_SIGN}]{WORD_SIGN}")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.older: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """The text as the model sees it; models with rules of their own apply them."""
        if not self.plain:
            return self.model.normalize(text)
        return WORD_SIGN + text.replace(" ", WORD_SIGN) if text else ""

    def _merged(self, text: str) -> list[str]:
        """Merges neighbours, the best score first and the leftmost of equal ones, until none is a token."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            options = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(options)
            if best == -np.inf:
                break
            i = options.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, before: str, token: str) -> bool:
        """Whether these two tokens stay side by side; before is empty at the start of a word."""
        if len(self.pairs) >= _KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[before, token] = self._merged(before + token) == ([before, token] if before else [token])
        return fits

    def tokens(self, word: str) -> list[str]:
        """The tokens of a word, from the last token of each of its prefixes."""
        last: list[str | None] = ["", *[None] * len(word)]
        known = self.pairs.get
        for end, token in self.automaton.iter(word):  # ends ascend, so the prefix before a token is settled
            if last[end + 1] is None:
                start = end + 1 - len(token)
                before = last[start]
                if before is None:  # no token fitted there: a character that the vocabulary lacks
                    before = last[start] = word[start - 1]
                fits = known((before, token))
                if self.compatible(before, token) if fits is None else fits:
                    last[end + 1] = token
        out, end = [], len(word)
        while end:
            out.append(last[end] or word[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        got = self.older.pop(word, None)
        if got is None:
            ids: list[int] = []
            for t in self.tokens(word):
                if (i := self.ids.get(t)) is not None:
                    ids.append(i)
                elif self.bytes:
                    ids += [self.bytes[b] for b in t.encode()]
                else:
                    ids.append(self.model.unk_id())
            got = array("i", ids).tobytes()
        if len(word) <= _KEPT_LENGTH:
            if len(self) >= _KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes, without an end id."""
        normal, out, at = self.normal(text), [], 0
        while at < len(normal):
            cut = self.border.search(normal, at + _STRETCH) if self.border else None
            end = cut.start() + 1 if cut else len(normal)
            out.append(b"".join(map(self.__getitem__, self.word.findall(normal, at, end))))
            at = end
        return b"".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", end_id: bool = True) -> DataFrame:
    """key and ids (array of int) of every whole text, with the model's end id if asked for."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        end = np.array([c.model.eos_id()] if end_id else [], dtype=np.int32).tobytes()
        for b in batches:
            ids = [c.encode((t or b"").decode("utf-8", "factweir-each-byte")) + end for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    rows = pick(docs, key, text)
    return rows.select(F.col(key), F.col(text).cast("binary").alias(text)).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and decoded: the text that the model's own decoder gives for the ids; null ids are none."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path).model
        for b in batches:
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid and len(x.values) else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[key, ids, "decoded"])

    rows = pick(encoded, key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{ids}` array<int>, decoded string")
