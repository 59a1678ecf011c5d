"""Queries that SQL can't express against plain versions over whole tables: op4, op6 and op8."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from factweir.llm import entries, langid, mixing
from tokenizers import Tokenizer

from tests.llm.test_models import _brute_rates


def _rows(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def _grams(text):
    """Buckets of the trigrams of a text, one after the other."""
    kept = []
    for b in text.lower().encode():
        b = b if b >= 128 or 97 <= b <= 122 else 32
        if b != 32 or not kept or kept[-1] != 32:
            kept.append(b)
    kept = kept[1:] if kept and kept[0] == 32 else kept
    return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(kept, kept[1:], kept[2:], strict=False)]


def _fit(units, chosen):
    """Proportions of the chosen languages and the log-likelihood, unit by unit."""
    share = {c: 1 / len(chosen) for c in chosen}
    for _ in range(30):
        sums = dict.fromkeys(chosen, 0.0)
        for u in units:
            top = max(u[c] for c in chosen)
            each = {c: share[c] * math.exp(u[c] - top) for c in chosen}
            total = sum(each.values())
            for c in chosen:
                sums[c] += each[c] / total
        new = {c: sums[c] / len(units) for c in chosen}
        done = max(abs(new[c] - share[c]) for c in chosen) < 1e-4
        share = new
        if done:
            break
    best = 0.0
    for u in units:
        top = max(u[c] for c in chosen)
        best += top + math.log(sum(share[c] * math.exp(u[c] - top) for c in chosen))
    return share, best


def test_language_query(spark, data):
    docs = _rows(spark, data, "documents")
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    counts = defaultdict(lambda: defaultdict(int))
    for r in docs:
        if r.lang is not None and r.text is not None and not held(r):
            for g in _grams(r.text):
                counts[r.lang][g] += 1
    langs = sorted(counts)
    total = {k: sum(c.values()) + 0.5 * langid.BUCKETS for k, c in counts.items()}
    logp = lambda k, g: math.log((counts[k].get(g, 0) + 0.5) / total[k])
    got = {r.doc_id: r for r in entries.op4_language_id(spark, data).collect()}
    assert len(got) == len(docs) and all(got[r.doc_id].held_out == held(r) for r in docs)
    checked = 0
    for r in docs:
        grams = _grams(r.text or "")
        if len(grams) > 6000 or not grams:
            continue
        units = [{k: sum(logp(k, g) for g in grams[i : i + langid.UNIT]) / 3 for k in langs} for i in range(0, len(grams), langid.UNIT)]
        whole = {k: sum(u[k] for u in units) for k in langs}
        chosen, share = [max(langs, key=lambda k: whole[k])], {}
        best, cost = whole[chosen[0]], 3.0 + 0.5 * math.log(len(units))
        share = {chosen[0]: 1.0}
        while len(chosen) < len(langs):
            tried = [(*_fit(units, [*chosen, k]), k) for k in langs if k not in chosen]
            new, gained, k = max(tried, key=lambda t: t[1])
            if gained - best <= cost:
                break
            chosen, share, best = [*chosen, k], new, gained
        main = max(share, key=lambda k: share[k])
        assert got[r.doc_id].lang_pred == main and got[r.doc_id].score == pytest.approx(share[main], abs=0.02), r.doc_id
        checked += 1
    assert checked > 150
    mine = [r for r in docs if held(r) and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in mine) >= 0.9 * len(mine)


def _plain_packing(lengths, capacity):
    """Bins by large-item matching and best fit, piece by piece."""
    bins = []
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        n = large.pop(0)
        mate = next((m for m in large if m <= capacity - n), 0)  # the largest that fits
        if mate:
            large.remove(mate)
        bins.append(capacity - n - mate)
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_packing_query(spark, data):
    t = Tokenizer.from_file(entries.tokenizer_path())
    want, lengths = [], []
    for r in _rows(spark, data, "documents"):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            lengths.append(len(part))
    got = entries.op6_best_fit_packing(spark, data).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == [int(e) for e in ends[:-1]] and ends[-1] <= 4096
    assert len(by) == _plain_packing(lengths, 4096) and len(by) >= math.ceil(sum(lengths) / 4096)


def _plain_bins(text, lexicon):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    plain = {w.strip(mixing.PUNCTUATION) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}
    n = max(len(words), 1)
    raw = {
        "marked": len(re.findall(r"(?:[#*$%&]{2,}|!{2,})[.,]?(?![^ \t\n\x0b\f\r])", text)) / n,
        "bars": sum(w in "|>" for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w) / n,
        "capitals": sum(c.isupper() for c in text) / max(len(text), 1),
        "repeated": 1 - len(plain) / n - min(0.25, 0.05 * math.log10(n)),
        "hits": float(len(plain & set(lexicon))),
    }
    return len(words), {k: sum(raw[k] > b for b in cuts) for k, cuts in mixing.BINS.items()}


def test_mixing_query(spark, data):
    docs, labels = _rows(spark, data, "documents"), _rows(spark, data, "labels")
    model = mixing.learn(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    found = {r.doc_id: _plain_bins(r.text or "", model.lexicon) for r in docs}
    domain = {r.doc_id: 2 if r.toxic else 1 if r.quality < 1 else 0 for r in labels if r.doc_id in found}
    size = [sum(d == k for d in domain.values()) for k in range(3)]
    logs = {}
    for f, cuts in mixing.BINS.items():
        for b in range(len(cuts) + 1):
            for k in range(3):
                n = sum(found[i][1][f] == b for i, d in domain.items() if d == k)
                logs[f, b, k] = math.log((n + 0.5) / (size[k] + 0.5 * (len(cuts) + 1)))
    p = []
    for r in docs:
        score = [math.log((size[k] + 1) / (sum(size) + 3)) + sum(logs[f, b, k] for f, b in found[r.doc_id][1].items()) for k in range(3)]
        e = [math.exp(s - max(score)) for s in score]
        p.append([x / sum(e) for x in e])
    p, tokens = np.array(p), np.array([found[r.doc_id][0] for r in docs], dtype=float)
    got = entries.op8_mixing(spark, data).toPandas().set_index("doc_id").loc[[r.doc_id for r in docs]]
    assert (got.n_words.to_numpy() == tokens).all()
    np.testing.assert_allclose(got[["p_clean", "p_low", "p_toxic"]].to_numpy(), p, atol=1e-9)
    want = _brute_rates(tokens, p, (0.85, 0.1, 0.05), 1e-4, 4.0)
    sums, ideal = (tokens * got.rate.to_numpy()) @ p, (tokens * want) @ p
    np.testing.assert_allclose(sums / sums.sum(), ideal / ideal.sum(), atol=0.005)
    assert ((got.copies - got.rate).abs() < 1).all()
