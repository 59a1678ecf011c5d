import hashlib
from collections import defaultdict

from factweir.llm import chat
from factweir.llm.entries import HOSTILE as CONTROL
from factweir.llm.entries import tokenizer_path
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.brute import HOSTILE

SCHEMA = "conv_id long, turn long, role string, text string, window string, n_turns int"

pieces = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", ">", "n", "\n", "a", CONTROL]), max_size=12).map("".join)


@given(pieces, pieces)
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(role)) == role
    whole = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    assert [t[:2] for t in chat.read_turns(whole * 2)] == [(role, text)] * 2


def _rows():
    rows = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", "be brief"))
        rows += [(c, 1 + t, "assistant" if t % 2 else "user", f"turn {t} of {c} " + "blah " * (3 * t)) for t in range(9)]
    rows += [(50, i, "assistant", t) for i, t in enumerate(HOSTILE)]
    rows += [(51, None, None, None), (51, 1, "user", "x"), (51, 1, "user", "x"), (None, 1, "assistant", "null conversation")]
    rows.append((52, 0, "system", "long " * 500))
    return [(*r, "clash", 1) for r in rows]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip_and_loss(spark):
    rows = _rows()
    windows = chat.format_windows(_frame(spark, rows), tokenizer_path(), budget=64, history=16)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_budget_system_and_history(spark):
    windows = chat.format_windows(_frame(spark, _rows()), tokenizer_path(), budget=64, history=16).collect()
    by = defaultdict(list)
    for w in windows:
        by[w.conv_id].append(w)
    assert any(len(x) > 2 for x in by.values())
    for c, ws in by.items():
        ws.sort(key=lambda w: w.window)
        seen = []
        for w in ws:
            turns = chat.read_turns(w.text)
            assert len(turns) == w.n_context + w.n_turns
            assert w.over_budget == (w.n_tokens > 64)
            assert not w.over_budget or w.n_turns == 1
            head = turns[: w.n_context]
            if w.window and c in (1, 3, 5):
                assert head[0][:2] == ("system", "be brief")
                head = head[1:]
            assert [t[:2] for t in head] == seen[len(seen) - len(head) :]
            seen += [t[:2] for t in turns[w.n_context :]]
            masked = [(s.start, s.end) for s in w.loss]
            assert masked == [(t[2], t[3]) for t in turns[w.n_context :] if t[0] == "assistant"]
    assert any(w.n_context for w in windows)


def test_no_rows(spark):
    empty = chat.format_windows(_frame(spark, []), tokenizer_path())
    assert empty.count() == 0
    assert chat.digests(chat.format_windows(_frame(spark, []), tokenizer_path())).count() == 0


def test_query_holds_every_turn_and_the_planted_conversation(spark, data):
    import hashlib
    from collections import defaultdict

    from factweir.llm import entries

    turns = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", entries.HOSTILE), (1, "assistant", entries.HOSTILE)]
    got = {r.conv_id: r for r in entries.op1_chat_format(spark, data).collect()}
    assert set(got) == set(turns)
    for i, rows in turns.items():
        rows = sorted(rows)
        loss = "".join(x for _, role, x in rows if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in rows)
        want = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want
