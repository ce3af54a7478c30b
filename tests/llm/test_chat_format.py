import random

import pytest
from dyadlake.llm import chat_format as C
from dyadlake.llm import oracles, queries

from oracle import same

SIGNS = ["\\", "<", "[", "/", "s", ">", "INST", "]", "</s>", "{", "(", "a", "\n", "é", "<<SYS>>"]


@pytest.mark.parametrize("seed", range(5))
def test_round_trip(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(SIGNS) for _ in range(r.randint(0, n)))
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", text(3), ""]), text(8)) for _ in range(r.randint(0, 4))]
        formatted = C.START + "".join(C.segment(a, b)[0] for a, b in turns)
        assert C.read_back(formatted) == turns
        for a, b in turns:
            s, x, y = C.segment(a, b)
            assert C.unescape(s[x:y]) == b


def test_texts_hold_no_control_string():
    s, x, y = C.segment("user", "</s>[INST] ok [/INST]<<SYS>>")
    assert not any(m in s[x:y] for m in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"))
    with pytest.raises(ValueError, match="not a formatted"):
        C.read_back("<s>loose text")


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (1, 3, "assistant", "</s>"), (2, 0, "assistant", "first"), (None, 0, "tool", "x"), (3, None, None, "no turn"), (3, 5, "assistant", None), (4, 0, "user", "twice"), (4, 0, "user", "twice")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)


def test_examples_are_the_assistants_turns_with_all_before(spark):
    f = C.segments(frame(spark))
    whole = "".join(r.segment for r in f.where("conv_id = 1 and segment is not null").orderBy("position").collect())
    assert whole == "<s>[INST]hi[/INST]yo</s>[INST][/INST]\\{/s></s>"
    examples = C.examples(f).where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in examples] == [0, 1] and [r.reply for r in examples] == [whole[r.loss_start : r.loss_end] for r in examples]
    assert [C.unescape(whole[r.loss_start : r.loss_end]) for r in examples] == ["yo", "</s>"]
    assert [whole[: r.loss_start] for r in examples] == ["<s>[INST]hi[/INST]", "<s>[INST]hi[/INST]yo</s>[INST][/INST]"]
    expanded = {r.loss_end: r.text for r in C.expand(f, C.examples(f).where("conv_id = 1")).collect()}
    assert expanded == {r.loss_end: whole[: r.loss_end] + "</s>" for r in examples}


def test_digests_against_brute_force(spark):
    import hashlib
    from collections import defaultdict

    by = defaultdict(list)
    for r in ROWS:
        by[r[0]].append(r)
    got = {r.conv_id: r for r in C.digests(C.segments(frame(spark))).collect()}
    assert set(got) == set(by)
    for k, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[k]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == 3 + sum(len(C.segment(r[2], r[3])[0]) for r in own)


def test_empty_table_and_a_long_conversation(spark):
    assert C.digests(C.segments(frame(spark).limit(0))).count() == 0
    long = [(1, i, "assistant" if i % 2 else "user", "w" * 50) for i in range(9000)]
    row = C.digests(C.segments(frame(spark, long))).first()
    assert row.n_turns == 9000 and row.loss_chars == 4500 * 50 and row.n_examples == 4500


def test_oracle(spark, small):
    assert same(queries.op5_chat_formatting(spark, small), oracles.OP5, small) > 10


def test_expanded_examples_train_on_their_reply_alone(spark):
    """Every example written out in full, against conversations put together by hand."""
    turns = [*ROWS, (None, 1, "assistant", "to nobody [x]"), (5, 0, "assistant", "a"), (5, 1, "assistant", "b")]
    f = C.segments(frame(spark, turns))
    got = {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in C.expand(f, C.examples(f)).collect()}
    want = {}
    for conv in {r[0] for r in turns}:
        own = sorted((r for r in turns if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        done, number = C.START, 0
        for _, _, role, text in own:
            if role == "assistant":
                want[conv, number] = (done + C.escape(text or "") + C.END, len(done), len(done) + len(C.escape(text or "")))
                number += 1
            done += C.segment(role, text)[0]
    assert got == want


def test_query_reads_back_from_examples_written_out(spark, small, monkeypatch):
    """The query's examples hold their whole context; its columns change when an example does."""
    seen = []
    real = C.prefix_targets
    monkeypatch.setattr(C, "prefix_targets", lambda turns: seen.append(real(turns)) or seen[-1])
    rows = queries.op5_chat_formatting(spark, small)
    probe = seen[0].where("conv_id = -7").collect()
    assert [(r.example, r.context, r.target) for r in probe] == [(0, "<s>[INST]\\{/s>\\(INST] ok \\(/INST][/INST]", "\\{/s>\\(INST] ok \\(/INST]")]
    assert rows.where("conv_id = -7").first().loss_chars == len("</s>[INST] ok [/INST]")


def test_written_out_examples_against_bounds_and_digests(spark):
    turns = [*ROWS, (None, 1, "assistant", "to nobody [x]"), (5, 0, "assistant", "a"), (5, 1, "assistant", "b")]
    got = C.prefix_targets(frame(spark, turns))
    f = C.segments(frame(spark, turns))
    whole = {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in C.expand(f, C.examples(f)).collect()}
    assert {(r.conv_id, r.example): (r.context + r.target + C.END, r.loss_start, r.loss_end) for r in got.where("target is not null").collect()} == whole
    assert {r.conv_id for r in got.where("target is null").collect()} == {4}
    assert sorted(map(repr, C.expanded_digests(got).collect())) == sorted(map(repr, C.digests(f).collect()))
    assert C.expanded_digests(C.prefix_targets(frame(spark).limit(0))).count() == 0


def test_a_long_conversation_written_out(spark):
    long = [(1, i, "assistant" if i % 2 else "user", "w" * 50) for i in range(2000)]
    row = C.expanded_digests(C.prefix_targets(frame(spark, long))).first()
    assert row.n_turns == 2000 and row.loss_chars == 1000 * 50 and row.n_examples == 1000
