import hashlib
import json

import pytest

from cartlytics.llm import chat as X

HARD = ["", "plain", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>", "\\", "\\.", "<\\.|end|>", "a\\\\b\n", "<s><s></s>", "<<SYS>>x<</SYS>>", "<|im_start|>é👍\x00"]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, extra string")


def expect(rows):
    rows = [(r or "", t or "") for r, t in rows]
    loss = "".join(t for r, t in rows if r == "assistant")
    return (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def said(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in X.digest(X.format_turns(X.canonical(frame))).collect()}


def test_round_trip_of_hard_texts(spark):
    rows = [(c, i, ("user", "assistant", "assistant")[(i + c) % 3], t) for c in range(3) for i, t in enumerate(HARD)]
    got = said(turns(spark, rows))
    for c in range(3):
        assert got[c] == expect([(r, t) for k, _, r, t in rows if k == c])


def test_no_control_string_is_left_in_texts(spark):
    rows = [(0, i, "user", t) for i, t in enumerate(HARD)]
    text = X.format_turns(X.canonical(turns(spark, rows))).first()["formatted"]
    for c in X.CONTROLS[3:]:
        assert c not in text
    assert text.count("<|turn|>") == text.count("<|text|>") == text.count("<|end|>") == len(HARD)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "assistant", "last"), (2, 1, "weird\n<|text|>role", "x"), (None, 0, "assistant", None)]
    got = said(turns(spark, rows))
    assert got[1] == expect([(None, None), ("user", "a"), ("user", "a"), ("user", "b")])
    assert got[2] == expect([("assistant", "last"), ("weird\n<|text|>role", "x")])
    assert got[None] == expect([("assistant", "")])
    assert said(turns(spark, []).limit(0)) == {}


def test_layouts_of_frames_and_records_agree(spark):
    want = [("user", "hello [INST]"), ("assistant", "yes")]
    message = [{"role": r, "content": t} for r, t in want]
    records = [{"conv_id": 1, "messages": message}, {"conv_id": 2, "prompt": want[0][1], "completion": "yes"},
               {"conv_id": 3, "conversations": [{"from": "human", "value": want[0][1]}, {"from": "gpt", "value": "yes"}]},
               {"conv_id": 4, "instruction": want[0][1], "output": "yes"}, {"conv_id": 5, "instruction": "hello", "input": "[INST]", "output": "yes"},
               {"conv_id": 6, "other": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "json string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in X.digest(X.format_turns(X.canonical_records(df))).collect()}
    assert got == {k: expect(want)[:2] for k in (1, 2, 3, 4)} | {5: expect([("user", "hello\n[INST]"), ("assistant", "yes")])[:2]}
    assert X.unmapped(df).count() == 3
    typed = spark.createDataFrame([(1, [tuple(m.values()) for m in message])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert said(typed)[1] == expect(want)
    # the fingerprint decides: nested and other extra fields are no part of it, clashing names fall back to the most fields
    nested = spark.createDataFrame([(1, [("user", want[0][1], 0.5), ("assistant", "yes", 0.1)], "x")], "conv_id long, messages array<struct<role:string,content:string,score:double>>, note string")
    assert X.fingerprint(X.known_paths(nested.schema)) == X.LAYOUTS[1]["fingerprint"] and said(nested)[1] == expect(want)
    clash = spark.createDataFrame([(1, 0, "user", "a", "other")], "conv_id long, turn long, role string, text string, prompt string")
    assert X.fingerprint(X.known_paths(clash.schema)) not in X.BY_FINGERPRINT and said(clash)[1] == expect([("user", "a")])
    with pytest.raises(ValueError, match="no mapping"):
        X.canonical(spark.createDataFrame([(1, "x")], "conv_id long, words string"))
