from silverloop.functions import prompts, replies


def test_kv_reply(column):
    cases = {
        "Label: 1\nConfidence: HIGH\nrationale: cites x": ("1", "high", "cites x"),
        "label: 1\nlabel: 0\nrationale: r": ("0", "low", "r"),
        "label: GREEN\nconfidence: very high\nrationale: a: b": ("0", "low", "a: b"),
        "- label: 1": ("0", "low", "- label: 1"),
        "rationale:\nfoo": ("0", "low", "rationale:\nfoo"),
        "x" * 500: ("0", "low", "x" * 300),
        "label: 1\r\nconfidence: low\rrationale: z more": ("1", "low", "z"),
        "  LABEL :1\nlabel:\t1 ": ("1", "low", "LABEL :1\nlabel:\t1"),
    }
    assert column(replies.kv_reply, list(cases)) == list(cases.values())


def test_json_reply(column):
    cases = {
        '{"label": 1, "rationale": "x"}': (1, "x", True),
        'so: {"label": 1, "rationale": "x"} end': (1, "x", True),
        '"label": 0, "rationale": "y"': (0, "y", True),
        '{"label": "1"}': (1, None, True),
        '{"label": true}': (1, None, True),
        '{"label": 0.9}': (0, None, True),
        '{"label": "1.0"}': (1, None, False),
        '{"label": 2}': (None, None, False),
        '{"label": 2, "rationale": "step 1"}': (1, None, False),
        '{"label": 1, "meta": {"k": 2}}': (1, None, True),
        "{'label': 1}": (1, None, False),
        'Score 0.5, "label": 1': (0, None, False),
        "label 10": (None, None, False),
        "": (None, None, False),
        '{"label": 1,}': (1, None, False),
        '{"label": NaN} 0': (0, None, False),
        '{"label": 0, "label": 1}': (1, None, True),
        "[1, 2]": (1, None, False),
        '{"label": 1, "m": {"k": 2}} and {"label": 0}': (1, None, False),
        '{"label": 1, "m": {"k": 2}}, {"label": 0}': (1, None, False),
        '{"label": 1, "m": {"k": 2}}] }': (1, None, False),
        '{"label": 1, "m": {"k": 2}}} }': (1, None, False),
    }
    assert column(replies.json_reply, list(cases)) == list(cases.values())


def test_judge_verdict(column):
    cases = {
        '{"label": 1, "confidence": "high", "rationale": "r"}': (1, "high", "r", False),
        '{"label": "1", "confidence": "High"}': (1, "low", "", False),
        '"label": 1, "confidence": "high"': (1, "high", "No rationale extracted.", False),
        '{"label": 2, "confidence": "medium", "rationale": "r"}': (None, "medium", "r", True),
        '{"label": 1, "meta": {"k": 2}}': (None, "low", 'PARSE FAILED. Raw: {"label": 1, "meta": {"k": 2}}', True),
        '{"label": 1, "rationale": null}': (1, "low", "None", False),
        "no verdict": (None, "low", "PARSE FAILED. Raw: no verdict", True),
        "1": (None, "low", "PARSE FAILED. Raw: 1", True),
        "y" * 400: (None, "low", "PARSE FAILED. Raw: " + "y" * 300, True),
    }
    assert column(replies.judge_verdict, list(cases)) == list(cases.values())


def test_text_after_a_value_is_not_json(column):
    parsed = lambda c: replies.salvaged_json(c).isNotNull()
    assert column(parsed, ["1", "1 foo", "[1] 2", "1], [2", " null ", "1, 2"]) == [True, False, False, False, True, False]


def test_prompt_slots_are_not_searched_again(column):
    claim = 'a {claim} <<advocate>> "quoted"'
    (got,) = column(lambda c: prompts.render("A <<claim>> B <<advocate>> C", claim=c, advocate=c), [claim])
    assert got == f"A {claim} B {claim} C"


def test_prompt_needs_its_slots(column):
    import pytest

    with pytest.raises(ValueError, match="needs slots"):
        prompts.render_named("judge", claim=None)


def test_classifier_prompt_is_one_instruction(column):
    (got,) = column(prompts.classifier_prompt, ["CLAIM TEXT"])
    assert got.startswith("<s>[INST] You are a patent-claims classifier.")
    assert got.endswith("CLAIM:\nCLAIM TEXT\n\nJSON: [/INST]")


def test_targets_are_json():
    import json

    assert json.loads(prompts.TARGET_GREEN)["label"] == 1
    assert json.dumps(json.loads(prompts.TARGET_NOT_GREEN)) == prompts.TARGET_NOT_GREEN


def test_chat_text(spark):
    from silverloop.operators import text

    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (1, 3, "user", "V"), (2, 5, "user", "W")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    got = {(r.conv_id, r.part): r.chat for r in text.chat_render(text.collect_messages(df, part_turns=64)).collect()}
    assert got == {(1, 0): "[INST] S\n\nU [/INST] A</s>[INST] V [/INST]", (2, 0): "[INST] W [/INST]"}


def test_chat_parts_join_to_the_whole(spark):
    from silverloop.operators import text

    roles = ["system", "user", "assistant"] * 7
    rows = [(1, i, role, f"t{i}") for i, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    whole = text.chat_render(text.collect_messages(df, part_turns=1000)).first().chat
    for size in (1, 2, 3, 5):
        parts = text.chat_render(text.collect_messages(df, part_turns=size)).orderBy("part").collect()
        assert "".join(p.chat for p in parts) == whole
