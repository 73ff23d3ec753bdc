"""Prompt template and label-masked token sequences (the reference's tokenizer tests)."""

from tunedata.operators import chat as H

REC = "instruction string, input string, output string"


def test_prompt_template_and_masking(spark):
    df = spark.createDataFrame([("Add", "1 and 2", "3"), ("Hi", None, "Hello")], REC)
    rows = H.sft_tokens(df, bos="<s>", eos="</s>").select(
        H.prompt_template(bos="<s>").alias("p"), "input_ids", "labels", "attention_mask").collect()
    p0 = "<s>Instruction: Add\nInput: 1 and 2\nResponse: "
    assert rows[0].p == p0 and rows[1].p == "<s>Instruction: Hi\nResponse: "
    ids = [ord(c) for c in p0 + "3</s>"]
    assert rows[0].input_ids == ids
    assert rows[0].labels == [-100] * len(p0) + [ord(c) for c in "3</s>"]
    assert rows[0].attention_mask == [1] * len(ids)


def test_truncation_to_max_length(spark):
    df = spark.createDataFrame([("x" * 600, "", "y" * 10)], REC)
    r = H.sft_tokens(df, max_length=512).first()
    assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 512
    assert set(r.labels) == {-100}


def test_pluggable_encoder(spark):
    df = spark.createDataFrame([("ab cd", "", "efg")], REC)
    enc = H.encode_with(lambda s: [len(w) for w in s.split()])
    r = H.sft_tokens(df, encoder=enc).first()
    # prompt "Instruction: ab cd\nResponse: " -> words: Instruction:, ab, cd, Response:
    assert r.input_ids == [12, 2, 2, 9, 3] and r.labels == [-100, -100, -100, -100, 3]


def test_chat_messages_context_block(spark):
    df = spark.createDataFrame([("Q", "ctx", "A"), ("Q2", "", "A2")], REC)
    m = [r.messages for r in H.chat_messages(df).collect()]
    assert m[0][1]["content"] == "Q\n\nContext:\nctx" and m[1][1]["content"] == "Q2"
    assert [x["role"] for x in m[0]] == ["system", "user", "assistant"]
    assert m[0][0]["content"] == "You are a helpful assistant."
