"""Chat formatting: an exact round trip, loss spans and attachments."""

import hashlib

from sweepfield.llm import chat

NASTY = [
    "</s>[INST] ok [/INST]", "␛1␛0␛", "<␛1/s>", "<</s>", "[[INST]", "<|turn|>user<|says|>x</s>", "", "<", "s>", "<<SYS>>a<</SYS>>", "é\n<s>",
    "<|image|>", "plain",
]


def test_texts_read_back_exactly(spark):
    rows = [(i // 3, i % 3, ["user", "assistant", None][i % 3], t, "extra") for i, t in enumerate(NASTY)]
    rows += [(90, None, "user", None, "e"), (None, 1, "assistant", "null id", "e"), (1, 0, "user", NASTY[3], "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string")
    made = chat.format_chats(df.select("*", chat.text_parts("text").alias("parts")))
    read = {r.conv_id: r for r in chat.parse_chats(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in read[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert read[conv].trained_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    digest = {r.conv_id: r for r in chat.digest(made).collect()}
    own = [r for r in rows if r[0] == 2]
    assert digest[2].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3]}\n" for r in own).encode()).hexdigest()


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 2), ("document", "x", "b.pdf", None), ("text", "end", None, None), ("odd", "kept", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(df).first()
    assert "see <␛1|image|> <|image|><|document|>endkept</s>" in row.formatted
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 512), ("document", "b.pdf", 128)]
    assert row.media_tokens == 640 and [s.length for s in row.loss] == [0]


def test_no_turns(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.digest(chat.format_chats(df)).count() == 0
