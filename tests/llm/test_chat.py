from ownergraph.llm import chat

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def test_control_strings_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "&lt; &amp;lt; & <s>[user]", "", None, "a\nb", "<image>", "é😀", "]]>[[<"]
    rows = [(1, i, "assistant" if i % 2 else "us]er<", t) for i, t in enumerate(odd)] + [(None, None, None, "x"), (None, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "'z' AS turns")
    made = chat.format_conversations(turns)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(made).collect()}
    assert back == {1: [(r, t or "") for _, _, r, t in rows[:8]], None: [("", "x")] * 2}
    got = {r.conv_id: r for r in made.collect()}
    spans = [chat_unescape(got[1].formatted[s.start : s.stop]) for s in got[1].loss_spans]
    assert spans == [t or "" for t in odd[1::2]]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def chat_unescape(text):
    for plain, code in reversed(chat.ESCAPES):
        text = text.replace(code, plain)
    return text


def test_parts_become_placeholders_in_order(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://a", 57, 28, None, None), ("text", " & ", None, None, None, None, None),
             ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, None, None, None, None, 3), ("odd", "<x>", None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows = [(1, 2, "user", parts), (1, 3, "assistant", None), (1, 1, "user", [("image", None, "c", None, None, None, None)])]
    made = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")).first()
    assert made.formatted == "<s>[user]<image></s><s>[user]see <image> &amp; <audio><document>&lt;x&gt;</s><s>[assistant]</s>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in made.attachments] == [(1, "image", "c", 1), (2, "image", "s3://a", 3), (2, "audio", "b.wav", 38), (2, "document", None, 1536)]
    assert made.attachment_tokens == 1578


def test_a_long_conversation(spark):
    turns = spark.range(6000).selectExpr("7 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    made = chat.format_conversations(turns).first()
    assert len(made.loss_spans) == 3000 and made.formatted[made.loss_spans[-1].start : made.loss_spans[-1].stop] == "t5999"
