"""Chat formatting: round trips, masks, attachments, and digests against a plain count."""

from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from salespark.llm import chat

MARKS = st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "[", "/", "s>", "INST]", "a", " ", "\n", "é", "🙂"])
TEXT = st.lists(MARKS, max_size=12).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, stretch long, segment string, tie int"


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_escape_round_trip(text):
    safe = chat.escaped(text)
    assert not any(c in safe for c in chat.CONTROLS)
    assert chat.unescaped(safe) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=6))
def test_turns_round_trip(turns):
    flat = chat.Flattener()
    for role, text in turns:
        flat.turn(role, [{"kind": "text", "text": text}])
    formatted = "".join(flat.pieces)
    assert [(r, chat.content(t)) for r, t in chat.parsed(formatted)] == turns
    assert flat.at == len(formatted)
    learned = "".join(chat.unescaped(formatted[s:e]) for s, e in flat.loss)
    assert learned == "".join(t for r, t in turns if r == "assistant")


def test_parts_in_order():
    flat = chat.Flattener()
    flat.turn("user", [{"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 57, "height": 28},
                       {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, {"kind": "text", "text": " [IMAGE]"}])
    flat.turn("assistant", [{"kind": "text", "text": "one"}, {"kind": "document", "ref": "c.pdf", "pages": 2},
                            {"kind": "table"}, {"kind": "text", "text": "two"}, {"kind": "text", "text": "!"}])
    text = "".join(flat.pieces)
    assert text == "[INST]see [IMAGE][AUDIO] [\\IMAGE][/INST]one[DOCUMENT][DOCUMENT]two!</s>"
    assert flat.attachments == [(10, "image", "a.png", 3), (17, "audio", "b.wav", 38),
                                (text.index("one") + 3, "document", "c.pdf", 1152), (text.index("one") + 13, "document", None, 1)]
    assert [text[s:e] for s, e in flat.loss] == ["one", "two!"]


def digest(rows):
    """Plain digests of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for r, t in own if r == "assistant")
        flat = chat.Flattener()
        for role, text in own:
            flat.turn(role, [{"kind": "text", "text": text}])
        out[conv] = (len(own), sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(learned),
                     sha256(learned.encode()).hexdigest(), len("".join(flat.pieces)))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)
    segments = chat.formatted(chat.text_parts(frame)).cache()
    got = {r.conv_id: tuple(r)[1:6] for r in chat.digest(segments).collect()}
    assert got == digest(rows) and len(got) == len({r[0] for r in rows})
    return segments


def test_conversations(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", f"text {i} {t} </s>") for i in range(30) for t in range(4)]
    rows += [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    check(spark, rows)


def test_long_conversation_lies_in_many_segments(spark):
    """Over segments and stretches, a hot conversation keeps its order."""
    rows = [(1, t, ("system", "user", "assistant")[t % 3], "wörd " * (t % 40)) for t in range(2 * chat.STRETCH + 10)]
    rows += [(2, 0, "user", "x" * 100_000), (2, 1, "assistant", "\\" * 50_000), (3, -5, "user", "before"), (3, 5, "assistant", "after")]
    segments = check(spark, rows).collect()
    assert sum(s.conv_id == 1 for s in segments) > 20
    assert all(len(s.formatted) == s.chars for s in segments)
    assert all(s.chars <= chat.SEGMENT + 5000 for s in segments if s.conv_id == 1)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", ""), (5, None, "user", None), (5, 0, "", "no role"),
            (5, 2, "to\nol", "a\nb"), (5, 3, "[ROLE]", "[/ROLE]"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"),
            (7, 1, "user", "b"), (7, 1, "assistant", "a"), (8, 0, "User", "upper")]
    check(spark, rows)


def test_empty(spark):
    segments = chat.formatted(chat.text_parts(spark.createDataFrame([], SCHEMA)))
    assert segments.count() == 0 and chat.digest(segments).count() == 0


def test_typed_parts_in_a_table(spark):
    rows = spark.sql(f"""SELECT 1L conv_id, 0L turn, 'user' role, CAST(array(
        struct('image' kind, CAST(NULL AS STRING) text, 'a.png' ref, 56 width, 56 height, CAST(NULL AS DOUBLE) seconds,
               CAST(NULL AS INT) pages)) AS array<{chat.PART}>) parts
        UNION ALL SELECT 1L, 1L, 'assistant', NULL""")
    (got,) = chat.formatted(rows).collect()
    assert got.formatted == "[INST][IMAGE][/INST]</s>" and got.expanded_tokens == 4
    assert [tuple(a) for a in got.attachments] == [(6, "image", "a.png", 4)]
    (row,) = chat.digest(spark.createDataFrame([got], chat.SEGMENTS)).collect()
    assert (row.n_turns, row.loss_chars, row.n_attachments, row.expanded_tokens) == (2, 0, 1, 4)
