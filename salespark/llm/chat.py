"""Chat formatting with typed content parts.

A message is a turn of a conversation; its content is a list of parts, each of a
kind: ``text``, ``image``, ``audio`` or ``document`` (any other kind counts as a
document).  A visitor (``Flattener``) goes over the parts in order and flattens them
into one string: text is escaped and copied, any other part leaves a placeholder.
For each placeholder it records the attachment: its place in the conversation's
text, its reference, and the number of tokens it will expand to.

The template marks every turn by control strings: ``[INST]`` text ``[/INST]`` for a
user, text ``</s>`` for an assistant, ``[SYS]`` text ``[/SYS]`` for a system message,
``[ROLE]`` role ``[TEXT]`` text ``[/ROLE]`` for any other role.  A control string
inside a text gets a backslash after its first character, and a backslash is
doubled; so no escaped text holds a control string, and ``unescaped`` gives the
text back.  The loss mask has the text parts of assistant turns, without marks and
placeholders, as spans of code points.

A formatted turn needs no other turn, so a conversation is stored as segments: whole
turns in order, up to ``SEGMENT`` code points, a longer turn alone.  Rows are dealt
out by conversation and stretches of ``STRETCH`` turns, so a conversation of any
length is formatted by many tasks, and none holds more than one segment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import sha256
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.llm import common

#: Marks of a turn by role, before and after its content.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
CONTROLS = ("<s>", *(m for pair in TURNS.values() for m in pair if m), *OTHER, *PLACEHOLDERS.values())
LEARNED = "assistant"
#: A conversation whose texts are made of control strings.
CONTROL_ROWS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
#: Code points of a segment, turns of a stretch.
SEGMENT, STRETCH = 16_384, 4_096
#: Pixels a side of an image token, audio tokens a second, tokens of a document page.
PATCH, RATE, PAGE = 28, 25, 576

PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
SEGMENTS = ("conv_id long, segment long, n_turns long, formatted string, chars long, "
            "loss array<struct<start:long,end:long>>, "
            "attachments array<struct<at:long,kind:string,ref:string,tokens:long>>, expanded_tokens long")

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(\\?)")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escaped(text: str) -> str:
    """Text that holds no control string, and every backslash twice."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    """The text that ``escaped`` was given."""
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor over the parts of messages: pieces of flat text, with their length,
    the loss mask and the attachments so far."""

    pieces: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    learned: bool = False

    def turn(self, role: str, parts: list[dict]) -> None:
        """One message: marks and content."""
        if role in TURNS:
            before, after = TURNS[role]
            self.mark(before)
        else:
            self.mark(OTHER[0] + escaped(role) + OTHER[1])
            after = OTHER[2]
        self.learned = role == LEARNED
        for part in parts:
            visit = getattr(self, f"visit_{part.get('kind')}", self.visit_document)
            visit(part)
        self.mark(after)

    def mark(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            self.at += len(text)

    def visit_text(self, part: dict) -> None:
        start = self.at
        self.mark(escaped(part.get("text") or ""))
        if self.learned and self.at > start:
            if self.loss and self.loss[-1][1] == start:
                start = self.loss.pop()[0]
            self.loss.append((start, self.at))

    def visit_image(self, part: dict) -> None:
        side = [ceil((part.get(s) or 0) / PATCH) for s in ("width", "height")]
        self._attach("image", part, side[0] * side[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, ceil((part.get("seconds") or 0) * RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((self.at, kind, part.get("ref"), max(tokens, 1)))
        self.mark(PLACEHOLDERS[kind])


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, escaped content) of each turn of a formatted text."""
    opened = {before: (role, after) for role, (before, after) in TURNS.items() if before}
    bare = next(role for role, (before, _) in TURNS.items() if not before)
    turns, at = [], 0
    while at < len(formatted):
        control = next((c for c in (*opened, OTHER[0]) if formatted.startswith(c, at)), "")
        role, after = opened.get(control, (bare, TURNS[bare][1]))
        at += len(control)
        if control == OTHER[0]:
            end = formatted.index(OTHER[1], at)
            role, after, at = unescaped(formatted[at:end]), OTHER[2], end + len(OTHER[1])
        end = formatted.index(after, at)
        turns.append((role, formatted[at:end]))
        at = end + len(after)
    return turns


def content(text: str) -> str:
    """What a turn's escaped content says, placeholders left out."""
    return unescaped(_CONTROL.sub("", text))


def text_parts(messages: DataFrame) -> DataFrame:
    """Messages of plain text (conv_id, turn, role, text) as messages of one text part;
    a null text is empty."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                    *(F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")))
    return messages.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def formatted(messages: DataFrame) -> DataFrame:
    """Segments (``SEGMENTS``) of messages (conv_id, turn, role, parts array of ``PART``).

    Turns go by ``turn`` (null first); rows of one turn by role, then by a hash of
    their parts.  A null role is an empty one, null parts and null texts are empty, and
    so is a message without parts.  A null conv_id is a conversation like any other.
    Positions count code points from the segment's start.  Extra columns are left out.
    An empty table gives no rows.
    """
    common.ship(messages.sparkSession)
    turn = F.col("turn").cast("long")
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).cast("binary").alias("role"),
        F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.struct(
            p["kind"].alias("kind"), p["text"].cast("binary").alias("text"), p["ref"].alias("ref"),
            p["width"].alias("width"), p["height"].alias("height"), p["seconds"].alias("seconds"),
            p["pages"].alias("pages"))).alias("parts"))
    rows = rows.withColumns({"stretch": F.floor(F.col("turn") / STRETCH), "tie": F.xxhash64("parts")})

    def run(batches):
        import pyarrow as pa

        key, number, turns, flat = None, 0, 0, Flattener()

        def closed():
            nonlocal number, turns, flat
            text = "".join(flat.pieces).encode("utf-8", "surrogateescape")
            # segments of a stretch come after those of the stretches before it
            place = ((key[1] if key[1] is not None else -(1 << 31)) << 32) + number
            batch = pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int64()), pa.array([place], pa.int64()), pa.array([turns], pa.int64()),
                pa.array([text], pa.binary()), pa.array([flat.at], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in flat.loss]], loss_type),
                pa.array([[{"at": a, "kind": k, "ref": r, "tokens": n} for a, k, r, n in flat.attachments]], held_type),
                pa.array([sum(a[3] for a in flat.attachments)], pa.int64())], names)
            number, turns, flat = number + 1, 0, Flattener()
            return batch

        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        held_type = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        names = ["conv_id", "segment", "n_turns", "formatted", "chars", "loss", "attachments", "expanded_tokens"]
        for batch in batches:
            for conv, stretch, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stretch", "role", "parts"))):
                if (conv, stretch) != key:
                    if turns:
                        yield closed()
                    key, number = (conv, stretch), 0
                for p in parts:
                    p["text"] = p["text"].decode("utf-8", "surrogateescape") if p["text"] is not None else None
                size = sum(len(p["text"] or "") for p in parts)
                if turns and flat.at + size > SEGMENT:
                    yield closed()
                flat.turn(role.decode("utf-8", "surrogateescape"), parts)
                turns += 1
        if turns:
            yield closed()

    return (rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "tie")
            .select("conv_id", "stretch", "role", "parts")
            .mapInArrow(run, SEGMENTS.replace("formatted string", "formatted binary"))
            .withColumn("formatted", F.col("formatted").cast("string")))


class _Digest:
    """Running digest of a conversation, read from its formatted segments in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars, self.tokens, self.held = conv, 0, 0, 0, 0, 0
        self.whole, self.learned = sha256(), sha256()

    def add(self, formatted: str, loss: list[dict], attachments: int, tokens: int) -> None:
        for role, text in parsed(formatted):
            self.whole.update(f"{role}\n{content(text)}\n".encode("utf-8", "surrogateescape"))
            self.turns += 1
        for span in loss:
            text = unescaped(formatted[span["start"]:span["end"]])
            self.learned.update(text.encode("utf-8", "surrogateescape"))
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.held += attachments
        self.tokens += tokens

    def row(self) -> tuple:
        return (self.conv, self.turns, self.whole.hexdigest(), self.loss_chars, self.learned.hexdigest(),
                self.chars, self.held, self.tokens)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_attachments long, expanded_tokens long")


def _digests(batches):
    """mapInArrow over segments, those of a conversation together and in order."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in DIGEST.split(", ")]
    now = None
    for batch in batches:
        rows = []
        for conv, text, loss, held, tokens in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "formatted", "loss", "n_attachments", "expanded_tokens"))):
            if now is None or conv != now.conv:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv)
            now.add(text.decode("utf-8", "surrogateescape"), loss, held, tokens)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [()] * len(fields), fields)],
            [n for n, _ in fields])
    if now is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], kinds[k]) for v, (_, k) in zip(now.row(), fields)], [n for n, _ in fields])


def digest(segments: DataFrame) -> DataFrame:
    """One row a conversation (``DIGEST``), read from its formatted segments.

    A conversation of one segment, as nearly all are, is read where it lies.  Only
    those of several segments are brought together; a SHA-256 over all turns is
    sequential, so these stream through one task in order, a batch at a time.
    """
    rows = segments.select("conv_id", "segment", F.col("formatted").cast("binary").alias("formatted"), "loss",
                           F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    several = common.written(
        segments.groupBy(F.col("conv_id").alias("conv")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv"),
        "chat-long")
    same = F.expr("conv_id <=> conv")
    short = rows.join(several, same, "left_anti").mapInArrow(_digests, DIGEST)
    long = (rows.join(several, same, "left_semi").repartition("conv_id")
            .sortWithinPartitions("conv_id", "segment").mapInArrow(_digests, DIGEST))
    return short.unionByName(long)


def oracle() -> str:
    """The digest as DuckDB SQL over ``conversations`` and the rows of ``CONTROL_ROWS``."""
    def size(text: str) -> str:
        extra = "".join(f" + (length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in CONTROLS)
        return f"(2 * length({text}) - length(replace({text}, chr(92), '')){extra})"

    marks = " ".join(f"WHEN '{role}' THEN {len(before) + len(after)}" for role, (before, after) in TURNS.items())
    own = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_ROWS)
    turns = "string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)"
    learned = f"string_agg(text, '' ORDER BY turn) FILTER (role = '{LEARNED}')"
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {own}))
SELECT conv_id, count(*) AS n_turns, sha256({turns}) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce({learned}, '')) AS loss_sha256,
  CAST(sum({size('text')} + CASE role {marks} ELSE {size('role')} + {sum(map(len, OTHER))} END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM c GROUP BY conv_id"""
