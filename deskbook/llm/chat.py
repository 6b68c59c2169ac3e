"""Chat formatting by a grammar round trip.

Every turn is rendered with a template whose turns sit between control strings. A deterministic parser reads the
rendered text back; where what it recovers differs from the source, control strings inside the content are escaped and
the turn is rendered again, until the round trip is identical. Escaping puts one backslash after the opening bracket of a
control string (or of one that already has backslashes there), so it can be undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, table

#: Opening and closing control strings of each role; OTHER carries the role's name as a first field.
TURNS = {"system": ("<s>[SYS]", "[/SYS]</s>"), "user": ("<s>[INST]", "[/INST]</s>"), "assistant": ("<s>[BOT]", "[/BOT]</s>")}
OTHER = ("<s>[ROLE]", "[AS]", "[/ROLE]</s>")
CONTROL = re.compile(r"[<\[]/?(?:s>|SYS\]|INST\]|BOT\]|ROLE\]|AS\])")
#: A control string with any number of backslashes behind its bracket: what escaping shifts by one.
SHIFTED = re.compile(r"([<\[])(\\*)(/?(?:s>|SYS\]|INST\]|BOT\]|ROLE\]|AS\]))")
UNSHIFT = re.compile(r"([<\[])\\(\\*/?(?:s>|SYS\]|INST\]|BOT\]|ROLE\]|AS\]))")
OPENERS = {opening: role for role, (opening, _) in TURNS.items()}


def escape(text: str) -> str:
    return SHIFTED.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNSHIFT.sub(r"\1\2", text)


def render(role: str, text: str) -> str:
    if role in TURNS:
        opening, closing = TURNS[role]
        return opening + text + closing
    return OTHER[0] + role + OTHER[1] + text + OTHER[2]


class Parser:
    """Deterministic parser of rendered text that arrives in parts; what it reads does not depend on where parts end.

    The grammar is regular: an opener, content without bare control strings, the closer that belongs to the opener. The
    parser walks from control string to control string, so one pass decides; it keeps the text of one open turn.
    """

    def __init__(self):
        self.rest = ""

    def feed(self, part: str) -> list[tuple[str, str, int, int]]:
        """Turns ``(role, unescaped text, start, end)`` that ``part`` completes, bounds in the text kept and ``part``; ValueError outside the grammar."""
        rendered, turns, at = self.rest + part, [], 0
        while at < len(rendered) and (turn := self._turn(rendered, at)):
            turns.append(turn[:4])
            at = turn[4]
        self.rest = rendered[at:]
        return turns

    @staticmethod
    def _turn(rendered: str, at: int) -> tuple[str, str, int, int, int] | None:
        """The turn at a place and where it ends; None if more text is needed to tell."""
        opener = next((o for o in (*OPENERS, OTHER[0]) if rendered.startswith(o, at)), None)
        if opener is None:
            if any(o.startswith(rendered[at:]) for o in (*OPENERS, OTHER[0])):
                return None
            raise ValueError("no turn begins here")
        start = at + len(opener)
        if opener == OTHER[0]:
            bar = CONTROL.search(rendered, start)
            if bar and bar[0] != OTHER[1]:
                raise ValueError("a role's name is not closed")
            if not bar:
                return None
            role, closer, start = unescape(rendered[start : bar.start()]), OTHER[2], bar.end()
        else:
            role, closer = OPENERS[opener], TURNS[OPENERS[opener]][1]
        end = CONTROL.search(rendered, start)
        if not end or closer.startswith(rendered[end.start() :]) and len(rendered) - end.start() < len(closer):
            return None
        if not rendered.startswith(closer, end.start()):
            raise ValueError("a turn is closed by another control string")
        return role, unescape(rendered[start : end.start()]), start, end.start(), end.start() + len(closer)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns of a whole rendered text (see ``Parser``); None if it is not of the grammar."""
    parser = Parser()
    try:
        turns = parser.feed(rendered)
    except ValueError:
        return None
    return None if parser.rest else turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn with the bounds of its content: verbatim if that survives the round trip, else escaped."""
    for body, name in ((text, role), (escape(text), role), (escape(text), escape(role))):
        piece = render(name, body)
        back = parse(piece)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return piece, back[0][2], back[0][3]
    raise ValueError("a turn does not survive its round trip")


PIECE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("source", pa.binary())])


def turn_digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> ``conv_id, turn, role, piece, loss_start, loss_end, source``, a row for each turn.

    A conversation's formatted text is its pieces in the order of turn, role and piece; loss_start and loss_end bound the
    learnt content inside the piece in code points and are null unless the role is ``assistant``; source is a digest of
    role and text, for the comparison after the round trip. No shuffle: a turn's rendering does not depend on its
    neighbours. Null text is empty text, a null role is the role with an empty name, null ids stay null and empty and
    repeated rows are turns like any other. An empty table gives no rows. Extra columns are dropped.
    """
    lean_batches(turns.sparkSession)
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, texts)]
            bounds = [[m[k] if r == "assistant" else None for m, r in zip(made, roles)] for k in (1, 2)]
            columns = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), [m[0] for m in made], *bounds, list(map(turn_digest, roles, texts))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    return source.mapInArrow(run, "conv_id long, turn long, role string, piece string, loss_start long, loss_end long, source binary")


class Reading:
    """One conversation as the parser reads it back: counts and running digests, whatever its length."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parser, self.sources = conv_id, Parser(), []
        self.turns, self.loss, self.n_turns, self.n_loss, self.n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, start: int | None, end: int | None, source: bytes) -> None:
        self.sources.append(source)
        for role, text, _, _ in self.parser.feed(piece):
            if not self.sources or turn_digest(role, text) != self.sources.pop(0):
                raise ValueError("a conversation does not survive its round trip")
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescape(piece[start:end])
            self.n_loss += len(learnt)
            self.loss.update(learnt.encode())
        self.n_chars += len(piece)

    def row(self) -> tuple:
        if self.parser.rest or self.sources:
            raise ValueError("a conversation's formatted text does not end with a turn")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_chars


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Read the formatted conversations back: one row a conversation with digests of what the parser recovers.

    Pieces are dealt by conversation and sorted, and their text is parsed as a whole by a parser that they are fed to; the
    turns that it recovers must be those of the source. A digest of a conversation needs its turns one after another, so a
    conversation is read by one task, in a few hash states of memory and never as a list of turns; the rendering before
    that is dealt out by turns. Pieces, roles and digests of 16 bytes travel.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece", "loss_start", "loss_end", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, out = None, []
        for batch in batches:
            for conv, piece, start, end, source in zip(*(c.to_pylist() for c in batch.columns)):
                if reading is None or conv != reading.conv_id:
                    if reading is not None:
                        out.append(reading.row())
                    reading = Reading(conv)
                reading.add(piece, start, end, source)
            yield from rows(out)
            out = []
        if reading is not None:
            yield from rows([reading.row()])

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), DIGESTS)], schema=DIGESTS)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose two turns hold control strings."""
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and the probe, formatted and read back; cases as in ``format_turns``."""
    return conversation_digests(format_turns(with_probe(table(spark, sf_dir, "conversations"))))


_MARKS = r"(s>|SYS\]|INST\]|BOT\]|ROLE\]|AS\])"
OP10_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, regexp_replace(text, '([<\\[])(\\\\*/?{_MARKS})', '\\1\\\\\\2', 'g') || case role when 'system' then '[/SYS]</s>' when 'user' then '[/INST]</s>' when 'assistant' then '[/BOT]</s>' else '[/ROLE]</s>' end as body
  from t),
sized as (
  select *, length(body) + case role when 'system' then 8 when 'user' then 9 when 'assistant' then 8 else 13 + length(regexp_replace(role, '([<\\[])(\\\\*/?{_MARKS})', '\\1\\\\\\2', 'g')) end as chars
  from escaped)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, body), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""
