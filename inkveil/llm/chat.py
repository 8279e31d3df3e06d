r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"
    body, role   := characters without control strings, or escapes
    escape       := "\" ( "\" | "###" | "</turn>" | ":" )

Text is rendered as it is; the rendering is reparsed by the deterministic parser below and compared
with the source. A turn that the parser does not give back is rendered again with its conflicting
content escaped, until all turns are identical. So ordinary text, lone backslashes included, stays
unchanged, and every rendering reads back to its source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

_ROLE = re.compile(r"\\(\\|###|</turn>|:)|(###|</turn>|: )")
_BODY = re.compile(r"\\(\\|###|</turn>|:)|(###|</turn>)")
_CONFLICT = re.compile(r"\\|###|</turn>")
_ROLE_CONFLICT = re.compile(r"\\|###|</turn>|:")


class Malformed(ValueError):
    """The text is not derived from the grammar."""


def _escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def _scan(text: str, at: int, pattern: re.Pattern, stop: str) -> tuple[str, int]:
    """The unescaped field that begins at `at`, and where its closing control string begins."""
    parts = []
    for m in pattern.finditer(text, at):
        parts.append(text[at : m.start()])
        if m[2] is not None:
            if m[2] != stop:
                raise Malformed(m[2])
            return "".join(parts), m.start()
        parts.append(m[1])
        at = m.end()
    raise Malformed("open turn")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, body, and the body's range in text, turn by turn."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Malformed("no turn")
        role, at = _scan(text, at + len(OPEN), _ROLE, BETWEEN)
        begin = at + len(BETWEEN)
        body, end = _scan(text, begin, _BODY, CLOSE[:-1])
        if not text.startswith(CLOSE, end):
            raise Malformed("no line end")
        yield role, body, begin, end
        at = end + len(CLOSE)


def render_turn(role: str, text: str) -> str:
    """As it is, or with what conflicts escaped: the first rendering that parses back to the source."""
    for r, t in ((role, text), (role, _escape(text, _CONFLICT)), (_escape(role, _ROLE_CONFLICT), _escape(text, _CONFLICT))):
        out = f"{OPEN}{r}{BETWEEN}{t}{CLOSE}"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except Malformed:
            pass
    raise Malformed("no rendering reads back")  # cannot occur: the last form escapes every control string


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(render_turn(*x) for x in turns)


def loss_spans(text: str) -> list[tuple[int, int]]:
    """Ranges of the formatted text that the loss covers: the bodies of assistant turns."""
    return [(a, b) for role, _, a, b in parse(text) if role == LOSS_ROLE]


def unescape(body: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", body)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, text (formatted) and loss (array of begin, end in characters).

    Turns go by turn number (null first); equal numbers by role, then text; repeated rows stay. Null roles and
    texts are empty; rows without conv_id form one conversation with a null id. Escaping runs before the
    shuffle's consumers see a row; conversations are streamed from sorted partitions, one at a time.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    dealt = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = pa.schema([("conv_id", id_type(kind)), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
        key, turns, ready = None, [], []

        def close() -> None:
            if turns:
                text = render(turns)
                ready.append({"conv_id": key, "text": text, "loss": [{"begin": a, "end": b} for a, b in loss_spans(text)]})

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and conv != key:
                    close()
                    turns = []
                    if len(ready) >= 500:
                        yield pa.RecordBatch.from_pylist(ready, out_schema)
                        ready.clear()
                key = conv
                turns.append((role, text))
        close()
        yield pa.RecordBatch.from_pylist(ready, out_schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, text string, loss array<struct<begin:long,end:long>>")


def id_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def digest(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted texts and loss masks: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, covered, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, body, _, _ in parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in loss:
                    part = unescape(text[span["begin"] : span["end"]])
                    covered.update(part.encode())
                    chars += len(part)
                rows.append((n, turns.hexdigest(), chars, covered.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "text", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
