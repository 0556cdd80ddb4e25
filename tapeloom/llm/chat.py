r"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn. The rendered text is parsed again by a
deterministic parser and the recovered turns are compared with the source; the
turns that conflict with the grammar are escaped, until the round trip is
exact. The loss mask covers the assistant texts as they stand in the output,
and is taken from the parse.

A turn is read from its own mark to its first close, so turns are rendered and
proved one by one, a row each, and a conversation's output is its blocks in
order. No task holds a whole conversation, however long it is.

Grammar of the output: ``turn*``, a turn being ``### role: text</turn>`` and a
line end, where the text holds neither ``###`` nor ``</turn>``. A text that
starts with ``\~`` is escaped: behind these two characters a backslash is
doubled, ``#`` is ``\h`` and ``<`` is ``\l``. Any other text is plain. In a
role a backslash is doubled, ``:`` is ``\c`` and a line end is ``\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, BETWEEN, CLOSE, ESCAPED = "###", ": ", "</turn>\n", "\\~"
_TURN = re.compile(r"### ([^:\n]*): (.*?)</turn>\n", re.S)
_ROLE_OUT = {"\\": "\\\\", ":": "\\c", "\n": "\\n"}
_ROLE_IN = {"\\": "\\", "c": ":", "n": "\n"}
_TEXT_OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_TEXT_IN = {"\\": "\\", "h": "#", "l": "<"}


def _escape(s: str, table: dict[str, str]) -> str:
    return "".join(table.get(c, c) for c in s)


def _unescape(s: str, table: dict[str, str]) -> str:
    return re.sub(r"\\(.)", lambda m: table[m[1]], s, flags=re.S)


def render_turn(role: str, text: str, escaped: bool) -> str:
    body = ESCAPED + _escape(text, _TEXT_OUT) if escaped else text
    return f"{MARK} {_escape(role, _ROLE_OUT)}{BETWEEN}{body}{CLOSE}"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end cover the text's characters in ``rendered``."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or MARK in m[2] or "</turn>" in m[2]:
            raise ValueError(f"no turn at {at}")
        text, start = m[2], m.start(2)
        if text.startswith(ESCAPED):
            text, start = _unescape(text[2:], _TEXT_IN), start + 2
        turns.append((_unescape(m[1], _ROLE_IN), text, start, m.end(2)))
        at = m.end()
    return turns


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[bool]]:
    """Rendered text and which turns are escaped, such that ``parse`` gives back ``turns``."""
    escaped = [False] * len(turns)
    while True:
        blocks = [render_turn(r, t, e) for (r, t), e in zip(turns, escaped)]
        rendered = "".join(blocks)
        if _reads_as(rendered, turns):
            return rendered, escaped
        # a turn is read from its own mark to its first close, so a conflict shows in its block alone
        conflicts = [k for k, e in enumerate(escaped) if not e and not _reads_as(blocks[k], [turns[k]])]
        for k in conflicts or [k for k, e in enumerate(escaped) if not e][:1]:
            escaped[k] = True


def _reads_as(rendered: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(rendered)] == turns
    except (ValueError, KeyError):
        return False


def loss_spans(parsed: list[tuple[str, str, int, int]], role: str = "assistant") -> list[tuple[int, int]]:
    return [(a, b) for r, _, a, b in parsed if r == role]


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, block, mask, escaped): one row per turn.

    ``block`` is the turn as rendered; a conversation's output is its blocks by
    turn, then role, then text. ``mask``: start and end of the loss in the block
    (code points), null for other roles than the assistant's. Repeated rows are
    repeated turns. Null texts and roles count as empty. Rows with a null
    conversation id form one conversation. Extra columns are not read. An empty
    table gives no rows.
    """
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("block string, mask struct<start:int,end:int>, escaped boolean")
    def render(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for role, text in zip(roles, texts):
            block, (escaped,) = format_conversation([(role, text)])
            spans = loss_spans(parse(block))
            out.append((block, {"start": spans[0][0], "end": spans[0][1]} if spans else None, escaped))
        return pd.DataFrame(out, columns=["block", "mask", "escaped"])

    return turns.withColumn("x", render("role", "text")).select(F.col("conv").alias(conv_col), "turn", "role", "text", "x.*")


def masked_text(block: str, start: int, end: int) -> str:
    """What stands under a mask, unescaped if the marker of escaped texts stands before it."""
    cut = block[start:end]
    return _unescape(cut, _TEXT_IN) if block[max(0, start - 4):start] == BETWEEN + ESCAPED else cut


def read_back_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the blocks of ``format_turns`` hold, one row per conversation: turns, digests and the text under the loss mask.

    Blocks are parsed, and masks cut from them, wherever they are; then a
    conversation's rows stream in order through its two running digests.
    """
    kind = turns.schema[conv_col].dataType

    @F.pandas_udf("turns int, read string, loss string, chars long")
    def read(blocks: pd.Series, masks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, start, end in zip(blocks, masks["start"], masks["end"]):
            parsed = parse(block)
            loss = None if start is None or start != start else masked_text(block, int(start), int(end))
            out.append((len(parsed), "".join(f"{role}\n{text}\n" for role, text, _, _ in parsed), loss, len(block)))
        return pd.DataFrame(out, columns=["turns", "read", "loss", "chars"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def done() -> tuple:
            n, whole, loss_chars, loss, chars = state
            return conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            out = []
            for own, n, text, loss, chars in zip(batch["conv"], batch["turns"], batch["read"], batch["loss"], batch["chars"]):
                if state is None or own != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(text.encode("utf-8", "surrogatepass"))
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += chars
            yield pd.DataFrame(out, columns=DIGEST)
        if state is not None:
            yield pd.DataFrame([done()], columns=DIGEST)

    # a null id and an empty one stay apart as text
    named = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    each = turns.select(named.alias("conv"), "turn", "role", "text", read("block", "mask").alias("x")).select("conv", "turn", "role", "text", "x.*")
    rows = (each.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turns", "read", "loss", "chars")
            .mapInPandas(digest, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    back = F.when(F.col("conv") != "null", F.substr("conv", F.lit(2)).cast(kind))
    return rows.select(back.alias(conv_col), *DIGEST[1:])


DIGEST = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans, escaped): one row per conversation, for conversations that fit one; ``format_turns`` is for all.

    Rows of a conversation are ordered by turn, then role, then text; repeated
    rows are repeated turns. Null texts and roles count as empty. Rows with a
    null conversation id form one conversation. Extra columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:int,end:int>>, escaped array<boolean>")
    def render(turns: pd.Series) -> pd.DataFrame:
        out = []
        for conversation in turns:
            text, escaped = format_conversation([(t["role"], t["text"]) for t in conversation])
            out.append((text, [{"start": a, "end": b} for a, b in loss_spans(parse(text))], escaped))
        return pd.DataFrame(out, columns=["formatted", "loss_spans", "escaped"])

    return grouped.select(conv_col, render("turns").alias("x")).select(conv_col, "x.*")


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted text holds: turns and digests by parsing it, the loss by cutting it at the mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(formatted, spans):
            parsed = parse(text)
            whole = hashlib.sha256()
            for role, body, _, _ in parsed:
                whole.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(masked_text(text, s["start"], s["end"]) for s in own)
            out.append((len(parsed), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select(conv_col, digest("formatted", "loss_spans").alias("x")).select(conv_col, "x.*")
