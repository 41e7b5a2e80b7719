"""Chat formatting with a black-box template: turns are located by rendering successive prefixes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import written

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = 64     # turns that are rendered together
LOSS_ROLES = ("assistant",)

Messages = Sequence[tuple[str, str]]
FORMATTED = ("conv_id long, segment long, part int, n_turns int, formatted string, "
             "loss array<struct<start: int, stop: int>>, rewritten boolean")


def escape(text: str) -> str:
    """No control string remains: a backslash stands before each backslash and inside each `<|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def marked(messages: Messages) -> str:
    """The template used here: each turn between its marks, the role on a line before the text."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse_marked(formatted: str) -> list[tuple[str, str]]:
    """The turns back from text in the template `marked`."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("text outside the marked turns")
    return turns


def render(template: Callable[[Messages], str], messages: Messages, loss_roles: Sequence[str] = LOSS_ROLES):
    """(text, spans of the turns, spans under the loss, whether history was rewritten), the template being a black box.

    The template is called on each prefix; what a turn adds to the text is its span.  Where a text does not begin with
    the one before it, the template has rewritten history: spans found so far no longer hold and are given up.  Within
    the span of a turn under the loss, the content is located by two probes in its place that differ at once.
    """
    text, turns, loss, rewritten = "", [], [], False
    for k, (role, _) in enumerate(messages):
        before, text = text, template(messages[:k + 1])
        if not text.startswith(before):
            turns, loss, rewritten, before = [None] * k, [], True, ""
            turns.append(None)
            continue
        turns.append((len(before), len(text)))
        if role in loss_roles:
            one, two = (template([*messages[:k], (role, probe)])[len(before):] for probe in "ab")
            head = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), len(one))
            loss.append((len(before) + head, len(text) - (len(one) - head - 1)))
    return text, turns, loss, rewritten


def format_chats(rows: DataFrame, template: Callable[[Messages], str] = marked, segment: int | None = SEGMENT,
                 loss_roles: Sequence[str] = LOSS_ROLES, turnwise: bool = False) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as formatted text: conv_id, segment, part, n_turns, formatted, loss.

    Rendering all prefixes takes time with the square of the number of turns, so a long conversation is rendered in
    segments of at most `segment` turns; the conversation's text is that of its segments (by segment, then part) one after
    the other.  This needs a template whose text of two runs of turns is that of each, which every segment checks at its
    middle; a conversation of several segments is also rendered at doubling lengths and as a whole and compared, so it is
    held by one task.  A caller who states that the template is `turnwise` spares the latter, and segments are rendered
    side by side.  For other templates pass segment=None, and each conversation is rendered whole.

    Rows are ordered by turn, a null turn last, then role and text.  A null role or text counts as empty; rows without
    a conv_id form one conversation.  `loss` has code-point spans into `formatted`; a segment in which the template
    rewrites history is flagged, with no loss on the turns before that point.
    """
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.floor(F.col("turn") / segment) if segment else F.lit(0)
    keyed = clean.withColumn("segment", F.coalesce(number, F.lit((1 << 62)) if segment else F.lit(0)).cast("long"))

    together = bool(segment) and not turnwise

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, part, held = None, 0, []
        whole, texts, runs = [], [], 0  # of the conversation, as far as it has been rendered

        def compare():
            if template(whole) != "".join(texts):
                raise ValueError("the template does not render runs of turns on their own: pass segment=None")

        def over():
            nonlocal runs
            if runs & (runs - 1):  # else the last comparison was of the whole
                compare()
            whole.clear(), texts.clear()
            runs = 0

        def done():
            nonlocal runs
            text, _, loss, rewritten = render(template, held, loss_roles)
            half = len(held) // 2
            if segment and half and template(held[:half]) + template(held[half:]) != text:
                raise ValueError("the template does not render runs of turns on their own: pass segment=None")
            if together:
                whole.extend(held), texts.append(text)
                runs += 1
                if runs > 1 and not runs & (runs - 1):
                    compare()
            return (*key, part, len(held), text, [{"start": a, "stop": b} for a, b in loss], rewritten)

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
                "conv_id", "segment", "part", "n_turns", "formatted", "loss", "rewritten"])

        for batch in batches:
            ready = []
            for *own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text"))):
                if held and (own != key or (segment and len(held) >= segment)):
                    ready.append(done())
                    part, held = (part + 1 if own == key else 0), []
                    if together and own[0] != key[0]:
                        over()
                key = own
                held.append((role, text))
            if ready:
                yield out(ready)
        if held:
            last = done()
            over()
            yield out([last])

    order = [F.asc_nulls_first("conv_id"), F.asc("segment"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    return keyed.repartition("conv_id", *([] if together else ["segment"])).sortWithinPartitions(*order).select(
        "conv_id", "segment", "role", "text").mapInArrow(work, FORMATTED)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = parse_marked,
              plain: Callable[[str], str] = unescape) -> DataFrame:
    """Per conversation, read from the formatted text and its loss spans alone: turns and loss as counts and digests.

    A digest runs over a conversation in order, so its segments pass through one task; they pass as a stream, and only
    the digests' state is held, however long the conversation is.
    """
    def work(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        key, state = None, None

        def close():
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ready = []
            for conv_id, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if key != (conv_id,):
                    if key is not None:
                        ready.append(close())
                    key, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = plain(text[span["start"]:span["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if ready:
                yield out(ready)
        if key is not None:
            yield out([close()])

    return written(formatted, "formatted").select("conv_id", "segment", "part", "formatted", "loss").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "segment", "part").mapInArrow(work, DIGESTS)
