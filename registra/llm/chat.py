"""Chat formatting in budgeted windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_counts

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
WINDOWS = "conv_id long, window long, text string, n_repeated long, loss array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    r"""Every backslash is doubled and <| becomes <\|, so no control string is left; unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def words_of(turn: str) -> int:
    """The words of a formatted turn and four for its marks; a measure without a vocabulary."""
    return len(turn.split()) + 4


def tokens_of(vocabulary: str) -> Callable[[str], int]:
    """Counts a formatted turn's tokens; the vocabulary file lies at the same path on every machine."""
    e = token_counts.encoder(vocabulary)
    return lambda turn: len(e.encode_ordinary(turn))


def written(role: str, text: str) -> tuple[str, str]:
    """A turn's head and body as they stand in a window."""
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)


def _write(turns: list[tuple[str, str]], n_repeated: int) -> tuple[str, list[dict]]:
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = written(role, text)
        if role == "assistant" and i >= n_repeated:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), loss


class Conversation:
    """Windows of a conversation, turn by turn; it holds one window and the history that the next may repeat."""

    def __init__(self, budget: int, history: int, length: Callable[[str], int]):
        self.budget, self.history, self.length = budget, history, length
        self.system: tuple[str, str] | None = None
        self.turns: list[tuple[str, str]] = []  # of the open window
        self.ends: list[int] = []  # prefix sums of tokens at the end of each of them
        self.fixed = self.repeated = self.seen = self.windows = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        head, body = written(role, text)
        cost = self.length(f"{head}{body}{END}\n")
        if len(self.turns) > self.repeated and (self.ends[-1] if self.ends else 0) + cost > self.budget:
            yield self.close()
            self._repeat(self.budget - cost)
        if not self.seen and role == "system":
            self.system, self.fixed = (role, text), cost
        self.seen += 1
        self.turns.append((role, text))
        self.ends.append((self.ends[-1] if self.ends else 0) + cost)

    def _repeat(self, room: int) -> None:
        """Starts a window with the system turn and as many last turns as history and room allow; both are left out before a turn that is too long for them."""
        turns, ends = self.turns, self.ends
        with_system = self.system is not None and self.fixed <= room
        most = min(self.history, room - (self.fixed if with_system else 0))
        before = [0, *ends]
        first = next((i for i in range(len(turns)) if ends[-1] - before[i] <= most and not (i == 0 and with_system and turns[0] == self.system)), len(turns))
        costs = [b - a for a, b in zip(before[first:], ends[first:], strict=False)]
        self.turns = ([self.system] if with_system else []) + turns[first:]
        self.repeated = len(self.turns)
        self.ends, total = [], 0
        for c in ([self.fixed] if with_system else []) + costs:
            total += c
            self.ends.append(total)

    def close(self) -> tuple:
        text, loss = _write(self.turns, self.repeated)
        self.windows += 1
        return self.windows - 1, text, self.repeated, loss


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, vocabulary: str | None = None) -> DataFrame:
    """Formats conversations into windows of at most budget tokens, each turn with its marks counted by the vocabulary's tokenizer (without one, in words).

    turns: conv_id, turn, role, text; other columns are ignored. Each window repeats the system turn (the first turn, if its role is system) and up to
    history tokens of the turns before, then has new turns. The loss mask (spans of code points) covers the texts of new
    assistant turns, so repeated targets are masked and each is learnt once. A turn longer than the budget is never cut; it
    gets a window of its own. Null texts and roles are empty, a null conv_id is a conversation, ties and repeated rows of a turn go by role, then text,
    and no rows give no windows. A conversation's turns are read in order and never held together, so one of any length needs the memory of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, out = object(), None, []
        length = tokens_of(vocabulary) if vocabulary else words_of

        def flush():
            return pa.RecordBatch.from_pylist(out, schema=SCHEMA)

        for b in batches:
            for conv, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c is None or conv != now:
                    if c is not None:
                        out.append(dict(zip(NAMES, (now, *c.close()), strict=True)))
                    now, c = conv, Conversation(budget, history, length)
                out += (dict(zip(NAMES, (conv, *w), strict=True)) for w in c.add(role, text))
            if out:
                yield flush()
                out = []
        if c is not None:
            out.append(dict(zip(NAMES, (now, *c.close()), strict=True)))
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
NAMES = SCHEMA.names


def read_windows(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """What a training job sees in the windows of format_windows(): a row for each conversation with n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars. Digests grow window by window; in_order: the rows come as format_windows() gave them, else they are sorted first."""
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []
        for b in batches:
            for conv, text, repeated, loss in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, body) in enumerate(_TURN.findall(text)):
                    if i >= repeated:
                        state[0] += 1
                        state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                for s in loss:
                    told = unescape(text[s["start"] : s["stop"]])
                    state[2] += len(told)
                    state[3].update(told.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield told_rows(out)
                out = []
        if state is not None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield told_rows(out)

    return windows.select("conv_id", "text", "n_repeated", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def told_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)], schema=COLUMNS)


COLUMNS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
