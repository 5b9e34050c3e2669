"""Chat formatting at the level of token ids.

Each turn's text is encoded by itself and spliced between reserved ids, which
no text can produce; where a text holds a control string, a backslash goes
after its first character (one more if it has some), so the written form is
unambiguous too and the way back exact. The mask of assistant texts follows
from prefix sums of segment lengths.

Encoding is done row by row before anything is shuffled; rows then stream in
order of conversation and turn, with a running position as the only state, so
a conversation of any length passes through.

Defined results: null text and null role are empty; turns of a conversation
are ordered by turn, null first, then role and ids; repeated rows are repeated
turns; a null conversation id is one conversation; further columns are
dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_arrow

from .encoding import byte_letters, encoder

# The template's marks; the reserved id of each is its place after the vocabulary.
MARKS = ("<s>", "</s>", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: Begins of the turns of known roles; any other role is written between [ROLE] and [/ROLE].
BEGINS = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
CONTROL = (*MARKS, "<|endoftext|>")
_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))
TRAINED = "assistant"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


class Codec:
    """Ids of turns, and turns of ids."""

    def __init__(self, tokenizer: str):
        self.enc = encoder(tokenizer, "byte", 0)
        vocab = self.enc.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.mark = {m: size + i for i, m in enumerate(MARKS)}
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if token not in CONTROL:
                self.bytes[i] = bytes(byte[c] for c in token)
        self.written = [*self.bytes, *(m.encode() for m in MARKS)]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.enc.text(escape(text))[:-4], np.uint32)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """All ids of a turn, and where its text begins and ends."""
        m = self.mark
        begin = [[m[BEGINS[role]]]] if role in BEGINS else [[m["[ROLE]"]], self.ids(role), [m["[/ROLE]"]]]
        sizes = np.cumsum([0, *map(len, segments := [*begin, self.ids(text), [m["</s>"]]])])
        return np.concatenate([np.asarray(s, np.uint32) for s in segments]), int(sizes[len(begin)]), int(sizes[len(begin) + 1])

    def text(self, ids: np.ndarray) -> str:
        """What ids of text stand for."""
        return unescape(b"".join([self.bytes[i] for i in ids.tolist()]).decode())

    def length(self, ids: np.ndarray) -> int:
        """Code points of the written form."""
        return len(b"".join([self.written[i] for i in ids.tolist()]).decode())

    def parse(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids, with or without <s> before it."""
        m = self.mark
        ids = ids[1:] if ids[0] == m["<s>"] else ids
        for role, mark in BEGINS.items():
            if ids[0] == m[mark]:
                return role, self.text(ids[1:-1])
        cut = int(np.flatnonzero(ids == m["[/ROLE]"])[0])
        return self.text(ids[1:cut]), self.text(ids[cut + 1 : -1])


def _ids(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint32)


def format_chats(conversations: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, start, loss_start, loss_end, ids for each turn, in order within partitions.

    ``ids`` are little-endian unsigned 32-bit; ``start`` and the loss span count
    ids from the conversation's beginning; the span is null where nothing is trained.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer)
        for b in batches:
            roles = [r or "" for r in b.column(2).to_pylist()]
            got = [codec.turn(r, t or "") for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            trained = [r == TRAINED for r in roles]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1] if t else None for g, t in zip(got, trained, strict=True)], pa.int64()), pa.array([g[2] if t else None for g, t in zip(got, trained, strict=True)], pa.int64())], ["conv_id", "turn", "role", "ids", "a", "b"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last, at = Codec(tokenizer), (), 0
        begin = np.array([codec.mark["<s>"]], np.uint32).tobytes()
        for b in batches:
            conv_ids = b.column(0).to_pylist()
            ids = [x.as_py() for x in b.column(3)]
            start, lead = [], []
            for i, c in enumerate(conv_ids):
                if (c,) != last:
                    last, at, ids[i] = (c,), 0, begin + ids[i]
                    lead.append(1)
                else:
                    lead.append(0)
                start.append(at)
                at += len(ids[i]) // 4
            spans = [[None if x is None else s + n + x for s, n, x in zip(start, lead, b.column(k).to_pylist(), strict=True)] for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (start, *spans)), pa.array(ids, pa.binary())], ["conv_id", "turn", "start", "loss_start", "loss_end", "ids"])

    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    coded = through_arrow(rows, encode, "conv_id long, turn long, role string, ids binary, a long, b long")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return through_arrow(dealt, place, "conv_id long, turn long, start long, loss_start long, loss_end long, ids binary")


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row a conversation, read back from the formatted ids; ``formatted`` as format_chats gives it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last, state = Codec(tokenizer), (), None
        done: list[tuple] = []

        def close() -> None:
            if state:
                n, turns, chars, loss, written = state
                done.append((last[0], n, turns.hexdigest(), chars, loss.hexdigest(), written))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            for c, start, x, y, raw in zip(*(b.column(at[k]).to_pylist() for k in ("conv_id", "start", "loss_start", "loss_end")), b.column(at["ids"]), strict=True):
                if (c,) != last:
                    close()
                    last, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = _ids(raw)
                role, text = codec.parse(ids)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if x is not None:
                    trained = codec.text(ids[x - start : y - start])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += codec.length(ids)
            yield batch()
        close()
        yield batch()

    return through_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
