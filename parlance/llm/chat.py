"""Chat formatting at the level of tokens.

A turn becomes  <|im_start|> role \\n text <|im_end|> \\n .  Role, text and the fixed strings are encoded apart from
each other, the control marks are reserved ids beyond the vocabulary, spliced in; so no text can form a control
mark.  In the readable form control strings inside contents are escaped: `<`, any backslashes, `|` gets one backslash
more, which is undone by taking one away.  The loss mask marks the tokens of assistant texts: +1 where one begins, -1 where
it ends, summed up.

Turns are encoded row by row in parallel; rows of a conversation then meet, ordered by turn (ties by role, then the text's digest), and are
assembled one after another without holding more than one conversation.  A null text or role is empty, a null
conversation is a conversation like others, null turns come first; repeated rows are turns of their own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_more, _less = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@functools.lru_cache(maxsize=2)
def template(path: str) -> Template:
    """One a worker process."""
    return Template(path)


def escape(text: str) -> str:
    return _more.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _less.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Encodes turns and assembles conversations; `path`: a byte-level BPE file."""

    def __init__(self, path: str):
        self.tokenizer = bytelevel.load_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(True)
        self.start, self.end = size, size + 1
        self.newline = self.encode(["\n"])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def arrays(self, texts: list[str]) -> pa.Array:
        """Ids of each text, as one list array."""
        ids, n = bytelevel.flat(self.encode(texts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))

    def assemble(self, turns: list[tuple[np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a conversation of (role ids, text ids, whether it counts)."""
        parts, delta, at = [], [], 0
        start, feed, close = np.array([self.start], np.int32), np.array(self.newline, np.int32), np.array([self.end, *self.newline], np.int32)
        for role, text, counts in turns:
            begin = at + 1 + len(role) + len(feed)
            if counts and len(text):
                delta += [(begin, 1), (begin + len(text), -1)]
            parts += [start, role, feed, text, close]
            at = begin + len(text) + len(close)
        ids = np.concatenate(parts)
        step = np.zeros(at + 1, np.int8)
        for i, d in delta:
            step[i] += d
        return ids, np.cumsum(step[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """The readable form of assembled ids."""
        marks = np.flatnonzero(ids >= self.start)
        out, at = [], 0
        for m in marks:
            out += [self.tokenizer.decode(ids[at:m].tolist(), skip_special_tokens=False), START if ids[m] == self.start else END]
            at = m + 1
        return "".join([*out, self.tokenizer.decode(ids[at:].tolist(), skip_special_tokens=False)])

    def masked(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the mask, unescaped, one run after another."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        return "".join(unescape(self.tokenizer.decode(ids[a:z].tolist(), skip_special_tokens=False)) for a, z in edges.reshape(-1, 2))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a readable form."""
    out = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        out.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return out


def assemble(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, formatted (readable), ids and loss_mask of each conversation of rows (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))

    def encode(batches):
        t = template(path)
        for whole in batches:
            for part in bytelevel.slices(whole, "text", 1 << 20):
                role, said = part.column(2).to_pylist(), part.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], t.arrays([*map(escape_role, role)]), t.arrays([*map(escape, said)]), pa.array([hashed(x) for x in said])], ["conv_id", "turn", "role", "role_ids", "text_ids", "tie"])

    def join(batches):
        t = template(path)
        now, turns, out, held = None, [], [], 0

        def close():
            ids, mask = t.assemble(turns)
            return {"conv_id": now[0], "formatted": t.text(ids), "ids": ids, "loss_mask": mask}

        kind = {"conv_id": pa.int64(), "formatted": pa.string(), "ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.int8())}
        pack = lambda rows: frames.batch(kind, **{k: [r[k] for r in rows] for k in kind})
        for part in batches:
            role_ids, text_ids = part.column(2), part.column(3)
            flat = [(x.values.to_numpy(), x.offsets.to_numpy()) for x in (role_ids, text_ids)]
            for i, (conv, role) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                if now != (conv,):
                    if now is not None:
                        out.append(close())
                        held += len(out[-1]["ids"])
                    now, turns = (conv,), []
                    if held > 200_000:
                        yield pack(out)
                        out, held = [], 0
                a, b = (v[o[i] : o[i + 1]].copy() for v, o in flat)
                turns.append((a, b, role == LOSS_ROLE))
        if now is not None:
            out.append(close())
        if out:
            yield pack(out)

    coded = frames.map_arrow(rows, encode, "conv_id long, turn long, role string, role_ids array<int>, text_ids array<int>, tie string")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return frames.map_arrow(dealt.select("conv_id", "role", "role_ids", "text_ids"), join, "conv_id long, formatted string, ids array<int>, loss_mask array<byte>")


def digest(assembled: DataFrame, path: str) -> DataFrame:
    """What reading the output back gives: turns, and all text under the mask."""

    def f(batches):
        t = template(path)
        kind = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        for part in batches:
            out = {k: [] for k in kind}
            for i in range(len(part)):
                formatted = part.column(1)[i].as_py()
                ids, mask = (np.asarray(part.column(k)[i].values) for k in (2, 3))
                turns, loss = parse(formatted), t.masked(ids, mask)
                row = (part.column(0)[i].as_py(), len(turns), hexed("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), hexed(loss), len(formatted))
                for k, v in zip(kind, row):
                    out[k].append(v)
            yield frames.batch(kind, **out)

    return frames.map_arrow(assembled, f, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def hashed(text: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(text.encode())


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
