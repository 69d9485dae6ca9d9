"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: <|im_start|>role<|im_sep|>text<|im_end|> and a
line end per turn. In roles and texts the run of backslashes between `<` and `|`
gets one more, so no control string occurs in them, and taking one away restores
them. The rendering is encoded once; the ends of its tokens in bytes and the sorted
spans of the assistants' texts meet by binary search, and tokens within a span
bear the loss. Control strings are single tokens, so no token crosses a span.

Null roles and texts are empty; turns sort by turn, then role, then text (nulls
first), and repeated rows are turns of their own; rows without a conversation id
are one conversation; a conversation is rendered in one task, whatever its
length, and conversations are gathered until they hold GATHERED characters; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices
from .pieces import BytePieces, encoder

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters, and conversations, that are encoded at a time; a longer conversation stands alone.
GATHERED, MOST = 4 << 20, 1000
CONTROL = re.compile(re.escape(START) + "|" + re.escape(SEP) + "|" + re.escape(END))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the byte spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == learn and end > begin:
            spans.append((begin, end))
        parts.append(f"{head}{body}{END}\n")
        at = end + len(END) + 1
    return "".join(parts), spans


class Chat:
    """A byte-level tokenizer with the control strings as further tokens."""

    def __init__(self, path: str):
        self.pieces = encoder(BytePieces, path)
        tokenizer = self.pieces.tokenizer
        base = tokenizer.get_vocab_size()
        self.control = {t: base + k for k, t in enumerate((START, SEP, END))}
        from .bpe import _alphabet

        alphabet = {c: b for b, c in _alphabet().items()}
        self.words = [b""] * base + [t.encode() for t in self.control]
        for word, k in tokenizer.get_vocab().items():
            self.words[k] = bytes(alphabet[c] for c in word)
        self.size = np.array([len(w) for w in self.words], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text and the byte at which each token ends."""
        segments, shape = [], []
        for text in texts:
            marks = list(CONTROL.finditer(text))
            ends = [0, *(m.end() for m in marks)]
            segments += [text[a:b] for a, b in zip(ends, [*(m.start() for m in marks), len(text)], strict=True)]
            shape.append([self.control[m[0]] for m in marks])
        ids, at = self.pieces(pa.array(segments, pa.large_string()))
        out, k = [], 0
        for marks in shape:
            n = len(marks) + 1
            begin, places = at[k], at[k + 1 : k + n] - at[k]
            one = np.insert(ids[begin : at[k + n]].astype(np.int64), places, marks)
            out.append((one, np.cumsum(self.size[one])))
            k += n
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.words[k] for k in ids.tolist()]).decode("utf-8", "replace")


def loss_mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens within a span: both are sorted, so each span's first and last token are found by binary search."""
    mask = np.zeros(len(ends), np.uint8)
    if spans:
        at = np.array(spans, np.int64)
        first, last = np.searchsorted(ends, at[:, 0], side="right"), np.searchsorted(ends, at[:, 1], side="left")
        edge = np.zeros(len(ends) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        mask[:] = np.cumsum(edge[:-1])
    return mask


def conversations(df: DataFrame, tokenizer: str, learn: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_col, formatted (text), ids (little-endian unsigned 32-bit), mask (a byte per token)."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    kind = df.schema[conv_col].dataType.simpleString()
    arrow = to_arrow_type(df.schema[conv_col].dataType)

    def finished(chat, groups):
        rendered = [render(turns, learn) for _, turns in groups]
        coded = chat.encode([text for text, _ in rendered])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([conv for conv, _ in groups], arrow),
                pa.array([text for text, _ in rendered], pa.string()),
                pa.array([ids.astype("<u4").tobytes() for ids, _ in coded], pa.binary()),
                pa.array([loss_mask(ends, spans).tobytes() for (_, ends), (_, spans) in zip(coded, rendered, strict=True)], pa.binary()),
            ],
            names=["conv", "formatted", "ids", "mask"],
        )

    def run(batches):
        chat = encoder(Chat, tokenizer)
        groups: list[tuple] = []
        size = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not groups or groups[-1][0] != conv:
                        if len(groups) >= MOST or size >= GATHERED:
                            yield finished(chat, groups)
                            groups, size = [], 0
                        groups.append((conv, []))
                    groups[-1][1].append((role, text))
                    size += len(role) + len(text)
        if groups:
            yield finished(chat, groups)

    return rows.mapInArrow(run, f"conv {kind}, formatted string, ids binary, mask binary").withColumnRenamed("conv", conv_col)


def read_back(chat: Chat, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], str, int]:
    """Turns, the text to learn, and the number of characters, from ids and mask alone."""
    start, sep, end = (chat.control[t] for t in (START, SEP, END))
    a, b, c = (np.flatnonzero(ids == k) for k in (start, sep, end))
    turns = [(unescape(chat.decode(ids[i + 1 : j])), unescape(chat.decode(ids[j + 1 : k]))) for i, j, k in zip(a, b, c, strict=True)]
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    learnt = "".join(unescape(chat.decode(ids[i:j])) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))
    return turns, learnt, len(chat.decode(ids))


def digests(formatted: DataFrame, tokenizer: str, conv_col: str = "conv_id") -> DataFrame:
    """Returns conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ids and mask."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches):
        chat = encoder(Chat, tokenizer)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            back = [read_back(chat, np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(m, np.uint8)) for i, m in zip(batch.column("ids").to_pylist(), batch.column("mask").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"),
                    pa.array([len(t) for t, _, _ in back], pa.int64()),
                    pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t, _, _ in back], pa.string()),
                    pa.array([len(x) for _, x, _ in back], pa.int64()),
                    pa.array([sha(x) for _, x, _ in back], pa.string()),
                    pa.array([n for _, _, n in back], pa.int64()),
                ],
                names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    out = formatted.select(F.col(conv_col).alias("conv"), "ids", "mask").mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
