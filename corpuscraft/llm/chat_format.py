"""Chat formatting with offset-aligned masks.

A conversation is rendered whole by a template, in which control strings mark where a turn, its text and its
end are. Control strings that stand in a role or a text are escaped, which ``unescape`` takes back. What is rendered is encoded
once, with the place of every token; control strings are tokens of their own, so no token reaches over the edge of a
turn. The spans of the turns and those of the tokens are sorted, and two binary searches a turn find
its tokens; those of the roles to be learned are the loss mask.

Conversations lie in order over the partitions (by id, then turn), and are encoded in parts of some turns, a part ending where a
control string stands and tokens are parted anyway. So a conversation of any length takes bounded memory and
many tasks; only its digest, which is sequential by nature, reads its parts one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, parallelism

#: Characters of a part, about, and of what the library encodes at once inside one.
PART, PIECE = 1 << 18, 1 << 16
#: Bytes of text of a partition.
RANGE = 64 << 20
#: Inside a long text, a place where tokens are parted whatever surrounds it: a space between two letters.
CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@dataclass(frozen=True)
class Template:
    """Control strings, of which the first three mark a turn: before its role, before its text, and behind it.

    Each begins with a character that stands nowhere else in one of them, and none has a backslash or a space.
    In texts, a backslash is put behind that character (one more where there are some already).
    """

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    #: Further strings that models or other templates take for control, never left in a text.
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)
    _found: re.Pattern = field(init=False, repr=False, compare=False)
    _escaped: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        known = self.control
        firsts = {s[0] for s in known}
        if any(len(s) < 2 or firsts & set(s[1:]) or "\\" in s or re.search(r"\s", s) for s in known):
            raise ValueError("control strings overlap, or hold a backslash or white space")
        tails = "|".join(f"{re.escape(s[0])}(?=\\\\*{re.escape(s[1:])})" for s in known)
        object.__setattr__(self, "_found", re.compile(f"({tails})"))
        object.__setattr__(self, "_escaped", re.compile("|".join(f"{re.escape(s[0])}\\\\(?=\\\\*{re.escape(s[1:])})" for s in known)))

    @property
    def control(self) -> tuple[str, ...]:
        return (self.begin, self.middle, self.end, *self.others)

    def escape(self, text: str) -> str:
        """The text without control strings; unescape(escape(text)) == text for any text."""
        return self._found.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn as it is encoded, and where its text begins and ends in it."""
        head, own = f"{self.begin}{self.escape(role)}{self.middle}", self.escape(text)
        return f"{head}{own}{self.end}", len(head), len(head) + len(own)


class ChatCoder:
    """The vocabulary of a byte-level tokenizer, with the template's three marks as tokens behind it."""

    def __init__(self, template: Template, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.template = template
        self.tokenizer = Tokenizer.from_file(vocabulary)
        marks = (template.begin, template.middle, template.end)
        self.tokenizer.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in marks])
        self.begin, self.middle, self.end = (self.tokenizer.token_to_id(s) for s in marks)
        whole = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        byte_of = _bytes_of_letters()
        self.bytes: list[bytes] = [b""] * (self.tokenizer.get_vocab_size() + 1)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = token.encode() if token in whole else bytes(byte_of[c] for c in token)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and where each begins and ends in it, in characters."""
        pieces, of = [], []
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = CUT.search(text, at + PIECE)
                stop = cut.start() if cut else len(text)
                pieces.append(text[at:stop])
                of.append((k, at))
                at = stop
        out: list[tuple[list, list, list]] = [([], [], []) for _ in texts]
        for (k, at), found in zip(of, self.tokenizer.encode_batch(pieces, add_special_tokens=False)):
            places = np.array(found.offsets, np.int64).reshape(-1, 2) + at
            for to, values in zip(out[k], (np.array(found.ids, np.int32), places[:, 0], places[:, 1])):
                to.append(values)
        empty = np.empty(0, np.int64)
        return [tuple(np.concatenate(x) if x else empty for x in row) for row in out]

    def decode(self, ids: np.ndarray) -> str:
        known = self.bytes
        return b"".join([known[i] for i in ids.tolist()]).decode()


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write visible bytes as they are and the others as letters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_ranges(begins: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For sorted spans of characters, the ranges of the tokens, sorted as well, that make them up."""
    ranges = np.stack([np.searchsorted(begins, spans[:, 0], "left"), np.searchsorted(begins, spans[:, 1], "left")], axis=1)
    full = ranges[:, 1] > ranges[:, 0]
    a, b = ranges[full].T
    if (begins[a] != spans[full, 0]).any() or (ends[b - 1] != spans[full, 1]).any():
        raise ValueError("a token reaches over the edge of a turn")
    return ranges


_CODERS: dict[tuple[Template, str], ChatCoder] = {}


def _coder(template: Template, vocabulary: str) -> ChatCoder:
    if (template, vocabulary) not in _CODERS:
        _CODERS[template, vocabulary] = ChatCoder(template, vocabulary)
    return _CODERS[template, vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_conversations(conversations: DataFrame, template: Template = Template(), vocabulary: str | None = None) -> DataFrame:
    """Conversations as token ids with loss masks: (conv_id, part, whole, ids, loss).

    conversations: conv_id, turn, role, text; other columns are ignored. Null roles and texts are empty. Turns are in
    order of turn, null first; rows of one turn follow by role and text, equal ones one after the other. Rows of a null conv_id are one
    conversation. ``part`` numbers the parts of a conversation in ascending order (with gaps); ``whole`` marks those that are
    surely all of theirs. ``loss`` has the ranges of ids (begin, end) of the texts of learned roles, an empty text's being empty. A text longer than PIECE is encoded in
    pieces where it has a space between two letters; one without such a space is one piece. No rows give no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = ["conv_id", "turn", "role", "text"]
    keys = [*order[:3], F.xxhash64("text")]  # what cuts the ranges reaches the driver: no texts
    dealt = rows.repartitionByRange(max(parallelism(conversations.sparkSession), -(-size // RANGE)), *keys).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = _coder(template, vocabulary), TaskContext.get()
        number = task.partitionId() << 32
        ready: list[tuple] = []  # conv_id, part, whole, text, spans
        size, turns, spans, own, first, parts = 0, [], [], None, True, 0

        def close(edge: bool) -> None:
            """The turns so far are a part; edge: the conversation may go on in the next partition or in a next part."""
            nonlocal turns, spans, number, parts, size
            ready.append((own, number, not (edge or first or parts), "".join(turns), spans))
            size += len(ready[-1][3])
            turns, spans, number, parts = [], [], number + 1, parts + 1

        def out() -> pa.RecordBatch:
            nonlocal ready, size
            ids, loss = [], []
            for (_, _, _, _, spans), (found, begins, ends) in zip(ready, coder.encode([r[3] for r in ready])):
                ids.append(found)
                ranges = token_ranges(begins, ends, np.array(spans, np.int64).reshape(-1, 2))
                loss.append([{"begin": a, "end": b} for a, b in ranges.tolist()])
            pair = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], kinds), pa.array([r[1] for r in ready], pa.int64()), pa.array([r[2] for r in ready], pa.bool_()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pair))], ["conv_id", "part", "whole", "ids", "loss"])
            ready, size = [], 0
            return made

        begun, length, kinds = False, 0, None
        for batch in batches:
            kinds = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if begun and conv != own:
                    close(False)
                    first, parts, length = False, 0, 0
                elif length >= PART:
                    close(True)
                    length = 0
                if size >= 4 * PART:
                    yield out()
                own, begun = conv, True
                turn, a, b = template.render(role, text)
                if role in template.learned:
                    spans.append((length + a, length + b))
                turns.append(turn)
                length += len(turn)
        if begun:
            close(True)
            yield out()

    return batched(dealt.select("conv_id", "role", "text")).mapInArrow(run, f"conv_id {kind}, part long, whole boolean, ids array<int>, loss array<struct<begin: int, end: int>>")


def turns_of(ids: np.ndarray, coder: ChatCoder) -> list[tuple[str, str]]:
    """The (role, text) of every turn that is encoded in ids."""
    plain = coder.template.unescape
    marks = [np.flatnonzero(ids == m).tolist() for m in (coder.begin, coder.middle, coder.end)]
    return [(plain(coder.decode(ids[a + 1 : b])), plain(coder.decode(ids[b + 1 : c]))) for a, b, c in zip(*marks)]


def read_back(formatted: DataFrame, template: Template = Template(), vocabulary: str | None = None) -> DataFrame:
    """A row a conversation, from its ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is the hex digest of every turn's role, line feed, text, line feed; loss_sha256 that of the texts
    under the mask, one after another; loss_chars and formatted_chars count code points. Conversations of one part
    are digested where they lie; the parts of others are brought together and read in order.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = formatted.schema["conv_id"].dataType.simpleString()
    sums, digests = "n_turns long, loss_chars long, formatted_chars long", "turns_sha256 string, loss_sha256 string"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(template, vocabulary)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                turns = turns_of(ids, coder)
                learned = [template.unescape(coder.decode(ids[x["begin"] : x["end"]])) for x in batch.column("loss")[i].as_py()]
                rows.append((len(turns), sum(map(len, learned)), len(coder.decode(ids)), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(learned).encode()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["conv_id", "part", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts in order of conversation and part; one conversation's sums and hash states are held at a time."""
        state: list | None = None

        def row(done: list, kinds: pa.DataType) -> list[pa.Array]:
            conv, n, loss, size, turns, learned = done
            return [pa.array([conv], kinds), *(pa.array([x], pa.int64()) for x in (n, loss, size)), pa.array([turns.hexdigest()]), pa.array([learned.hexdigest()])]

        names, kinds = ["conv_id", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256"], None
        for batch in batches:
            kinds, done = batch.column("conv_id").type, []
            for conv, n, loss, size, turns, learned in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state, kinds))
                    state = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                state[1:4] = state[1] + n, state[2] + loss, state[3] + size
                state[4].update(turns)
                state[5].update(learned)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays(row(state, kinds), names)

    inner = f"conv_id {kind}, part long, {sums}, turns binary, loss binary"
    outer = f"conv_id {kind}, {sums}, {digests}"
    parts = formatted.select("conv_id", "part", "whole", "ids", "loss")
    whole = batched(parts.where("whole").drop("whole")).mapInArrow(decoded, inner).mapInArrow(digested, outer)
    split = batched(parts.where("not whole").drop("whole")).mapInArrow(decoded, inner).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digested, outer)
    return whole.unionByName(split).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
