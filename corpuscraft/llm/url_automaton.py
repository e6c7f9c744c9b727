"""URL filters: a bit-parallel wildcard automaton.

Glob rules are packed into one multiword Shift-And automaton: every character of a rule is a bit, a
wildcard is a bit that keeps itself alive over the characters it allows. One step over a character
moves all rules at once: ``state = ((state << 1) | begins) & mask[c] | state & stays[c]``, with the
carry handed from word to word. URLs of a batch step together, longest first, so that a step works only on
those that still have characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched


@dataclass(frozen=True)
class Rule:
    """A host (itself and its subdomains) and the beginning of a path, and what to do with what fits.

    In both ``*`` stands for any characters, none included, and ``?`` for one; in the host they don't leave it. A
    backslash before a character takes it as it is. A path begins with a slash, or is empty and fits any.
    """

    host: str
    path: str
    verdict: str

    def __post_init__(self) -> None:
        if self.path and self.path[0] != "/":
            raise ValueError(f"the path of a rule begins with a slash: {self.path}")

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract, as host, path and verdict.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


#: The byte after a URL, which UTF-8 never has; the bytes that a host may have; those that begin a character, and that go on with it.
END = b"\xff"
HOST = bytes(x for x in range(255) if x != ord("/"))
FIRST = bytes(x for x in range(255) if not 0x80 <= x < 0xC0)
REST = bytes(range(0x80, 0xC0))


def _steps(rule: Rule) -> list[tuple[bytes, bytes]]:
    """The steps of a rule: the bytes that each takes, and those that it survives."""
    steps = [(b"", HOST), (b".", b"")]
    for glob, wild in ((rule.host, HOST), (rule.path, HOST + b"/")):
        for token in re.findall(r"(?s)\\.|.", glob):
            if token == "*":
                steps[-1] = (steps[-1][0], steps[-1][1] + wild)
            elif token == "?":
                steps.append((FIRST if wild != HOST else FIRST.replace(b"/", b""), REST))
            else:
                steps += [(bytes([b]), b"") for b in token[-1].encode()]
    return steps if rule.path else [*steps, (b"/" + END, b"")]


class Automaton:
    """Rules as Shift-And words over the bytes of ``"." + host + path``, and END.

    A rule is the glob ``*.host path*``: since a host has no slash, the first wildcard cannot leave the host, and as
    the subject begins with a dot the host itself fits like a subdomain. A literal byte or ``?`` is a bit; ``*`` lets
    the bit before it survive. ``?`` takes the first byte of a character and survives the others.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        globs = [_steps(r) for r in rules]
        n = sum(map(len, globs))
        self.words = max(1, -(-n // 64))
        self.mask = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.begins = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for glob in globs:
            for i, (takes, keeps) in enumerate(glob):
                word, bit = at // 64, np.uint64(1 << at % 64)
                if i == 0:  # alive from the start
                    self.begins[word] |= bit
                self.mask[list(takes), word] |= bit
                self.stays[list(keeps), word] |= bit
                if i == len(glob) - 1:  # once reached, the rest of the URL may be anything
                    self.stays[:, word] |= bit
                    self.ends.append((word, bit))
                at += 1

    def match(self, subjects: list[bytes]) -> np.ndarray:
        """For each subject and rule, whether it fits."""
        n, subjects = len(subjects), [s + END for s in subjects]
        sizes = np.array([len(s) for s in subjects], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(subjects), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        live_at = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        state = np.tile(self.begins, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for i, live in enumerate(live_at):
            c = flat[starts[:live] + i]
            old = state[:live]
            moved = old << one
            moved[:, 1:] |= old[:, :-1] >> top
            state[:live] = moved & self.mask[c] | old & self.stays[c]
        fits = np.zeros((n, len(self.rules)), bool)
        for k, (word, bit) in enumerate(self.ends):
            fits[order, k] = (state[:, word] & bit) != 0
        return fits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """Judges every URL: page_id, host, path, rule, verdict.

    pages: page_id, url; other columns are ignored. Of the rules that fit, the longest (host and path
    together, as written) wins, of equally long ones the first; rule is null and the verdict ``default`` if
    none fits. A null or empty URL and one without ``://`` have an empty host and path. Repeated rows each
    return; no rows give no rows. URLs go to a task's worker by bytes, so very long ones come few at a time.
    """
    by_length = tuple(sorted(rules, key=lambda r: -len(r.text)))
    host, path = host_and_path(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(by_length)
        texts = np.array([r.text for r in by_length] + [None], object)
        verdicts = np.array([r.verdict for r in by_length] + [default], object)
        for batch in batches:
            if batch.num_rows:
                fits = automaton.match([b"." + h + p for h, p in zip(batch.column("host").cast(pa.binary()).to_pylist(), batch.column("path").cast(pa.binary()).to_pylist())])
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(by_length))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(texts[first], pa.string()), pa.array(verdicts[first], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return batched(pages.select("page_id", host.alias("host"), path.alias("path"))).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
