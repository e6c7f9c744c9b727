"""Token ids of whole texts by the tokenizers library, each distinct word of a batch looked up once."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and their ids that a worker remembers; further ones are encoded anew for each batch. The ids don't depend on it.
REMEMBERED = 100_000_000
#: Bytes of an entry besides its own.
ENTRY = 180
#: White space beyond ASCII inside a word, which the normalizer would cut at.
WHITE = re.compile(r"\s")
#: Latin letters, then signs that no contraction begins with: the pre-tokenizer parts these two and nothing else.
PLAIN = re.compile(r"([a-zß-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)")
#: All visible ASCII.
SIGNS = "".join(map(chr, range(33, 127)))

_CODERS: dict[str, WordCoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Encodes with a tokenizer that drops white space and never merges across it.

    A text is cut at ASCII white space; each piece gets the ids that the library's own normalizer,
    pre-tokenizer and model give it; ASCII is lowered without a call. Pieces that hold the text of a special token, or that the
    normalizer changes in number, are encoded by ``encode`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: whether all that the normalizer does to ASCII is to lower it
        self.lowers = self.tokenizer.normalizer.normalize_str(SIGNS) == SIGNS.lower()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters: dict[str, str] = {}
        self.used = 0

    def _part(self, part: str) -> bytes:
        """The ids of what the pre-tokenizer returns as one part."""
        found = self.parts.get(part)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
            size = ENTRY + len(part) + len(found)
            if self.used + size <= REMEMBERED:
                self.used += size
                self.parts[part] = found
        return found

    def _mapped(self, letters: str) -> str:
        """Letters as the pre-tokenizer writes their bytes."""
        if letters.isascii():
            return letters
        known = self.letters
        for c in letters:
            if c not in known:
                known[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        return "".join([known[c] for c in letters])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        odd, cased, learned, part = [], [], {}, self._part
        for word in words:
            if word.isascii():
                if self.lowers and word.isalpha():
                    learned[word] = part(word.lower())
                elif self.lowers and (m := PLAIN.fullmatch(word.lower())) and "<|" not in word:
                    letters, signs = m.groups()
                    learned[word] = (part(letters) if letters else b"") + (part(signs) if signs else b"")
                else:
                    (odd if "<|" in word and any(s in word for s in self.special) else cased).append(word)
            else:
                (odd if WHITE.search(word) or "<|" in word and any(s in word for s in self.special) else cased).append(word)
        normal = self.tokenizer.normalizer.normalize_str(" ".join(cased)).split(" ") if cased else []
        if len(normal) != len(cased):
            odd, cased, normal = odd + cased, [], []
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for word, text in zip(cased, normal):
            m = PLAIN.fullmatch(text)
            if m:
                letters, signs = m.groups()
                learned[word] = (part(self._mapped(letters)) if letters else b"") + (part(signs) if signs else b"")
            else:
                learned[word] = b"".join([part(p) for p, _ in cut(text)])
        for word in odd:
            learned[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return learned

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; those that are new are remembered as far as they fit."""
        known = self.words
        found = list(map(known.get, words))
        new = [w for w, f in zip(words, found) if f is None]
        if not new:
            return found
        learned = self._learn(new)
        for word, ids in learned.items():
            size = ENTRY + len(word) + len(ids)
            if self.used + size > REMEMBERED:
                break
            self.used += size
            known[word] = ids
        return [learned[w] if f is None else f for w, f in zip(words, found)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null: none) one after another, and where those of each text end. Each distinct word is looked up once."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())]
        return np.frombuffer(ids.buffers()[2] or b"", "<u4", ends[-1] // 4 if len(ends) else 0), ends // 4

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none), as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def coder(path: str) -> WordCoder:
    """One coder a worker process and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]
