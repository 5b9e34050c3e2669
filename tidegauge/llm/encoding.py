"""Token ids of many texts by a public tokenizer, each distinct word encoded once.

Texts are split at single blanks; only words not met before go through the
tokenizers library, and the ids of a text are joined from those of its words.
Arrow splits a slice of texts, finds its distinct words and gathers their ids.
This gives the ids of encoding each text as a whole, because both supported
tokenizers begin a new unit there: ``byte`` (byte-level BPE, a blank belongs
to the word after it) wherever a blank isn't part of a longer run of white
space, ``word`` (white space dropped, parts marked by word ends) at any blank.
Texts with longer runs or with a reserved string are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode has it.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = {"byte": re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"), "word": re.compile(f"[^{SPACE}]+")}
#: A blank inside a run of white space, or at the end of one.
_RUN = re.compile(f"[{SPACE}] (?:[{SPACE}]|$)").search
#: White space that ordinary texts lack.
_RARE_SPACE = ("\t", "\r", "\v", "\f")
_OTHER_SPACE = tuple(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Words remembered in each of two generations, longest word remembered, bytes of text handled at once.
REMEMBERED, LONGEST, SLICE = 450_000, 64, 4 << 20
#: Slots for words met once.
_MET = 1 << 23
#: Stands for a line break before a word, in texts where every break stands between words.
_BREAK = "\x00"
#: Letters beyond ASCII that neither case folding nor composition changes the number of, then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The characters in which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Words(dict):
    """Ids by word, with a blank before it or without; a word not met before is encoded.

    Most words of a corpus occur once in it, so a word is remembered from the
    second time on: a byte a hash slot tells whether it was met. Once full,
    what is held becomes the older generation, from which words still in use
    come back; the generation before that goes.
    """

    def __init__(self, encode: Callable[[str, Words], bytes], lead: str):
        self.encode, self.lead, self.older, self.met = encode, lead, {}, bytearray(_MET)

    def __missing__(self, w: str) -> bytes:
        ids = self.older.get(w)
        if ids is None:
            return self.encode(w, self)
        self[w] = ids
        return ids

    def keep(self, w: str, ids: bytes) -> None:
        slot = hash(w) & (_MET - 1)
        if self.met[slot]:
            if len(w) <= LONGEST:
                self[w] = ids
        else:
            self.met[slot] = 1

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
            self.met = bytearray(_MET)


class Encoder:
    """``kind``: byte or word, see above. ``end``: id appended to each text."""

    def __init__(self, path: str, kind: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.model._resize_cache(0)  # words are remembered here
        self.kind, self.end = kind, array("I", [end]).tobytes()
        self.pieces, self.joint = PIECES[kind], "\n" if kind == "byte" else " "
        self.reserved = [t.content for t in self.tok.get_added_tokens_decoder().values()] + [_BREAK]
        self.letters = "".join(byte_letters())
        self.bare, self.spaced = Words(self._word, ""), Words(self._word, self.letters[32])
        self.later = self.spaced if kind == "byte" else self.bare  # has the words after a text's first
        self.units = self.tok.model.tokenize
        self.line = self.whole("\n")
        self.vocabulary = self.tok.get_vocab_size()

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, w: str, known: Words) -> bytes:
        """Ids of a word, kept unless it is long; one with punctuation is kept once its letters are."""
        if w.isascii():
            core = w if w.isalpha() else w.rstrip(_PUNCTUATION)
            plain = core.isalpha()
        else:
            found = _PLAIN(w)
            plain = found is not None
            core = found[1] if plain and found[2] else w
        if not plain:
            return self._other(w, known)
        met = core is not w and (known.get(core) or known.older.get(core))
        if met:
            ids = met
        else:
            unit = core.lower() if self.kind == "word" else core
            if not unit.isascii():
                unit = charmap_decode(unit.encode(), "strict", self.letters)[0]
            ids = array("I", [t.id for t in self.units(known.lead + unit)]).tobytes()
            slot = hash(core) & (_MET - 1)  # as keep() does; this is the hot path
            if not known.met[slot]:
                known.met[slot] = 1
            elif len(core) <= LONGEST:
                known[core] = ids
        if core is not w:
            ids += self.bare[w[len(core) :]]
            if met:
                known.keep(w, ids)
        return ids

    def _other(self, w: str, known: Words) -> bytes:
        """Ids of what isn't letters and then punctuation: by its units of white space and the rest."""
        if w[:1] == _BREAK and known.lead:
            ids = self.line + self.bare[w[1:]]
            known.keep(w, ids)
            return ids
        text = f" {w}" if known.lead else w
        parts = [text] if text == " " else self.pieces.findall(text)
        if len(parts) > 1:
            cut = lambda x: (x[1:], self.spaced) if len(x) > 1 and x[0] == " " else (x, self.bare)
            return b"".join([words[x] for x, words in map(cut, parts)])
        ids = self.whole(text)
        known.keep(w, ids)
        return ids

    def begun(self, text: str) -> tuple[bytes, str | None]:
        """Ids that ``text`` begins with, and its words after those with a blank between two (null: it is done)."""
        for x in self.reserved:
            if x in text:
                return self.whole(text), None
        if self.kind == "word":
            return b"", text.replace("\n", " ")
        rare = any([x in text for x in _RARE_SPACE]) or not (text.isascii() or not any([x in text for x in _OTHER_SPACE]))
        if "  " in text or "\n " in text or (rare and _RUN(text)):  # a blank within a longer run
            return self.whole(text), None
        if not (rare or "\n\n" in text or " \n" in text or text[-1:] == "\n"):  # each line break stands alone
            text = text.replace("\n", f" {_BREAK}")
        first, blank, rest = text.partition(" ")  # the first part has no blank before it
        return self.bare[first], rest if blank else None

    def text(self, text: str) -> bytes:
        """The ids of ``text`` and the end id, as little-endian unsigned 32-bit integers."""
        ids, rest = self.begun(text)
        words = () if rest is None else map(self.later.__getitem__, rest.split(" "))
        return b"".join([ids, *words, self.end])

    def _slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text begins in them: Arrow splits and gathers, each distinct word is looked up once."""
        begun = [self.begun(t or "") for t in texts]
        lists = pc.split_pattern(pa.array([rest for _, rest in begun], pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        ids = list(map(self.later.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        at = lists.offsets.to_numpy() + 2 * np.arange(len(texts) + 1)  # each text: its beginning, its words, the end id
        parts, inner = np.empty(at[-1], np.int32), np.ones(at[-1], bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        parts[inner] = words.indices.to_numpy()
        parts[at[:-1]] = len(ids) + np.arange(len(texts))
        parts[at[1:] - 1] = len(ids) + len(texts)
        ids += [x for x, _ in begun]
        ids.append(self.end)
        _, ends, raw = pa.array(ids, pa.large_binary()).take(pa.array(parts)).buffers()
        starts = np.frombuffer(ends, np.int64, len(parts) + 1)[at] >> 2
        return np.frombuffer(raw, np.uint32, starts[-1]), starts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of ``texts`` (null: empty): first and last row, all ids, and offsets of each text in them."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE)))
            self.spaced.age()
            self.bare.age()
            collects = gc.isenabled()
            gc.disable()  # many short-lived lists, no cycles; each pass would walk all words
            try:
                ids, starts = self._slice(texts.slice(first, last - first).to_pylist())
            finally:
                if collects:
                    gc.enable()
            yield first, last, ids, starts
            first = last


@lru_cache(maxsize=1)
def encoder(path: str, kind: str, end: int) -> Encoder:
    """An encoder that a worker's tasks share, so that later ones find its words."""
    return Encoder(path, kind, end)


@lru_cache(maxsize=8)
def vocabulary(path: str) -> int:
    """How many ids a tokenizer has."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
