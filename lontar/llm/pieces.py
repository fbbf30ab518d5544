"""Encoding whole texts through a bounded cache of their words, with the library of the vocabulary file.

The byte-level pre-tokenizer never joins characters across a space that a non-space follows, nor across a line end
between two non-spaces. Texts of words separated by single spaces and line ends are cut there; a batch's words are
numbered by Arrow, each distinct one is looked up (or encoded, once per worker), and the ids are gathered by number.
All other texts are given to the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers (about 300 bytes each) in each of two generations: those not met in the last one are forgotten.
REMEMBERED = 600_000
#: Bytes of text whose words are numbered together.
NUMBERED = 8 << 20
#: In a cut text, the mark of a word that no space precedes.
FIRST = "\x02"
#: Texts that can't be cut: white space at an end, twice in a row or of other kinds, the marks used here, special tokens.
_WHOLE = (
    r"^[ \n]|[ \n][ \n]|[ \n]\z|<\||[\x01\x02\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class Encoder:
    """Ids of texts, without begin, end or added special tokens."""

    numbered = NUMBERED

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding()
            model.no_truncation()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            kind = model.pre_tokenizer
            if model.normalizer is None and type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space:
                self.cuts, self.tokenize = True, model.model.tokenize
                self.marks = {c: self.encode([c])[0][0] for c in ".,"}
                #: How the pre-tokenizer writes bytes: printable Latin-1 as they are, the others from U+0100 on, in order.
                kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
                moved = [b for b in range(256) if b not in kept]
                self.letters = {b: 256 + i for i, b in enumerate(moved)}
                self.space = chr(self.letters[32])
        self.known, self.old, self.remembered = {}, {}, REMEMBERED

    def learn(self, words: list[str]) -> None:
        """Encode new words: Latin letters, perhaps with a point or comma, by the library's model alone, as they are one
        piece (or two) to its pre-tokenizer; others by all of the library."""
        known, tokenize, marks, others = self.known, self.tokenize, self.marks, []
        for w in words:
            first = w[:1] == FIRST
            body = w[1:] if first else w
            mark = marks.get(body[-1:])
            if mark is not None:
                body = body[:-1]
            if not body.isalpha() or (not body.isascii() and max(body) >= "\u0250"):
                others.append(w)
                continue
            piece = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in tokenize(piece if first else self.space + piece)])
            if mark is not None:
                ids.append(mark)
            known[w] = ids.tobytes()
        plain = [w[1:] if w[:1] == FIRST else w if w == "\n" else f" {w}" for w in others]
        known.update(zip(others, (array("I", ids).tobytes() for ids in self.encode(plain)), strict=True))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For texts that can be cut: the place of each text's first word, each word's number, each number's ids."""
        first, nothing = (pa.scalar(x, texts.type) for x in (FIRST, ""))
        marked = pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", f" \n {FIRST}"), nothing)
        lists = pc.split_pattern(marked, " ")
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        if len(self.known) + len(words) > self.remembered:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for w in [w for w in words if w not in known]:
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        if new:
            self.learn(new)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return offsets, numbered.indices.to_numpy(), list(map(self.known.__getitem__, words))

    def _parts(self, texts: pa.Array):
        """Runs of texts that are cut together: (first, last + 1, texts or None if to be taken whole)."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy()) // self.numbered
        cuts = np.flatnonzero((whole[1:] != whole[:-1]) | (sizes[1:] != sizes[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            if a < b:
                yield a, b, texts[a:b], whole[a]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for a, b, some, whole in self._parts(texts):
            if whole:
                out[a:b] = [len(self.encode([t])[0]) for t in some.to_pylist()]
            else:
                offsets, number, ids = self._cut(some)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                out[a:b] = np.add.reduceat(n[number], offsets[:-1])
        return out

    def ids(self, texts: pa.Array):
        """Each text's ids as packed unsigned 32-bit integers."""
        for _, _, some, whole in self._parts(texts):
            if whole:
                yield from (array("I", self.encode([t])[0]).tobytes() for t in some.to_pylist())
                continue
            offsets, number, ids = self._cut(some)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(n) - n
            each = n[number]
            ends = np.cumsum(each)
            raw = flat[np.repeat(starts[number] - ends + each, each) + np.arange(ends[-1])].tobytes()
            cuts = np.concatenate([[0], ends])[offsets] * 4
            yield from (raw[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
