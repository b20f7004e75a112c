"""Token ids of whole texts by a public tokenizer file, on Arrow batches.

The tokenizer works on words: white space ends a word and a word's ids do not depend on its
neighbours. Each worker therefore encodes a word once and looks its ids
up after that. Texts with characters for which that is not certain are
encoded whole by the tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Separators on which libraries differ, a letter whose lower case depends on its place, and special tokens.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f\x85Σİ]|<\\|")
_SIMPLE = re.compile("[\x00-ɏ‐-‧]*")
#: Words that a worker keeps at most (about 200 bytes each); all are forgotten when there are more.
MAX_CACHED = 1_000_000
_encoders: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a word-wise BPE tokenizer; the cache of words is bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        """Pieces that the tokenizer does not cut further; each one's last id is one that ends a word."""
        for i in range(0, len(new), 256):
            part = new[i : i + 256]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(part) and 4 * len(ids) == cut[-1]:
                raw = ids.tobytes()
                self.words.update(zip(part, map(raw.__getitem__, map(slice, [0, *cut], cut)), strict=True))
            else:
                self.words.update((p, self._whole(p)) for p in part)

    def _learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > MAX_CACHED:
            self.words.clear()
        alone, cut, odd = [], [], []
        for w in new:
            if not w.isascii():
                if not _SIMPLE.fullmatch(w):
                    odd.append(w)
                    continue
                if not unicodedata.is_normalized("NFC", w):
                    cut.append((w, _PIECES.findall(unicodedata.normalize("NFC", w))))
                    continue
            if w.isalpha():
                alone.append(w)
            elif w[:-1].isalpha() and w[-1] in ".,;:!?":
                cut.append((w, [w[:-1], w[-1]]))
            else:
                cut.append((w, _PIECES.findall(w)))
        known = self.words
        need = {p for _, ps in cut for p in ps if p not in known}
        need.update(alone)
        self._learn_pieces(list(need))
        for w, ps in cut:
            known[w] = b"".join([known[p] for p in ps])
        for w in odd:
            known[w] = self._whole(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            split, new = [], set()
            for t in texts[i : i + 256]:
                if t and _ODD.search(t):
                    split.append(t)
                else:
                    split.append(w := (t or "").lower().split())
                    new.update(w)
            new = new.difference(self.words)  # looks each new word up
            if new:
                if len(self.words) + len(new) > MAX_CACHED:
                    new.update(*(w for w in split if not isinstance(w, str)))
                self._learn(new)
            get = self.words.__getitem__
            out += [self._whole(w) if isinstance(w, str) else b"".join(map(get, w)) for w in split]
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def release() -> None:
    """Forget the worker's encoders. Workers outlive a stage; functions of other operators, which take memory of their own, begin with it."""
    _encoders.clear()
