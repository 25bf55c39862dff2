"""Token ids of whole columns: each distinct word of a slice is encoded once, and texts are put together by array lookups."""

from __future__ import annotations

import json
import re

import numpy as np

from larkspur.llm import kernels as K

U = np.uint64
#: Kept words of a worker; beyond it the worker forgets them and begins anew (results don't depend on it).
CACHE_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 as itself, the others from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordStore:
    """Ids of words by the words' hashes, for one worker."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.len = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def missing(self, key: np.ndarray) -> np.ndarray:
        """Positions of those ascending keys that are not kept; a store that has grown too large begins anew."""
        if len(self.key) > CACHE_WORDS:
            self.forget()
        if not len(self.key):
            return np.arange(len(key))
        return np.flatnonzero(self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] != key)

    def add(self, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        where = np.searchsorted(self.key, key)
        self.key, self.at, self.len = np.insert(self.key, where, key), np.insert(self.at, where, at), np.insert(self.len, where, sizes)

    def ids(self, key: np.ndarray, inverse: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words key[inverse], one after another, and where each row begins, given each row's first word."""
        at = np.searchsorted(self.key, key)
        start, size = self.at[at][inverse], self.len[at][inverse]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.pool[K.ragged(start, size)], total[first]


class WordBpe:
    """Ids of a BPE vocabulary with word ends, as the `tokenizers` library gives them without special tokens.

    White space only separates words in this vocabulary, so words are encoded one by one and kept. Plain words (ASCII and
    Latin-1 letters, digits, marks) go through tiktoken with the word end as one more byte; all others, such as those
    holding a special token's string or letters whose case or composition may change, go through `tokenizers` itself.
    """

    #: How the vocabulary's own file splits lower-case text, for the letters of plain words.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s\x01a-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(letters[c] for c in token.removesuffix("</w>")) + b"\x01" * end

        ranks, ids = {}, []
        for end in ("", "</w>"):
            for c in letters:
                ranks[raw(c + end)] = len(ids)
                ids.append(vocab[c + end])
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ranks.setdefault(raw(a + b), len(ids))
            ids.append(vocab[a + b])
        self.ids = np.array(ids, np.uint32)
        self.newline = ranks[b"\n"]
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.store = WordStore()

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the count of each."""
        plain = [bool(self.PLAIN.fullmatch(w)) and "<|" not in w for w in new]
        fast = [w for w, p in zip(new, plain, strict=True) if p]
        slow = [w for w, p in zip(new, plain, strict=True) if not p]
        lists: list[np.ndarray] = []
        sizes = np.zeros(len(new), np.int64)
        is_fast = np.array(plain, bool)
        if fast:
            text = self.SPLIT.sub("\\g<0>\x01", "\n".join(fast).lower()) + "\n"
            got = np.array(self.fast.encode_ordinary(text), np.int64)
            ends = np.flatnonzero(got == self.newline)
            sizes[is_fast] = np.diff(ends, prepend=-1) - 1
            fast_ids = self.ids[got[got != self.newline]]
        else:
            fast_ids = np.zeros(0, np.uint32)
        slow_ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)] if slow else []
        sizes[~is_fast] = [len(x) for x in slow_ids]
        out = np.zeros(int(sizes.sum()), np.uint32)
        at = np.cumsum(sizes) - sizes
        out[K.ragged(at[is_fast], sizes[is_fast])] = fast_ids
        if slow_ids:
            out[K.ragged(at[~is_fast], sizes[~is_fast])] = np.concatenate(slow_ids)
        return out, sizes

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and offsets (rows + 1)."""
        s, e, first = K.words(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        u, one, inverse = np.unique(K.span_hashes(data, s, e), return_index=True, return_inverse=True)
        new = self.store.missing(u)
        if len(new):
            raw, pick = data.tobytes(), one[new]
            self.store.add(u[new], *self.encode_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[pick].tolist(), e[pick].tolist(), strict=True)]))
        return self.store.ids(u, inverse, first)


_open: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The worker's own copy, read once."""
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]
