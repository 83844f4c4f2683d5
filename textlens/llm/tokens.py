"""Token ids of whole texts, with each distinct word of a batch encoded once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks at the ends of a word, which the tokenizer cuts off as one run; none composes with a letter or is part of a special token.
EDGES = r""".,;:!?()"#$%&*+-/=@[\]^_`{}~"""
#: Letters whose lower case depends on more than themselves.
ODD = "[\u0130\u03a3]"


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a worker, whose table lasts from task to task."""
    return WordTokenizer(path)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``start[i], ..., start[i] + n[i] - 1`` of all ``i``."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class WordTokenizer:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, for tokenizers that never join text across ASCII white space.

    A batch's texts are cut at white space and its distinct chunks put together from the ids of their lower-case letters,
    which a table keeps from batch to batch, and of the marks around them; chunks of any other form are encoded as they are.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most, self.words = most, {}

    def _plain(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _letters(self, words: list[str]) -> None:
        """Encode words of letters only, many in one text: each ends with the one token that carries a word end."""
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and (not len(stops) or stops[-1] == len(ids)):
                raw, width = ids.tobytes(), self.dtype.itemsize
                cut = [0, *(stops * width).tolist()]
                self.words.update(zip(some, (raw[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))
            else:
                self.words.update((w, self._plain(w)) for w in some)

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, learned where they are new."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.most:  # what is in use now stays
            self.words = {w: self.words[w] for w in words if w in self.words}
        self._letters(new)
        return [self.words[w] for w in words]

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk stop, and all their ids in order."""
        low = pc.utf8_lower(chunks)
        right = pc.ascii_ltrim(low, EDGES)
        core = pc.ascii_rtrim(right, EDGES)
        fine = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(chunks, ODD)).to_numpy(zero_copy_only=False)
        size = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        before, after = size(low) - size(right), size(right) - size(core)
        # parts: nothing, the letters, marks and odd chunks; a chunk is three of them
        letters = core.filter(pa.array(fine)).dictionary_encode()
        parts = [b"", *self._known(letters.dictionary.to_pylist())]
        three = np.zeros((len(chunks), 3), dtype=np.int64)
        three[fine, 1] = letters.indices.to_numpy() + 1
        marks: dict[str, int] = {}

        def part(s: str) -> int:
            if s not in marks:
                marks[s] = len(parts)
                parts.append(self._plain(s))
            return marks[s]

        own = np.flatnonzero(fine & (before + after > 0))
        texts = low.take(pa.array(own)).cast(pa.binary()).to_pylist()
        for i, s, b, a in zip(own.tolist(), texts, before[own].tolist(), after[own].tolist(), strict=True):
            three[i, 0] = part(s[:b].decode()) if b else 0
            three[i, 2] = part(s[-a:].decode()) if a else 0
        odd = np.flatnonzero(~fine)
        three[odd, 1] = [part(s) for s in chunks.take(pa.array(odd)).to_pylist()]
        n = np.array([len(p) for p in parts], dtype=np.int64) // self.dtype.itemsize
        pool, start = np.frombuffer(b"".join(parts), dtype=self.dtype), np.cumsum(n) - n
        flat = three.ravel()
        return np.cumsum(n[three].sum(1)), pool[ragged(start[flat], n[flat])]

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "replace").decode() if t else t for t in texts], pa.string())
        if not len(texts):
            return []
        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        stops, pool = self._chunks(found.dictionary)
        which = found.indices.to_numpy()
        n = np.diff(np.r_[0, stops])[which]
        ids = pool[ragged(np.r_[0, stops[:-1]][which], n)]
        words = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return np.split(ids, np.r_[0, np.cumsum(n)][words][:-1])
