"""Exact BPE merging of many words at a time in NumPy."""

from __future__ import annotations

import json
import re

import numpy as np

#: Words of letters (a-z, A-Z and the precomposed letters of U+00C0 to U+00FF) with at most this many bytes, then
#: punctuation without an apostrophe. Lower-casing and composition of such words are plain; all others go to the library.
LONGEST = 24
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
UNRANKED = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + k)
    return [table[b] for b in range(256)]


def lower(word: bytes) -> bytes:
    """Lower case of the letters of a plain word."""
    word = word.lower()  # ASCII alone
    return re.sub(rb"\xc3[\x80-\x9e]", lambda m: bytes((0xC3, m[0][1] + 32)), word) if b"\xc3" in word else word


class Merger:
    """Merges the byte symbols of words by rank, the lowest first and the leftmost of equals."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        rows = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in rows], np.int64)
        made = np.array([vocab[a + b] for a, b in rows], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 17 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], UNRANKED)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each lower-case word."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            symbols = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), n)
            ids = self.inner[symbols]
            ids[:, -1] = self.last[symbols[:, -1]]
            rank = self._ranks(ids[:, :-1], ids[:, 1:])
            while True:
                line = np.arange(len(rows))
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                lowest = rank[line, best] if rank.shape[1] else np.full(len(rows), UNRANKED)
                live = lowest != UNRANKED
                if not live.all():
                    width, body = 4 * ids.shape[1], ids[~live].astype("<i4").tobytes()
                    for k, i in enumerate(rows[~live].tolist()):
                        out[i] = body[k * width : (k + 1) * width]
                    rows, ids, rank, best, lowest = rows[live], ids[live], rank[live], best[live], lowest[live]
                    line = line[: len(rows)]
                if not len(rows):
                    break
                # every row merges one pair, so all get one shorter together
                merged, n_ids = self.made[lowest], ids.shape[1]
                keep = np.ones(ids.shape, bool)
                keep[line, best + 1] = False
                ids = ids[keep].reshape(len(rows), n_ids - 1)
                ids[line, best] = merged
                if n_ids == 2:
                    rank = rank[:, :0]
                    continue
                keep = np.ones(rank.shape, bool)
                keep[line, best] = False
                rank = rank[keep].reshape(len(rows), n_ids - 2)
                left = np.flatnonzero(best > 0)
                rank[left, best[left] - 1] = self._ranks(ids[left, best[left] - 1], merged[left])
                right = np.flatnonzero(best < n_ids - 2)
                rank[right, best[right]] = self._ranks(merged[right], ids[right, best[right] + 1])
        return out
