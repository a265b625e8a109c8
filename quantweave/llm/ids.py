"""Token ids of whole Arrow text columns by a file of the tokenizers library.

The library is asked once per distinct stretch between ASCII white space; the
answers stay in a table of fixed size. This gives the ids of the whole text
only for files that drop white space and split at it before anything else,
take runs of letters as pieces and lower-case them: `Encoder` looks for that in
the file and refuses any other.
"""

import json
import unicodedata

import numpy as np
import pyarrow as pa

from .words import Words, slices

_SLOTS = 1 << 21
_POOL = 1 << 23
_open: dict[str, "Encoder"] = {}


def _splits_at_space(spec: dict) -> bool:
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    before = (spec.get("normalizer") or {}).get("normalizers", [])
    if len(steps) != 2 or steps[0]["type"] != "Split" or steps[1]["type"] != "ByteLevel":
        return False
    pattern = steps[0]["pattern"].get("Regex", "")
    return (
        [x["type"] for x in before] == ["NFC", "Replace", "Lowercase"]
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and r"[\p{L}]+" in pattern
        and r"[^\s\p{L}\p{N}]+" in pattern
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
    )


def _byte_letters() -> dict[int, str]:
    """Byte-level files' letter for each byte: printing Latin-1 stands for itself, the rest for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def encoder(path: str) -> "Encoder":
    """This worker's encoder for a file; kept from task to task."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            if not _splits_at_space(json.load(f)):
                raise ValueError(f"{path} does not split at white space before all else")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.starts = 0
        self._clear()

    def _clear(self):
        self.starts += 1
        self.key = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.size = np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(_POOL, self.dtype), 0

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row and how many each has."""
        piece = self.tokenizer.model.tokenize
        found: list = [None] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if x.isalpha() and (x.isascii() or unicodedata.is_normalized("NFC", x)) and x == x.lower():
                # one piece that no step before the model changes
                found[i] = [t.id for t in piece(x if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS))]
            else:
                rest.append(i)
        if rest:
            whole = self.tokenizer.encode([texts[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            for i in rest:
                found[i] = []
            for w, x in zip(whole.word_ids, whole.ids, strict=True):
                found[rest[w]].append(x)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for f in found for x in f), self.dtype, int(size.sum())), size

    def _learn(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the given words by the library; their places in the pool."""
        data = words.data.tobytes()
        ids, size = self._ask([data[a:b].decode("utf-8", "replace") for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)])
        if self.used + len(ids) > len(self.pool):
            self._clear()
            if len(ids) > len(self.pool):
                self.pool = np.zeros(2 * len(ids), self.dtype)
        at = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return at, size

    def cut(self, texts: pa.Array) -> Words:
        """What the library is asked for one by one."""
        # a special token's name must not come about by lower-casing
        words = Words(texts, cut_tail=True)
        if b"<|" in words.raw.tobytes():
            words = Words(texts, lower=False, cut_tail=True)
        return words

    def column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in a row, `end` after each row's, and the rows' bounds in them."""
        words = self.cut(texts)
        slot = (words.hash & np.uint64(_SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != words.hash)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        if len(miss):
            _, first, back = np.unique(words.hash[miss], return_index=True, return_inverse=True)
            start = self.starts
            new_at, new_size = self._learn(words, miss[first])
            if self.starts > start:  # the pool began anew: nothing found before holds
                miss = np.arange(len(slot))
                _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
                self._clear()
                new_at, new_size = self._learn(words, first)
            at[miss], size[miss] = new_at[back], new_size[back]
            put, key = slot[miss[first]], words.hash[miss[first]]
            self.key[put] = key
            last = self.key[put] == key  # of words that share a slot one stays
            self.at[put[last]], self.size[put[last]] = new_at[last], new_size[last]
        rows = len(texts)
        before = np.concatenate([[0], np.cumsum(size)])
        bounds = before[words.bounds] + np.arange(rows + 1)
        out = np.empty(bounds[-1], self.dtype)
        ends = bounds[1:] - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[ends] = end
        out[body] = self.pool[np.arange(before[-1]) + np.repeat(at - before[:-1], size)]
        return out, bounds


def encoded(batches, path: str, end: int):
    """(slice of the batch, ids, bounds) for batches with a `text` column."""
    coder = encoder(path)
    for batch in batches:
        for part in slices(batch):
            yield part, *coder.column(part.column("text"), end)
