"""SentencePiece ids of whole texts by a table of prefixes, and texts from ids.

Merging the best pair again and again gives every prefix of a stretch a last token,
and only one token can be it: the one that ends there, follows the last token of what
is before it, and would not have been merged across the border between the two. So
one pass with an automaton over all tokens fills a table of last tokens, each checked
against one neighbour only, and the ids are read from its end backwards. A stretch of
any length takes time in proportion to it; no queue of pairs is kept.

No token of such a file has a space after another character, and characters that it
does not know are spelled as bytes. So texts fall into stretches that nothing is merged
across, a stretch is worked on when a worker meets it first, and its ids stay in a
table of fixed size.
"""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import Encoder
from .words import _R_INVERSE, Words, _powers, mix, slices

SPACE = "▁"
_PAIRS = 1 << 21
#: Ids of an output batch; one longer document goes alone.
_IDS = 1 << 20
_open: dict[str, "Pieces"] = {}


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> "Pieces":
    """This worker's model for a file; kept from task to task."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


class Stretches(Words):
    """Stretches of rows that start with the space put before each of them: a run of spaces and what follows,
    or one character that stands alone. `alone`: for each byte, whether it is such a character."""

    def __init__(self, column: pa.Array, alone: np.ndarray):
        super().__init__(column, lower=False)
        data, edges = self.data, self.edges
        space, single = data == 32, alone[data]
        first = single | space
        first[1:] &= single[1:] | ~space[:-1]
        first[1:] |= single[:-1]
        first[edges[:-1][np.diff(edges) > 0]] = True
        self.start = np.flatnonzero(first)
        self.end = np.append(self.start[1:], len(data))[: len(self.start)]
        self.bounds = np.searchsorted(self.start, edges)
        self._back = _powers(_R_INVERSE, len(data) + 1)[self.start]
        self.hash = mix((self._sums[self.end] - self._sums[self.start]) * self._back)


class Table:
    """The last token of every prefix, for the pieces of a file."""

    def __init__(self, rank: dict[str, float], ids: dict[str, int], other: dict[str, list[int]] | None = None):
        """rank: of each piece, less is merged first; ids: of each piece."""
        self.rank, self.ids = rank, ids
        self.automaton = ahocorasick.Automaton()
        #: What is merged within a token, in order: rank, and the pieces at its two ends from then on.
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.text = {}
        for piece, i in ids.items():
            steps = self.merged(piece)
            if steps is not None:  # else no text has this token
                self.steps[i], self.text[i] = steps, piece
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.kept: dict[tuple[int, int], bool] = {}

    def merged(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make one token of `piece`; None if others come about."""
        now, steps = list(piece), []
        while len(now) > 1:
            best, at = min(((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False))))
            if best == float("inf"):
                return None
            now[at : at + 2] = [now[at] + now[at + 1]]
            steps.append((best, now[0], now[-1]))
        return steps

    def border(self, left: int, right: int) -> bool:
        """Whether nothing is merged across the border of two tokens while their own merges go on."""
        a, b = self.steps[left], self.steps[right]
        end, start = self.text[left][-1], self.text[right][0]
        never, rank = float("inf"), self.rank
        i = j = 0
        while True:
            across = rank.get(end + start, never)
            next_a = a[i][0] if i < len(a) else never
            next_b = b[j][0] if j < len(b) else never
            # of equal ranks the leftmost comes first
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a <= next_b:
                if next_a == never:
                    return True
                end = a[i][2]
                i += 1
            else:
                start = b[j][1]
                j += 1

    def tokens(self, text: str) -> list[int | str]:
        """Tokens of a stretch; a character without a piece stands for itself."""
        last, size, kept = [-1] * len(text), [1] * len(text), self.kept
        for at, (token, n) in self.automaton.iter(text):
            if last[at] >= 0:
                continue
            before = last[at - n] if at >= n else -1
            if before >= 0:
                fits = kept.get((before, token))
                if fits is None:
                    if len(kept) >= _PAIRS:
                        kept.clear()
                    fits = kept[before, token] = self.border(before, token)
                if not fits:
                    continue
            last[at], size[at] = token, n
        out: list[int | str] = []
        at = len(text) - 1
        while at >= 0:
            out.append(last[at] if last[at] >= 0 else text[at])
            at -= size[at]
        return out[::-1]


class Pieces(Encoder):
    """Encodes and decodes by a file; refuses one that it could not follow exactly."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = SentencePieceProcessor(model_file=path)
        spec = ModelProto.FromString(model.serialized_model_proto())
        how, kind = spec.normalizer_spec, type(spec.pieces[0])
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        bare = spec.trainer_spec
        if not (
            bare.model_type == type(bare).BPE
            and bare.byte_fallback
            and not bare.treat_whitespace_as_suffix
            and (how.add_dummy_prefix, how.remove_extra_whitespaces, how.escape_whitespaces) == (True, False, True)
            and not how.precompiled_charsmap
            and {p.type for p in spec.pieces} <= {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}
            and all(c in normal for p in normal for c in p)
            and not any(SPACE in p.lstrip(SPACE) for p in normal)
        ):
            raise ValueError(f"{path}: only merges of known characters with bytes for the others, a space put first and no other change of a text")
        self.first, self.last, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.dtype = np.dtype("<u2" if len(spec.pieces) <= 1 << 16 else "<u4")
        self.table = Table({p: -spec.pieces[i].score for p, i in normal.items()}, normal)
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in normal for b in range(256)])
        # texts of ids, one after another
        spelled = [b""] * len(spec.pieces)
        for p, i in normal.items():
            spelled[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            spelled[i] = bytes([b])
        spelled[self.unknown] = spec.trainer_spec.unk_surface.encode()
        self.length = np.array([len(x) for x in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.place = np.cumsum(self.length) - self.length
        self.is_byte = np.zeros(len(spec.pieces), bool)
        self.is_byte[self.bytes] = True
        self.control = np.array([p.type == kind.CONTROL for p in spec.pieces])
        self.spaced = np.zeros(len(spec.pieces), bool)
        self.spaced[[i for p, i in normal.items() if p.startswith(SPACE)]] = True
        self.starts = 0
        self._clear()

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for text in texts:
            ids: list[int] = []
            for t in self.table.tokens(text.replace(" ", SPACE)):
                if isinstance(t, int):
                    ids.append(t)
                else:
                    ids.extend(self.bytes[b] for b in t.encode())
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for f in found for x in f), self.dtype, int(size.sum())), size

    def cut(self, texts: pa.Array) -> Words:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.binary_join_element_wise(none, texts, space)
        return Stretches(pc.if_else(pc.equal(texts, none), texts, spaced), self.alone)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in a row, each row's between the begin and end ids, and the rows' bounds in them."""
        ids, bounds = self.column(texts, self.last)
        rows = np.arange(len(bounds))
        out = np.insert(ids, bounds[:-1], self.first)
        return out, bounds + rows

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 of all rows in a row, and the rows' bounds in it. The space put before a text goes; bytes that
        make no character become U+FFFD each."""
        ids = ids.astype(np.int64)
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.spelled[np.arange(ends[-1]) + np.repeat(self.place[ids] - ends[:-1], size)]
        # the first id of each row that is not a begin or end id
        shown = np.flatnonzero(~self.control[ids])
        at = np.searchsorted(shown, bounds[:-1])
        begins = shown[np.minimum(at, max(len(shown) - 1, 0))] if len(shown) else np.zeros(len(at), np.int64)
        has = (at < len(shown)) & (begins < bounds[1:])
        begins = begins[has]
        drop = begins[self.spaced[ids[begins]]]
        keep = np.ones(len(flat), bool)
        keep[ends[drop]] = False
        cut = ends[bounds] - np.searchsorted(ends[drop], ends[bounds])
        data = flat[keep].tobytes()
        # bytes on both sides of a begin or end id do not join to a character
        split = np.flatnonzero(self.control[ids[1:]] & self.is_byte[ids[:-1]]) + 1
        rows = np.searchsorted(bounds, split, "right") - 1
        torn = rows[(split > bounds[rows]) & (split + 1 < bounds[rows + 1])]
        try:
            data.decode()
        except UnicodeDecodeError:
            return self._mend(ids, bounds, data, cut, torn)
        return self._mend(ids, bounds, data, cut, torn) if len(torn) else (data, cut)

    def _mend(self, ids: np.ndarray, bounds: np.ndarray, data: bytes, cut: np.ndarray, torn: np.ndarray) -> tuple[bytes, np.ndarray]:
        out, anew = [], set(torn.tolist())
        for i in range(len(bounds) - 1):
            row = data[cut[i] : cut[i + 1]]
            try:
                row.decode()
                whole = i not in anew
            except UnicodeDecodeError:
                whole = False
            out.append(row if whole else self._spell(ids[bounds[i] : bounds[i + 1]].tolist()).encode())
        return b"".join(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def _spell(self, ids: list[int]) -> str:
        text, run, first = [], b"", True

        def close():
            nonlocal run
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        text.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    run = run[1:]

        for i in ids:
            if self.control[i]:
                close()
                continue
            piece = self.spelled[self.place[i] : self.place[i] + self.length[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                close()
                text.append(piece.decode()[1:] if first and self.spaced[i] else piece.decode())
            first = False
        close()
        return "".join(text)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    coder = pieces(path)
    for batch in batches:
        for part in slices(batch):
            yield part, *coder.encode(part.column("text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every row, begin and end ids included.

    Null and empty texts are those two alone. Rows are taken each, whatever ids they share; other columns are not
    read; an empty table gives an empty result. U+2581 in a text counts as a space, as the library has it.
    """
    path = path or piece_path()

    def task(batches):
        for part, ids, bounds in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(task, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of doc_id, ids; null and empty lists give an empty text, an id that the file
    lacks an error."""
    path = path or piece_path()

    def task(batches):
        coder = pieces(path)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
            ids, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            data, cut = coder.decode(ids, bounds - bounds[0])
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode` and then `decode` give, as digests; rows as there.
    Ids and texts stay in the task that makes them."""
    path = path or piece_path()

    def task(batches):
        coder = pieces(path)
        for part, ids, bounds in _encoded(batches, path):
            data, cut = coder.decode(ids, bounds)
            wide = memoryview(ids.astype("<u4").tobytes())
            sums = [hashlib.sha256(wide[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            view = memoryview(data)
            texts = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
