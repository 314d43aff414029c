"""Token ids of whole texts, inside tasks.

The ids are the `tokenizers` library's own.  Both vocabularies cut a text before a
space or line feed that has no other white space beside it, so the pieces between can be
encoded apart and their ids joined: `Encoder` asks the library for each distinct piece
once and keeps the ids.  Texts with other white space in such a place are encoded whole.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_encoders: dict[tuple, Encoder] = {}  # one for each file in a Python worker


class Encoder:
    #: Pieces kept at most; then the store starts afresh, so memory is bounded.
    MOST = 1_500_000
    #: Marks that may follow a word of letters; both are then encoded apart.
    MARKS = ",.!?;:*$%&#"

    def __init__(self, path: str, most: int = MOST):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])  # tokens that begin with a space
        self.marks_spaces = self.spaced[self.tokenizer.encode(" a b", add_special_tokens=False).ids].sum() == 2
        self.final = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])  # tokens that end a word
        self.marks_ends = self.final[self.tokenizer.encode("a b", add_special_tokens=False).ids].sum() == 2
        self.divided = Tokenizer.from_file(path)  # here a special token divides a text into texts of their own
        special = self.divided.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in special.items() if t.special), (None, None))
        self.pieces: dict[str, bytes] = {}
        one, word, marks = self.whole([" ab" + self.MARKS, " ab", self.MARKS])
        self.parts_marks = one == word + marks
        self.marks: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _cut(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, w = ids.tobytes(), self.dtype.itemsize
        return [data[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist())]

    def short(self, texts: list[str]) -> list[bytes]:
        """`whole` for many short texts, with a call of the library for hundreds of them.

        Texts of a space and a word are joined as they are, and parted where a token begins
        with a space, or, for words of letters alone, ends a word; others are joined by a
        special token.  If the parts don't come out in number, the texts are encoded one by one.
        """
        out = []
        for at in range(0, len(texts), 512):
            group = texts[at : at + 512]
            if self.marks_spaces and all(t[:1] == " " and t.count(" ") == 1 for t in group):
                ids = self._joined(self.tokenizer, "".join(group))
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) == len(group) and starts[0] == 0:
                    out += self._cut(ids, starts, np.append(starts[1:], len(ids)))
                    continue
            elif self.marks_ends and all(t[:1] == " " and t[1:].isalpha() for t in group):
                ids = self._joined(self.tokenizer, "".join(group))
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    out += self._cut(ids, np.append(0, ends[:-1]), ends)
                    continue
            elif self.mark is not None and not any(self.mark[:2] in t for t in group):
                ids = self._joined(self.divided, self.mark.join(group))
                marks = np.flatnonzero(ids == self.mark_id)
                if len(marks) == len(group) - 1:
                    out += self._cut(ids, np.append(0, marks + 1), np.append(marks, len(ids)))
                    continue
            out += self.whole(group)
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode pieces (without the space before them) and keep them."""
        ends = {w: b for w in new if (b := w.rstrip(self.MARKS)) != w and b.isalpha()} if self.parts_marks else {}
        plain = {w for w in new if w not in ends and w[0] != "\n"} | {b for b in ends.values() if b not in self.pieces}
        lines = [w for w in new if w[0] == "\n"]
        plain = sorted(plain, key=str.isalpha)
        self.pieces.update(zip(plain, self.short([" " + w for w in plain])))
        self.pieces.update(zip(lines, self.short(lines)))
        for w, b in ends.items():
            tail = w[len(b) :]
            if tail not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[tail] = self.whole([tail])[0]
            self.pieces[w] = self.pieces[b] + self.marks[tail]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null texts are empty.

        Pieces begin with the space or line feed before them, bar a text's first.  Arrow
        cuts and numbers them; each distinct piece is looked up once.
        """
        if len(self.pieces) > self.most:
            self.pieces.clear()
        texts = texts.cast(pa.string()).fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        numbered = lists.flatten().dictionary_encode()
        words, code = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().astype(np.int64)
        to = np.cumsum(lists.value_lengths().to_numpy())
        first = to - lists.value_lengths().to_numpy()
        known = list(map(self.pieces.get, words))
        new = [w for w, k in zip(words, known) if k is None and (q := w.removeprefix("\n")) and not q[0].isspace() and not q[-1].isspace()]
        self._learn(new)
        for i in [i for i, k in enumerate(known) if k is None]:
            known[i] = self.pieces.get(words[i])
        # A piece with more white space at an edge can't be parted from its neighbours.
        odd_word = np.array([k is None for k in known] + [False] * len(first), bool)
        heads = [words[c] for c in code[first].tolist()]
        head_ids = [k if h[-1:].strip() else None for h, k in zip(heads, self.short(heads))]
        code[first] = len(words) + np.arange(len(first))
        odd = np.logical_or.reduceat(odd_word[code], first) if len(first) else np.zeros(0, bool)
        odd |= np.array([k is None and bool(h) for h, k in zip(heads, head_ids)], bool)
        parts = [k or b"" for k in known] + [k or b"" for k in head_ids]
        w = self.dtype.itemsize
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // w
        flat = np.frombuffer(b"".join(parts), self.dtype)
        at = np.cumsum(size) - size
        if odd.any():
            rows = np.flatnonzero(odd).tolist()
            got = dict(zip(rows, self.whole([texts[i].as_py() for i in rows])))
            code = code.copy()
            code_odd = np.repeat(odd, lists.value_lengths().to_numpy())
            count = size[code] * ~code_odd
        else:
            got, count = {}, size[code]
        before = np.cumsum(count) - count
        ids = flat[np.repeat(at[code] - before, count) + np.arange(int(count.sum()))]
        each = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        if got:
            ends = np.cumsum(each)
            pieces, last = [], 0
            for i, data in got.items():
                pieces += [ids[last : ends[i]], np.frombuffer(data, self.dtype)]
                last, each[i] = ends[i], len(data) // w
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, each

    def encode_with_end(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        ids, each = self.encode(texts)
        if end_id is not None:
            ids, each = np.insert(ids, np.cumsum(each), end_id), each + 1
        return ids, each


def encoder(path: str, most: int = Encoder.MOST) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most
    return _encoders[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def binaries(ids: np.ndarray, each: np.ndarray) -> pa.Array:
    """Ids of each document as bytes."""
    offsets = np.append(0, np.cumsum(each)) * ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def slices(batch, most: int = 256):
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
