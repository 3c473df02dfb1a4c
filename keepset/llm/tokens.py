"""Token ids of whole texts with the tokenizers library, remembered by piece.

Both vocabularies used here part a text into pre-tokens before they merge, and a blank that a non-blank follows always starts a
new one, so a text's ids are those of its blank-separated pieces, one after another. A full stop or comma between letters, digits
and white space, and a line end that touches no other white space but a blank after it, are pre-tokens of their own and part the
text further. The cuts are found in the UTF-8 bytes of many texts at once. A text in which a blank is followed by white space or
ends the text, and one that may hold an added token (such as an end mark), is encoded in one go, as the library does by default.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Pieces remembered by one Python worker at most; beyond it those that came again stay, or only those of the last texts.
MEMO = 600_000
_WHITE, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)  # ASCII bytes
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: White space beyond ASCII: first byte, second byte, third bytes (two bytes: none).
_WIDE = [(0xC2, 0x85, ()), (0xC2, 0xA0, ()), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)), (0xE3, 0x80, (0x80,))]
_WORD = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LOADED: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of large strings without nulls, and where each text begins, with the end of the last one."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _white(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of white space."""
    out = _WHITE[data]
    for lead in {x for x, _, _ in _WIDE}:
        at = np.flatnonzero(data == lead)
        for _, second, thirds in (x for x in _WIDE if len(at) and x[0] == lead):
            found = at[data[at + 1] == second]
            if thirds:
                found = found[np.isin(data[found + 2], thirds)]
            for k in range(3 if thirds else 2):
                out[found + k] = True
    return out


def _cuts(data: np.ndarray, bounds: np.ndarray, marks: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece begins at each byte, and the numbers of texts to be encoded in one go."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)  # bytes that begin a text, and the end
    first[bounds] = True
    around = np.zeros(n + 4, dtype=np.uint8)  # byte i is at i + 2
    around[2 : n + 2] = data
    white = np.zeros(n + 2, dtype=bool)  # byte i is at i + 1
    white[1 : n + 1] = _white(data)

    blanks = np.flatnonzero(data == 32)
    odd = [blanks[white[blanks + 2] | first[blanks + 1]]]
    for mark in marks:
        at = np.flatnonzero(data == mark[0])
        for k in range(1, len(mark)):
            at = at[around[np.minimum(at + 2 + k, n + 2)] == mark[k]]
        odd.append(at)
    odd = np.unique(np.searchsorted(bounds, np.concatenate(odd), side="right") - 1)

    cuts = first.copy()
    cuts[blanks] = True
    lines = np.flatnonzero(data == 10)
    lines = lines[(first[lines] | ~white[lines]) & (first[lines + 1] | ~white[lines + 2] | (around[lines + 3] == 32))]
    stops = np.flatnonzero((data == 46) | (data == 44))
    before, after = around[stops + 1], around[stops + 3]
    latin = (around[stops] == 0xC3) & (before != 0x97) & (before != 0xB7)
    stops, after = (x[~first[stops] & (_ALNUM[before] | latin)] for x in (stops, after))
    beyond = around[stops + 4]
    latin = (after == 0xC3) & (beyond != 0x97) & (beyond != 0xB7)
    stops = stops[first[stops + 1] | _ALNUM[after] | (after == 32) | (after == 10) | latin]
    for at in (lines, stops):
        cuts[at] = cuts[at + 1] = True
    return cuts[:n], odd


class Encoder:
    """Pieces and their ids are kept in Arrow arrays, so that looking up, learning and joining them makes no Python objects."""

    def __init__(self, path: str, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        self.marks = tuple({x.content[:2].lower().encode() for x in self.library.get_added_tokens_decoder().values()})  # how added tokens start
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.again = np.zeros(0, dtype=bool)  # pieces that came again after they were learned
        tokens = self.library.get_vocab()
        self.opens = np.zeros(max(tokens.values()) + 2, dtype=bool)  # ids that start a word after a blank, or
        self.closes = self.opens.copy()  # ids that end a word
        self.opens[[i for x, i in tokens.items() if x.startswith("\u0120")]] = True
        self.closes[[i for x, i in tokens.items() if x.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words):
        """As whole(), for words of letters after a blank: one text, whose ids are parted where words start or end."""
        import pyarrow as pa

        if not len(words):
            return pa.array([], pa.large_binary())
        text = words.buffers()[2].to_pybytes()[: int(np.frombuffer(words.buffers()[1], np.int64)[len(words)])].decode()
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.closes[ids]) + 1 if self.closes.any() else np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return pa.array(self.whole(words.to_pylist()), pa.large_binary())
        ends = np.concatenate([[0], 4 * cuts]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _places(self, wanted) -> np.ndarray:
        """Where each wanted piece stands among the remembered ones; new ones are learned."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(wanted, value_set=self.pieces)
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        self.again[places[places >= 0]] = True
        lacking = np.flatnonzero(places < 0)
        if len(lacking):
            new = wanted.take(pa.array(lacking))
            plain = pc.match_substring_regex(new, _WORD)
            is_plain = plain.to_numpy(zero_copy_only=False)
            words, others = new.filter(plain), new.filter(pc.invert(plain))
            parts = [self._words(words.slice(i, 4096).take(pa.array(np.arange(min(4096, len(words) - i))))) for i in range(0, len(words), 4096)]
            rest = others.to_pylist()
            parts += [pa.array(self.whole(rest[i : i + 2048]), pa.large_binary()) for i in range(0, len(rest), 2048)]
            places[lacking[is_plain]] = len(self.pieces) + np.arange(len(words))
            places[lacking[~is_plain]] = len(self.pieces) + len(words) + np.arange(len(rest))
            self.pieces = pa.concat_arrays([self.pieces, words, others])
            self.ids = pa.concat_arrays([self.ids, *parts])
            self.again = np.concatenate([self.again, np.zeros(len(new), dtype=bool)])
        return places

    def _forget(self, places: np.ndarray) -> None:
        """Keep the pieces that came again, or the last ones where those are too many."""
        import pyarrow as pa

        stay = np.flatnonzero(self.again)
        if len(stay) > self.most // 2:
            stay = np.unique(places)
        self.pieces, self.ids, self.again = self.pieces.take(pa.array(stay)), self.ids.take(pa.array(stay)), np.zeros(len(stay), dtype=bool)

    def encode(self, texts, end: int | None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: empty), followed by end. texts: an Arrow array or a list."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        cuts, odd = _cuts(*_bytes(texts), self.marks)
        apart = {int(i): self.whole([texts[int(i)].as_py()])[0] for i in odd}
        if apart:
            kept = np.ones(len(texts), dtype=bool)
            kept[odd] = False
            texts = pc.if_else(pa.array(kept), texts, pa.scalar("", pa.large_string()))
            cuts, _ = _cuts(*_bytes(texts), self.marks)
        data, bounds = _bytes(texts)
        starts = np.append(np.flatnonzero(cuts), len(data))
        coded = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        places = self._places(coded.dictionary)
        taken = self.ids.take(pa.array(places[coded.indices.to_numpy()]))
        if len(self.pieces) > self.most:
            self._forget(places)
        raw = memoryview(taken.buffers()[2] or b"")
        ends = np.frombuffer(taken.buffers()[1], np.int64)[np.searchsorted(starts, bounds)].tolist()
        return [(apart[i] if i in apart else bytes(raw[a:b])) + tail for i, (a, b) in enumerate(zip(ends, ends[1:]))]


def slices(batch, rows: int = 1024, chars: int = 2_000_000):
    """A record batch in parts of some rows, fewer where their texts are long."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        limit = (sizes[start - 1] if start else 0) + chars
        stop = max(start + 1, min(start + rows, int(np.searchsorted(sizes, limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop
