"""Token ids of whole texts, with a bounded table of pieces looked up in numpy.

Texts are cut where their tokenizer's own pre-tokenizer cuts for certain: at single
spaces and newlines, and between runs of letters, digits and marks. The ids of the
pieces in a row are then the ids of the whole text. A piece of at most 24 bytes is
its own key (three 8-byte words and the length), found in an open-addressing table;
new pieces are encoded by the tokenizers library in groups. A word with an
apostrophe or a character beyond Latin letters is one piece. A text whose white
space the tokenizer may group is encoded whole.

Which rule holds is found by probing the tokenizer; one that fits neither encodes
every text whole. So is a text that holds the string of an added token of the file,
which the library turns into that token's id.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from memlake.llm.common import LOWER, flat, keep, mix

#: Slots of the table, and how many may be used before it is emptied.
SLOTS = 1 << 21
MOST_PIECES = 1_000_000
#: Ids that the pieces of the table and long pieces may hold before it is emptied.
MOST_IDS = 8_000_000
#: Longer pieces are encoded where they occur.
LONGEST = 24
#: Bytes of text encoded at once.
TOKEN_CHUNK = 1 << 19
#: Pieces encoded in one string.
GROUP = 96

_SPACE, _NEWLINE, _LETTER, _DIGIT, _MARK, _SPECIAL = range(6)
_CLASS = np.full(256, _SPECIAL, dtype=np.uint8)
_CLASS[32], _CLASS[10] = _SPACE, _NEWLINE
for _b in range(33, 127):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _MARK
_CLASS[ord("'")] = _SPECIAL
#: Masks of the low n bytes of an 8-byte word.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each UTF-8 byte; letters from U+00C0 to U+024F count as letters, all else beyond ASCII is special."""
    kinds = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):
        lead = lead[lead + 1 < len(data)]
        after = data[lead + 1]
        ok = np.where(data[lead] == 0xC3, (after != 0x97) & (after != 0xB7), (data[lead] != 0xC9) | (after <= 0x8F))
        ok &= (data[lead] != 0xC4) | (after != 0xB0)  # its lower case ends in a mark
        kinds[lead[ok]] = kinds[lead[ok] + 1] = _LETTER
    return kinds


def _strange_space(data: np.ndarray) -> np.ndarray:
    """Where a control character or white space beyond ASCII begins, by the widest definition."""
    at = np.flatnonzero((data < 32) & (data != 10))
    wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF))
    if len(wide):
        padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
        a, b, c = data[wide], padded[wide + 1], padded[wide + 2]
        hit = (a == 0xC2) & ((b == 0xA0) | (b == 0x85)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBB)
        hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8)) | (b == 0x81) & (c >= 0x9F))
        at = np.concatenate([at, wide[hit]])
    return at


class Encoder:
    """ids of texts under one tokenizer file; end: the id put after each text."""

    def __init__(self, path: str, end: int, kind: str = "<u4"):
        # a task has one core; more threads would only hold more memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        if self.kind.itemsize == 2 and self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need four bytes")
        self.end = end
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        self.rule, self.joint = self._rules()
        if any(t.normalized or not t.content for t in added):  # found in normalised text: not by its bytes
            self.rule = "whole"
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(SLOTS, -1, dtype=np.int32)  # the entry of a piece; -1: free
        self.used = 0
        self.ids = np.zeros(1 << 16, dtype=self.kind)
        self.ids[0] = self.end
        self.n_ids = 1
        self.first, self.count = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int32)
        self.key = [np.zeros(1 << 12, dtype=np.uint64) for _ in range(3)]
        self.tag = np.zeros(1 << 12, dtype=np.uint8)  # length and whether a space comes before; 0: no key
        self.count[0] = 1  # entry 0: the end id
        self.n_entries = 1

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _rules(self) -> tuple[str, str]:
        """spaced: a space belongs to the piece after it; bare: white space has no ids; whole: neither. And what may join pieces."""
        probe = ("one", " two", "\n", "three", " 4", ",", " five", "!!", " x", "2", "y")
        joined = self._plain("".join(probe))
        if self._plain("\n"):
            if joined == [i for p in probe for i in self._plain(p)] != [i for p in probe for i in self._plain(p.strip())] and len(self._plain("\n")) == 1:
                return "spaced", "\n"
        elif joined == [i for p in probe for i in self._plain(p.strip())] and len(self._plain("|")) == 1 and self._plain("One") == self._plain("one"):
            return "bare", " | "
        return "whole", ""

    def _add(self, many: list[np.ndarray]) -> np.ndarray:
        """Entries for the ids of new pieces."""
        size = sum(map(len, many))
        while self.n_ids + size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_entries + len(many) > len(self.first):
            self.first, self.count, self.tag = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.tag))
            self.key = [np.concatenate([x, np.zeros_like(x)]) for x in self.key]
        entries = np.arange(self.n_entries, self.n_entries + len(many))
        if many:
            counts = np.array([len(x) for x in many])
            self.first[entries], self.count[entries] = self.n_ids + np.cumsum(counts) - counts, counts
            self.ids[self.n_ids : self.n_ids + size] = np.concatenate(many)
        self.n_ids += size
        self.n_entries += len(many)
        return entries

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece: in groups told apart by the id of what joins them, or one by one."""
        bar = self.joint.strip(" ")
        spaced = self.rule == "spaced"
        out: list[np.ndarray | None] = [None] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if bar not in p and (p[:1] == " ") == spaced]
        single = [k for k, p in enumerate(pieces) if bar in p or (p[:1] == " ") != spaced]
        mark = self._plain(bar)[0]
        parts = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.joint + self.joint.join(pieces[k] for k in p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.kind)
            at = np.append(np.flatnonzero(ids == mark), len(ids)).tolist()
            if len(at) != len(part) + 1:  # that id inside a piece
                single += part
                continue
            for j, k in enumerate(part):
                out[k] = ids[at[j] + 1 : at[j + 1]]
        for k, e in zip(single, self.tokenizer.encode_batch_fast([pieces[k] for k in single], add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype=self.kind)
        return out

    def _lookup(self, keys: list[np.ndarray], tag: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Entries of keyed pieces, -1 where the table lacks them."""
        found = np.full(len(tag), -1, dtype=np.int64)
        left = np.arange(len(tag))
        step = 0
        while len(left):
            entry = self.slot[(place[left] + step) & (SLOTS - 1)]
            there = entry >= 0
            entry[~there] = 0
            same = there & (self.tag[entry] == tag[left])
            for own, k in zip(self.key, keys):
                same &= own[entry] == k[left]
            found[left[same]] = entry[same]
            left = left[~same & there]
            step += 1
        return found

    def _insert(self, keys: list[np.ndarray], tag: np.ndarray, place: np.ndarray, entries: np.ndarray) -> None:
        left, step = np.arange(len(tag)), 0
        for own, k in zip(self.key, keys):
            own[entries] = k
        self.tag[entries] = tag
        while len(left):
            slot = (place[left] + step) & (SLOTS - 1)
            free = np.flatnonzero(self.slot[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            self.slot[taken] = entries[left[free[which]]]
            done = np.zeros(len(left), dtype=bool)
            done[free[which]] = True
            left = left[~done]
            step += 1
        self.used += len(tag)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in a row, an end id after each, and the rows' bounds (n + 1 values). Null: empty."""
        data, bounds = flat(col)
        if self.rule == "whole":
            return self._joined([self._whole(col[k].as_py()) for k in range(len(col))])
        kinds = byte_classes(data)
        white = kinds <= _NEWLINE
        whole = np.zeros(len(bounds) - 1, dtype=bool)
        if self.rule == "spaced" and len(data):
            pair = white.copy()
            pair[1:] &= white[:-1]
            pair[0] = white[0]
            starts = bounds[:-1][np.diff(bounds) > 0]
            pair[starts] = white[starts]
            last = bounds[1:][np.diff(bounds) > 0] - 1
            bad = np.concatenate([np.flatnonzero(pair), last[white[last]], _strange_space(data)])
            whole[np.searchsorted(bounds, bad, side="right") - 1] = True
        for at in self._added(data):
            whole[np.searchsorted(bounds, at, side="right") - 1] = True
        if self.used > MOST_PIECES or self.n_ids > MOST_IDS:
            self._clear()
        start, end, flag = self._cut(data, bounds, kinds, white)
        entries = self._entries(data, start, end, flag)
        at = np.searchsorted(start, bounds)
        # the end id of a row comes after its pieces
        n_rows = len(bounds) - 1
        every = np.zeros(len(start) + n_rows, dtype=np.int64)
        ends = at[1:] + np.arange(n_rows)
        inner = np.ones(len(every), dtype=bool)
        inner[ends] = False
        every[inner] = entries
        counts = self.count[every]
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = self.ids[np.repeat(self.first[every] - total[:-1], counts) + np.arange(total[-1])]
        limits = np.concatenate([[0], total[ends + 1]])
        if whole.any():
            return self._joined([self._whole(col[k].as_py()) if whole[k] else ids[limits[k] : limits[k + 1]] for k in range(n_rows)])
        return ids, limits

    def _added(self, data: np.ndarray):
        """Where the strings of added tokens begin, or what becomes one when pieces are lower-cased."""
        raw = (LOWER[data] if self.rule == "bare" else data).tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                yield at
                at = raw.find(token, at + 1)

    def _whole(self, text: str | None) -> np.ndarray:
        return np.array(self._plain(text or "") + [self.end], dtype=self.kind)

    def _joined(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(rows) if rows else np.zeros(0, dtype=self.kind)), np.cumsum([0, *map(len, rows)])

    def _cut(self, data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece, and whether the space before it is part of it."""
        if not len(data):
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        solid = ~white
        begins = solid.copy()
        begins[1:] &= white[:-1] | edge[1:-1]
        word = np.flatnonzero(begins)
        special = np.zeros(len(word), dtype=bool)
        special[np.searchsorted(word, np.flatnonzero(kinds == _SPECIAL), side="right") - 1] = True
        turn = solid.copy()
        turn[0] = False
        turn[1:] &= (kinds[1:] != kinds[:-1]) & ~begins[1:]
        at = np.flatnonzero(turn)
        at = at[~special[np.searchsorted(word, at, side="right") - 1]]
        start = np.concatenate([word, at])
        if self.rule == "spaced":
            start = np.concatenate([start, np.flatnonzero(kinds == _NEWLINE)])
        start.sort()
        # a piece ends where the next begins or white space does
        stops = np.flatnonzero(white | edge[:-1])
        stops = np.append(stops, len(data))
        end = np.minimum(np.append(start[1:], len(data)), stops[np.searchsorted(stops, start, side="right")])
        flag = np.zeros(len(start), dtype=bool)
        if self.rule == "spaced":
            flag = (start > 0) & (data[start - 1] == 32) & ~edge[start]
        return start, end, flag

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, flag: np.ndarray) -> np.ndarray:
        if self.rule == "bare":
            data = LOWER[data]  # as this tokenizer does with ASCII
        size = end - start
        out = np.full(len(start), -1, dtype=np.int64)
        short = np.flatnonzero(size <= LONGEST)
        if len(short):
            padded = np.concatenate([np.zeros(8, dtype=np.uint8), data, np.zeros(24, dtype=np.uint8)])
            words = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
            s, e, n = start[short] + 8, end[short] + 8, size[short]
            keys = [words[s] & _LOW[np.minimum(n, 8)], np.where(n > 8, words[s + 8] & _LOW[np.clip(n - 8, 0, 8)], np.uint64(0)), np.where(n > 16, words[e - 8], np.uint64(0))]
            tag = (n + 1 + 64 * flag[short]).astype(np.uint8)
            place = (mix(keys[0] ^ mix(keys[1] + np.uint64(0x9E3779B97F4A7C15) ^ mix(keys[2] + tag.astype(np.uint64)))) >> np.uint64(20)).astype(np.int64)
            got = self._lookup(keys, tag, place)
            gone = np.flatnonzero(got < 0)
            if len(gone):
                # one of each new piece, by its full key
                order = np.lexsort((tag[gone], keys[2][gone], keys[1][gone], keys[0][gone]))
                ranked = gone[order]
                new = np.ones(len(ranked), dtype=bool)
                new[1:] = tag[ranked[1:]] != tag[ranked[:-1]]
                for k in keys:
                    new[1:] |= k[ranked[1:]] != k[ranked[:-1]]
                fresh = ranked[new]
                entries = self._learn(data, start[short[fresh]], end[short[fresh]], flag[short[fresh]])
                self._insert([k[fresh] for k in keys], tag[fresh], place[fresh], entries)
                got[ranked] = entries[np.cumsum(new) - 1]
            out[short] = got
        long = np.flatnonzero(size > LONGEST)
        if len(long):
            out[long] = self._learn(data, start[long], end[long], flag[long])
        return out

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, flag: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        return self._add(self._encode_pieces([(" " if f else "") + raw[a:b].decode() for a, b, f in zip(start.tolist(), end.tolist(), flag.tolist())]))


def encoder(path: str, end: int, kind: str = "<u4") -> Encoder:
    """This process's encoder of a file: its table lives until a task of another kind runs in the Python worker."""
    return keep(f"tokens {path} {end} {kind}", lambda: Encoder(path, end, kind))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
