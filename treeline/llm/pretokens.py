"""Splitting texts into cacheable pieces that a public tokenizer encodes alike.

A byte-pair tokenizer never merges across a pre-token, so the ids of a text
are the joined ids of its pieces when every cut is a pre-token boundary.
Texts on which the libraries' rules might differ (rare scripts, control
characters, special strings, runs of white space) go to the library whole, so
results never depend on the fast path.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Control characters, superscripts and fractions, and everything beyond Latin
#: Extended-B (dashes, quotation marks and the euro sign excepted) are left to the library.
_SLOW = re.compile("[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbeɐ-‒―-‗„-‥‧-₫₭-\U0010ffff]|<\\|")
#: The same characters as _SLOW, for Arrow's regular expressions.
_SLOW_ARROW = "".join(f"\\x{{{ord(c):x}}}" if c not in "[]-|<\\" else c for c in _SLOW.pattern)
#: White space that a cut at each single space would not keep together.
_RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: Pieces longer than this are encoded each time, never kept.
LONGEST = 200


def load(path: str):
    """The library's tokenizer, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    return _SLOW.search(text) is None


def spaced_pieces(text: str) -> list[str] | None:
    """Pieces of a text whose white space is kept (byte-level vocabularies):
    cuts before single spaces.  The first piece is marked by a leading space,
    every other stands for a space and itself.  None: encode the text whole."""
    if not plain(text) or text[:1] == " " or text[-1:] == " " or any(x in text for x in _RUNS):
        return None
    first, *rest = text.split(" ")
    return [" " + first, *rest]


class PieceCache(dict):
    """What the tokenizer gives for a piece: tier one is a fixed table of
    frequent pieces, tier two a worker cache.  Tier two is emptied when it
    holds ``most`` pieces, so memory is bounded; results never change."""

    def __init__(self, tokenizer, value: Callable[[np.ndarray], object], surface: Callable[[str], str],
                 frequent: dict | None = None, most: int = 600_000):
        super().__init__(frequent or {})
        self.tokenizer, self.value, self.surface, self.most = tokenizer, value, surface, most
        self.frequent = frequent or {}

    def whole(self, text: str):
        return self.value(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))

    def __missing__(self, piece: str):
        """Pieces too long to keep."""
        return self.whole(piece[1:] if piece[:1] == " " else self.surface(piece))

    def learn(self, pieces: set[str]) -> None:
        """Make every piece of at most LONGEST characters present."""
        missing = [p for p in pieces if p not in self and len(p) <= LONGEST]
        if len(self) + len(missing) > self.most + len(self.frequent):
            self.clear()
            self.update(self.frequent)
            missing = [p for p in pieces if p not in self and len(p) <= LONGEST]
        first = [p for p in missing if p[:1] == " "]
        rest = [p for p in missing if p[:1] != " "]
        for p in first:
            self[p] = self.whole(p[1:])
        for k in range(0, len(rest), 256):
            self._encode(rest[k:k + 256])

    def _encode(self, pieces: list[str]) -> None:
        """Encode many pieces in one call; token offsets tell whose each id is."""
        surfaces = [self.surface(p) for p in pieces]
        starts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(s) for s in surfaces], out=starts[1:])
        e = self.tokenizer.encode("".join(surfaces), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        # a token belongs to the piece that holds its last character (its offset may begin at the space before)
        ends = np.array([b for _, b in e.offsets], np.int64).reshape(-1)
        cut = np.searchsorted(ends, starts, side="right")
        for j, p in enumerate(pieces):
            self[p] = self.value(ids[cut[j]:cut[j + 1]])


#: Fixed value: the pre-token pattern of the word vocabulary, for lower-cased text that ``plain`` accepts.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds:
    """Ids, as little-endian bytes, of texts under a vocabulary that lower-cases
    and marks word ends.  Stretches between white space are remembered, and
    below them words; only words that are new go to the library, many in one
    call, and word-end tokens tell where each one's ids stop.  Both memories
    are emptied when they hold ``most`` entries."""

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most = tokenizer, most
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; null: none.  Stretches are told apart in
        Arrow, so Python sees each distinct one of a batch once."""
        collecting = gc.isenabled()
        gc.disable()  # many strings and no cycles here: the collector would look through both memories over and over
        try:
            return self._of(pa.array(texts, pa.string()), texts)
        finally:
            if collecting:
                gc.enable()

    def _of(self, column: pa.Array, texts: list[str | None]) -> list[bytes]:
        slow = pc.fill_null(pc.match_substring_regex(column, _SLOW_ARROW), False)
        easy = pc.invert(slow).to_pylist()
        lists = pc.utf8_split_whitespace(pc.if_else(slow, "", pc.fill_null(column, "")))
        kinds = lists.flatten().dictionary_encode()
        stretches = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(stretches)
        each = [self.stretches[p] if len(p) <= LONGEST else self.whole(p) for p in stretches]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, start = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
        at = kinds.indices.to_numpy()
        count = size[at]
        stop = np.cumsum(count)
        ids = ids[np.repeat(start[at] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.append(0, stop)[lists.offsets.to_numpy()].tolist()
        return [ids[s:e].tobytes() if ok else self.whole(t) for s, e, ok, t in zip(edge, edge[1:], easy, texts)]

    def _learn(self, stretches: list[str]) -> None:
        known = self.stretches
        new = [p for p in stretches if p not in known and len(p) <= LONGEST]
        if len(known) + len(new) > self.most:
            known.clear()
            new = [p for p in stretches if len(p) <= LONGEST]
        parts = [_WORDS.findall(p.lower()) for p in new]
        wanted = set().union(*parts)
        if len(self.words) + len(wanted) > self.most:
            self.words.clear()
        words = [w for w in wanted if w not in self.words]
        for k in range(0, len(words), 8192):
            self._encode(words[k:k + 8192])
        get = self.words.__getitem__
        known.update((p, b"".join(map(get, ws))) for p, ws in zip(new, parts))

    def _encode(self, words: list[str]) -> None:
        groups = [words[k:k + 128] for k in range(0, len(words), 128)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(group):
                self.words.update((w, self.whole(w)) for w in group)
                continue
            data, at = ids.tobytes(), 0
            for w, s in zip(group, (stop * 4).tolist()):
                self.words[w] = data[at:s]
                at = s


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that its tasks share what they have learnt."""
    return WordIds(load(path))
