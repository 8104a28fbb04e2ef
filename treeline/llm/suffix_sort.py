"""Deep-shallow sorting of suffixes.

Multikey quicksort orders suffixes to a shallow depth, eight bytes at a time;
groups that still share that prefix are long common prefixes and are ordered
by blind tries, which look at branching bytes on the way down and compare
text only once, at a leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


class BlindTrie:
    """Suffixes of equal length under a shared prefix.  Inner nodes hold the
    byte they branch at; leaves hold a text and all suffixes with that text."""

    __slots__ = ("root",)

    def __init__(self, text: bytes, suffix: int):
        self.root = (text, [suffix])

    def add(self, text: bytes, suffix: int) -> None:
        path, node = [], self.root
        while type(node) is list:  # blind descent
            path.append(node)
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other = node[0]
        if other == text:
            node[1].append(suffix)
            return
        n = len(text)
        at = n - ((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() + 7) // 8
        parent, node = None, self.root
        for inner in path:
            if inner[0] >= at:
                node = inner
                break
            parent, node = inner, inner[1].get(text[inner[0]])
        leaf = (text, [suffix])
        if type(node) is list and node[0] == at:
            node[1][text[at]] = leaf
        elif node is None:  # a new branch of the last node on the path
            parent[1][text[parent[0]]] = leaf
        else:
            inner = [at, {other[at]: node, text[at]: leaf}]
            if parent is None:
                self.root = inner
            else:
                parent[1][text[parent[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Suffixes by leaf, in the order of their texts."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def sort_suffixes(data: bytes, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, compared to ``depth`` bytes, and
    by position in that order the class of suffixes that agree to ``depth``
    (the class is named by its first position).  Every suffix has at least
    ``depth`` bytes; ``shallow`` is at most ``depth``, a multiple of eight."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts)) if len(starts) > 1 else np.zeros(0, np.int64)
    for d in range(0, min(shallow, depth // 8 * 8), 8):
        if not len(tied):
            break
        key = np.ascontiguousarray(words[starts[order[tied]] + d]).view(">u8").reshape(-1).astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        key, own = key[by], group[tied][by]
        order[tied] = order[tied][by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        head = np.flatnonzero(new)
        group[tied] = np.repeat(tied[head], np.diff(np.append(head, len(tied))))
        size = np.repeat(np.diff(np.append(head, len(tied))), np.diff(np.append(head, len(tied))))
        alone = size == 1
        tied = tied[~alone]
    done = min(shallow, depth // 8 * 8)
    # positions are their own class unless tied
    if len(tied):
        g = group[tied]
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for s, e in zip(heads.tolist(), np.append(heads[1:], len(tied)).tolist()):
            at = tied[s]
            members = order[at:at + e - s].tolist()
            places = starts[members].tolist()
            trie = None
            for m, p in zip(members, places):
                text = data[p + done:p + depth]
                if trie is None:
                    trie = BlindTrie(text, m)
                else:
                    trie.add(text, m)
            for leaf in trie.leaves():
                order[at:at + len(leaf)] = leaf
                group[at:at + len(leaf)] = at
                at += len(leaf)
    return order, group


def repeated(data: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes agree to ``depth`` bytes with another one."""
    order, group = sort_suffixes(data, starts, depth)
    out = np.zeros(len(starts), bool)
    out[order] = np.bincount(group, minlength=len(starts))[group] > 1
    return out
