"""Byte-pair merges as tables: what op3 and op8 share.

A vocabulary's merge number r joins ``left[r]`` and ``right[r]``. Every token but the single symbols is the
product of exactly one merge and its parts are older than it, so the merges of a word happen in the order
of their numbers. That makes three questions answerable from the tables alone:

* ``clashes``: would two neighbouring tokens, each final on its own, have been joined across their border?
  Only a pair of parts that exist at the same time can join, and those are found by walking back in time
  from both tokens along the border.
* ``alone``: does a vocabulary string encode as that one token? Its last two parts have to encode alone
  and must not clash before their own merge.
* ``encode``: the exact merging, for words whose proposal fails.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np

NEVER = np.iinfo(np.int64).max
#: Ends each word of a joined text; no byte is spelled so.
END = "\n"
#: Longer words are merged one by one.
WIDEST = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes take the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeTable:
    """The vocabulary of a ``tokenizers`` BPE file, given as its JSON text."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        if any(t[flag] for t in data["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take their surroundings along or are normalized are not supported")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.strings = [""] * self.size
        for s, i in (*self.ids.items(), *self.special.items()):
            self.strings[i] = s
        self.symbols = byte_symbols()
        self.byte_map = {b: s for b, s in enumerate(self.symbols)}

        self.rank = np.full(self.size, -1, np.int64)  # of the merge that makes a token; -1: a symbol
        self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(2))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs[x, y] = r, z
            if self.rank[z] >= 0:
                raise ValueError("two merges make one token: merges do not happen in their order")
            self.rank[z], self.left[z], self.right[z] = r, x, y
        made = self.rank >= 0
        if (self.rank[self.left[made]] >= self.rank[made]).any() or (self.rank[self.right[made]] >= self.rank[made]).any():
            raise ValueError("a merge is older than its parts")
        self._index_pairs()
        self.symbol_id = np.full((2, 512), -1, np.int64)  # of a character inside a word, and at its end
        for c in self.symbols:
            self.symbol_id[0, ord(c)], self.symbol_id[1, ord(c)] = self.ids.get(c, -1), self.ids.get(c + self.suffix, -1)
        self.is_alone = self._alone()
        self.finder = ahocorasick.Automaton()
        for token, i in self.ids.items():
            inner = token.removesuffix(self.suffix) if self.suffix else token
            self.finder.add_word(inner + END * (inner != token), (i, len(token) if inner == token else len(inner) + 1))
        self.finder.make_automaton()

    def _index_pairs(self) -> None:
        """An open hash table of all merges: where a pair's slot is taken, it is in one of the next few."""
        bits = max(10, (4 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
        keys = np.fromiter((x * self.size + y for x, y in self.pairs), np.int64, len(self.pairs))
        ranks = np.fromiter((r for r, _ in self.pairs.values()), np.int64, len(self.pairs))
        self.made = np.zeros(len(self.pairs) + 1, np.int64)  # the token that each merge makes
        self.made[ranks] = np.fromiter((z for _, z in self.pairs.values()), np.int64, len(self.pairs))
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.slot_key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            left = np.setdiff1d(np.arange(len(keys)), put)
            keys, ranks, at, self.probes = keys[left], ranks[left], at[left] + 1 & self.mask, self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge that joins each pair, NEVER if none does."""
        keys = a * self.size + b
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], NEVER)
        on = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(on):
                break
            at[on] = at[on] + 1 & self.mask
            found = self.slot_key[at[on]]
            hit = found == keys[on]
            out[on[hit]] = self.slot_rank[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def clashes(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge before ``until`` joins parts of neighbouring tokens ``a`` and ``b`` across their border.

        On a tie of two merges the one further left happens first: at the border that is the merge inside ``a``
        before the one across, and the one across before the one inside ``b``."""
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        ends_a = np.full(len(a), NEVER - 1) if until is None else until.copy()
        ends_b = ends_a - 1 if until is not None else ends_a.copy()
        while len(live):
            r = self._pair_rank(a, b)
            hit = (r < ends_a) & (r <= ends_b)
            out[live[hit]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~hit & ((ra >= 0) | (rb >= 0))
            live, a, b, ends_a, ends_b, ra, rb = (x[go] for x in (live, a, b, ends_a, ends_b, ra, rb))
            undo_b = rb >= ra  # the younger one is taken apart; of equals the right one is younger
            ends_b, b = np.where(undo_b, rb, ends_b), np.where(undo_b, self.left[b], b)
            ends_a, a = np.where(undo_b, ends_a, ra), np.where(undo_b, a, self.right[a])
        return out

    def _alone(self) -> np.ndarray:
        """Which tokens their own strings encode as: symbols, and merges of such tokens that nothing cuts across."""
        good = self.rank < 0
        good[list(self.special.values())] = False
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        clear = ~self.clashes(self.left[made], self.right[made], self.rank[made])
        for t, ok, x, y in zip(made.tolist(), clear.tolist(), self.left[made].tolist(), self.right[made].tolist(), strict=True):
            good[t] = ok and good[x] and good[y]
        return good

    def spelled(self, word: str) -> str:
        """A word as the characters that stand for its bytes."""
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.symbols.__getitem__, word.encode("utf-8", "replace")))

    def merge(self, spelled: str) -> list[int]:
        """Exact merging of one word: always the oldest merge, the leftmost of equals, until none applies."""
        parts = [self.ids[c] for c in spelled[:-1]] + [self.ids[spelled[-1] + self.suffix]] if spelled else []
        pairs, no = self.pairs, (NEVER, -1)
        found = [pairs.get(p, no) for p in zip(parts, parts[1:], strict=False)]
        while found:
            r, token = min(found)
            if r == NEVER:
                break
            i = found.index((r, token))
            parts[i : i + 2] = [token]
            del found[i]
            if i:
                found[i - 1] = pairs.get((parts[i - 1], token), no)
            if i < len(found):
                found[i] = pairs.get((token, parts[i + 1]), no)
        return parts

    def propose(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match from the left in all words at once: tokens, the word of each, and the words that it covers whole."""
        text = END.join(spelled) + END
        got = [(end, i, n) for end, (i, n) in self.finder.iter_long(text)]
        ends, tokens, sizes = np.array(got, np.int64).reshape(-1, 3).T
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        owner = np.searchsorted(np.cumsum(lengths), ends, side="right")
        covered = np.bincount(owner, sizes, len(spelled)) == lengths - (0 if self.suffix else 1)
        return tokens, owner, covered

    def merge_all(self, spelled: list[str]) -> list[list[int]]:
        """Exact merging of many words in step: each round does the oldest merge, the leftmost of equals, in every word."""
        out: list[list[int]] = [[]] * len(spelled)
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        for i in np.flatnonzero(sizes > WIDEST).tolist():
            out[i] = self.merge(spelled[i])
        low = 1
        for width in (6, 9, 12, 16, 24, WIDEST):
            of = np.flatnonzero((sizes >= low) & (sizes <= width))
            low = width + 1
            if len(of):
                for i, tokens in zip(of.tolist(), self._merge_rows([spelled[i] for i in of.tolist()], sizes[of], width), strict=True):
                    out[i] = tokens
        return out

    def _merge_rows(self, spelled: list[str], sizes: np.ndarray, width: int) -> list[list[int]]:
        n = len(spelled)
        code = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < sizes[:, None]
        tokens = np.full((n, width), -1, np.int64)
        tokens[inside] = self.symbol_id[0, code]
        last = np.cumsum(sizes) - 1
        tokens[np.arange(n), sizes - 1] = self.symbol_id[1, code[last]]
        after = np.where(np.arange(1, width + 1) < sizes[:, None], np.arange(1, width + 1), width)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        ranks = np.full((n, width), NEVER, np.int64)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self._pair_rank(tokens[:, :-1][pair], tokens[:, 1:][pair])
        live = np.arange(n)
        while True:
            i = ranks[live].argmin(1)
            r = ranks[live, i]
            go = r != NEVER
            live, i, r = live[go], i[go], r[go]
            if not len(live):
                break
            new, j = self.made[r], after[live, i]
            k = after[live, j]
            tokens[live, i], tokens[live, j], ranks[live, j] = new, -1, NEVER
            after[live, i] = k
            more = k < width
            before[live[more], k[more]] = i[more]
            ranks[live, i] = NEVER
            ranks[live[more], i[more]] = self._pair_rank(new[more], tokens[live[more], k[more]])
            p = before[live, i]
            more = p >= 0
            ranks[live[more], p[more]] = self._pair_rank(tokens[live[more], p[more]], new[more])
        kept = tokens >= 0
        flat, ends = tokens[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: proposals, one vectorised test of all adjacent pairs, and merging of what failed."""
        spelled = [self.spelled(w) for w in words]
        if not words:
            return []
        tokens, owner, covered = self.propose(spelled)
        bad = ~covered
        bad[owner[~self.is_alone[tokens]]] = True
        inner = np.flatnonzero((owner[1:] == owner[:-1]) & ~bad[owner[1:]])
        bad[owner[1:][inner[self.clashes(tokens[inner], tokens[inner + 1])]]] = True
        ends = np.searchsorted(owner, np.arange(len(words)), side="right").tolist()
        flat = tokens.tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        failed = np.flatnonzero(bad).tolist()
        for i, exact in zip(failed, self.merge_all([spelled[i] for i in failed]), strict=True):
            out[i] = exact
        return out


_tables: dict[str, MergeTable] = {}


def table_for(key: str, text: str) -> MergeTable:
    """One table a worker process and vocabulary."""
    if key not in _tables:
        _tables[key] = MergeTable(text)
    return _tables[key]
