"""Exact merge-rank BPE by backtracking, over many short words at once.

A word's encoding is found without running the merges: at each position the
longest vocabulary entry is proposed, accepted when it is *compatible* with the
token before it (re-merging the two leaves them as they are), shortened when it
is not, and given up (its start is noted as failed) when nothing shorter is
left.  All words of a block advance in lockstep, so the work is numpy gathers.

Defined results: an empty word has no tokens; base symbols without an entry in
the vocabulary must be split out by the caller (``MergeVocabulary.has``).
"""

from __future__ import annotations

import json

import numpy as np

from .words import runs

NONE = np.int64(1) << 60
#: So many symbols advance together; a longer word stands alone.
CELLS = 300_000


class MergeVocabulary:
    """Tokens as symbol strings, the merges that make them, and a trie of them.

    ``tokens``: id -> tuple of symbols; ``pairs``: (left id, right id) ->
    (rank, merged id); ``units``: symbol tuple -> id of the base tokens.
    ``width``: number of distinct symbols.
    """

    def __init__(self, tokens: dict[int, tuple[int, ...]], pairs: dict[tuple[int, int], tuple[int, int]], units: dict[tuple[int, ...], int], width: int):
        self.pairs, self.units, self.width = pairs, units, width
        size = max(tokens) + 1
        self.size = size
        self.length = np.zeros(size, np.int32)
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        base = set(units.values())
        longest_unit = max(map(len, units))
        reachable = []
        for token, symbols in tokens.items():
            self.length[token] = len(symbols)
            if token in base:
                reachable.append(token)
                continue
            parts, last = [], None
            at = 0
            while at < len(symbols) and parts is not None:
                for n in range(1, longest_unit + 1):
                    if (u := units.get(symbols[at : at + n])) is not None:
                        parts.append(u)
                        at += n
                        break
                else:
                    parts = None
            if parts is None:
                continue
            ids, last = self.merge(parts)
            if ids == [token] and last:
                self.left[token], self.right[token] = last
                self.rank[token] = pairs[last][0]
                reachable.append(token)
        self.monotone = bool(all(self.rank[t] < 0 or self.rank[t] > max(self.rank[self.left[t]], self.rank[self.right[t]]) for t in reachable))
        keys = np.fromiter((a * size + b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        # verdicts of pairs met before: a direct-mapped table of fixed size
        self.seen_keys = np.full(1 << 20, -1, np.int64)
        self.seen_ok = np.zeros(1 << 20, bool)
        #: The tokens that merging can give, by their symbols.
        self.reachable = {tokens[t]: t for t in reachable}
        self._known: dict[tuple[int, int], bool] = {}
        self._trie([(t, tokens[t]) for t in sorted(reachable, key=lambda t: len(tokens[t]))])

    def _trie(self, entries: list[tuple[int, tuple[int, ...]]]) -> None:
        """The trie as one array: the node below node n by symbol s, if there is one,
        is place ``base[n] + s``, whose ``owner`` is n.  A row of all symbols for each
        node would be nearly empty and take hundreds of megabytes.  Place 0 is "dead"
        so that a walk can run past the end of a word, place 1 is the root."""
        token = np.array([t for t, _ in entries])
        lens = np.array([len(symbols) for _, symbols in entries])
        flat = np.fromiter((s for _, symbols in entries for s in symbols), np.int64, int(lens.sum()))
        begin = np.cumsum(lens) - lens
        self.shorter = np.full(self.size, -1, np.int32)
        # nodes are numbered by level first, in the order of their edges
        node, best = np.ones(len(token), np.int64), np.full(len(token), -1, np.int32)
        count, edges, ids = 2, [], [np.full(2, -1, np.int32)]
        on = np.arange(len(token))
        for d in range(int(lens.max())):
            on = on[lens[on] > d]
            edge, place = np.unique(node[on] * (self.width + 1) + flat[begin[on] + d], return_inverse=True)
            edges.append(edge)
            ends = lens[on] == d + 1
            here = np.full(len(edge), -1, np.int32)
            here[place[ends]] = token[on[ends]]
            ids.append(here)
            self.shorter[token[on[ends]]] = best[on[ends]]
            best[on] = np.where(here[place] >= 0, here[place], best[on])
            node[on] = count + place
            count += len(edge)
        parent, symbol = np.divmod(np.concatenate(edges), self.width + 1)
        below = np.bincount(parent, minlength=count)
        first = np.cumsum(below) - below
        # nodes with the most edges choose first; the places taken are the bits of a number
        base, taken = np.zeros(count, np.int64), 3
        for n in sorted(np.flatnonzero(below > 1).tolist(), key=lambda n: -below[n]):
            clash = mask = 0
            for s in symbol[first[n] : first[n] + below[n]].tolist():
                clash |= taken >> s
                mask |= 1 << s
            base[n] = (~clash & (clash + 1)).bit_length() - 1
            taken |= mask << int(base[n])
        # an only edge takes any place that is left
        alone = np.flatnonzero(below[parent] == 1)
        size = taken.bit_length() + len(alone) + self.width
        bits = np.unpackbits(np.frombuffer(taken.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")
        base[parent[alone]] = np.flatnonzero(bits[self.width :] == 0)[: len(alone)] + self.width - symbol[alone]
        at = np.concatenate([[0, 1], base[parent] + symbol])
        size = int(max(at.max(), base.max())) + self.width + 1
        self.base, self.owner, self.token_at = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[at], self.token_at[at] = base, np.concatenate(ids)
        self.owner[at[2:]] = at[parent]

    def child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node below ``node`` by ``symbol``, 0 where there is none."""
        at = self.base[node] + symbol
        return at * (self.owner[at] == node)

    def merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """Plain merging: lowest rank first, leftmost first on ties."""
        ids, last = list(ids), None
        while True:
            best = None
            for i in range(len(ids) - 1):
                p = self.pairs.get((ids[i], ids[i + 1]))
                if p is not None and (best is None or p[0] < best[0]):
                    best = (p[0], i, p[1])
            if best is None:
                return ids, last
            i = best[1]
            last = (ids[i], ids[i + 1])
            ids[i : i + 2] = [best[2]]

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether re-merging the symbols of a then b gives a, b again.

        Walks back in time along a's right edge and b's left edge: at each
        moment the two parts that touch must not merge before one of them is
        used up.  On equal ranks the merge further left comes first.
        """
        keys = a.astype(np.int64) * self.size + b
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        known = self.seen_keys[slot] == keys
        out = self.seen_ok[slot]
        if not known.all():
            new = np.flatnonzero(~known)
            out[new] = self._walk(keys[new])
            # two keys may share a slot: key and verdict are written by the same winner
            self.seen_keys[slot[new]] = keys[new]
            won = self.seen_keys[slot[new]] == keys[new]
            self.seen_ok[slot[new[won]]] = out[new[won]]
        return out

    def fits(self, a: int, b: int) -> bool:
        """``compatible`` for one pair."""
        key = (a, b)
        if (known := self._known.get(key)) is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            known = self._known[key] = bool(self._walk_one(a, b))
        return known

    def _walk_one(self, x: int, y: int) -> bool:
        rank, left, right, pairs, never = self.rank, self.left, self.right, self.pairs, (int(NONE),)
        cx = cy = int(NONE)
        while True:
            r = pairs.get((x, y), never)[0]
            if r < cx and r <= cy:
                return False
            rx, ry = int(rank[x]), int(rank[y])
            if rx < 0 and ry < 0:
                return True
            if ry >= rx:
                cy, y = ry, int(left[y])
            else:
                cx, x = rx, int(right[x])

    def _walk(self, keys: np.ndarray) -> np.ndarray:
        x, y = keys // self.size, keys % self.size
        ok = np.ones(len(keys), bool)
        on = np.arange(len(keys))
        cx = np.full(len(keys), NONE)
        cy = np.full(len(keys), NONE)
        while len(on):
            r = self._pair_rank(x, y)
            bad = (r < cx) & (r <= cy)
            ok[on[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_y = ry >= rx
            cy = np.where(undo_y, ry, cy)
            cx = np.where(undo_y, cx, rx)
            live = ~bad & ((rx >= 0) | (ry >= 0))
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
            on, x, y, cx, cy = on[live], x[live], y[live], cx[live], cy[live]
        return ok

    def encode_many(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, end to end, and how many each word has."""
        found = [self._block(flat[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])) for a, b in runs(offsets, CELLS)]
        if not found:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found])

    def _block(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # words lie end to end, with a free cell behind each; positions are cells
        begin = np.cumsum(lens + 1) - lens - 1
        stop = begin + lens
        cell = np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)
        sym = np.full(len(flat) + len(lens), self.width, np.int32)
        sym[cell] = flat
        # longest entry that starts at each position
        best = np.full(len(sym), -1, np.int32)
        node = self.child(np.ones(1, np.int32), sym[cell])
        while len(live := np.flatnonzero(node)):
            cell, node = cell[live], node[live]
            token = self.token_at[node]
            hit = np.flatnonzero(token >= 0)
            best[cell[hit] - self.length[token[hit]] + 1] = token[hit]
            cell = cell + 1
            node = self.child(node, sym[cell])
        stack = np.zeros(len(sym), np.int32)
        top, at = begin.copy(), begin.copy()
        failed = np.zeros(len(sym), bool)
        cand = best[begin]
        on = np.flatnonzero(lens)
        while len(on):
            c = cand[on]
            if (c < 0).any():
                raise ValueError("a base symbol has no token")
            end = at[on] + self.length[c]
            ok = ~failed[end]
            if (check := np.flatnonzero(ok & (top[on] > begin[on]))).size:
                ok[check] = self.compatible(stack[top[on[check]] - 1], c[check])
            good = np.flatnonzero(ok)
            w = on[good]
            stack[top[w]] = c[good]
            top[w] += 1
            at[w] = end[good]
            more = end[good] < stop[w]
            cand[w[more]] = best[end[good[more]]]
            bad = np.flatnonzero(~ok)
            less = self.shorter[c[bad]]
            short = less >= 0
            cand[on[bad[short]]] = less[short]
            stuck = on[bad[~short]]
            if stuck.size:
                if (top[stuck] == begin[stuck]).any():
                    raise ValueError("no encoding")
                failed[at[stuck]] = True
                top[stuck] -= 1
                last = stack[top[stuck]]
                at[stuck] -= self.length[last]
                cand[stuck] = last
            if not more.all():
                on = np.delete(on, good[~more])
        depth = top - begin
        return stack[np.repeat(begin - np.cumsum(depth) + depth, depth) + np.arange(depth.sum())], depth


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def from_json(path: str) -> MergeVocabulary:
    """A byte-level BPE file.  With an end-of-word suffix the last byte of a
    word is its own symbol, byte + 256."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
    vocab = model["vocab"]
    tokens, units = {}, {}
    for name, i in vocab.items():
        end = bool(suffix) and name.endswith(suffix) and name != suffix
        core = name[: -len(suffix)] if end else name
        if not core or any(ch not in letters for ch in core):
            continue
        symbols = [letters[ch] for ch in core]
        if end:
            symbols[-1] += 256
        tokens[i] = tuple(symbols)
        if len(symbols) == 1:
            units[tuple(symbols)] = i
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        # a left part carries no suffix; the merged name is the plain concatenation
        if a in vocab and b in vocab and a + b in vocab:
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return MergeVocabulary(tokens, pairs, units, 512 if suffix else 256)


def from_sentencepiece(path: str) -> tuple[MergeVocabulary, "np.ndarray", object]:
    """(vocabulary over UTF-8 bytes, ids of the 256 byte pieces, processor)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores, byte_ids = {}, {}, np.full(256, -1, np.int32)
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            names[name], scores[name] = i, sp.get_score(i)
    # any two neighbours whose text is an entry merge, best score first
    place = {s: r for r, s in enumerate(sorted({s for n, s in scores.items()}, reverse=True))}
    pairs = {(names[n[:k]], names[n[k:]]): (place[scores[n]], i) for n, i in names.items() for k in range(1, len(n)) if n[:k] in names and n[k:] in names}
    tokens = {i: tuple(n.encode()) for n, i in names.items()}
    units = {tuple(n.encode()): i for n, i in names.items() if len(n) == 1}
    return MergeVocabulary(tokens, pairs, units, 256), byte_ids, sp
