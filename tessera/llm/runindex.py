"""A run-compressed Burrows-Wheeler index of many pieces of text, in numpy, and matching statistics streamed through it.

Each piece ends in byte 0xFF (which UTF-8 never has) and has a tag; a pattern meets pieces of its own tag only. Kept per
run of equal letters, and nothing per row: the letter, the length, where last-to-first mapping sends the run (a run and
an offset in it), and the text positions sampled at its two ends. A stream walks each pattern from its end: inside a run
of the wanted letter it follows the mapping; otherwise it jumps to the nearest end of a run of that letter, above or
below, whichever sampled suffix shares more with the current match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = 0xFF


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(15, np.uint8)])
    out = np.empty((len(text) + 7) // 8 * 8, np.uint64)
    for k in range(8):
        part = padded[k : k + len(out)].view(">u8")
        out[k::8] = part
    return out[: len(text)]


def suffix_order(text: np.ndarray, left: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Places in the order of (tag, what follows up to the piece's mark, place), by prefix doubling.

    ``left``: bytes from each place to its piece's mark.
    """
    n = len(text)
    key = words_at(text)
    short = np.flatnonzero(left < 7)
    key[short] &= ~((np.uint64(1) << (np.uint64(8) * (7 - left[short]).astype(np.uint64))) - np.uint64(1))
    order = np.argsort(key, kind="stable")
    if tag.any():
        order = order[np.argsort(tag[order], kind="stable")]
        new = np.concatenate([[True], np.diff(tag[order]) != 0])
    else:
        new = np.zeros(n, bool)
        new[:1] = True
    key = key[order]
    new[1:] |= key[1:] != key[:-1]
    del key
    new |= left[order] < 8  # ended: equal ones stay by place
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, depth = np.flatnonzero(~(new & np.append(new[1:], True))), 8
    while len(slots):
        at = order[slots]
        both = rank[at] * (n + 1) + rank[at + depth]
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[slots] = at
        depth *= 2
        first = np.concatenate([[True], both[1:] != both[:-1]]) | (left[at] < depth)
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        slots = slots[~(first & np.append(first[1:], True))]
    return order


class RunIndex:
    def __init__(self, pieces: list[bytes], tags: np.ndarray):
        """``tags``: small numbers from 0, one per piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        data = b"\xff".join([*pieces, b""])
        text = np.frombuffer(data, np.uint8)
        n = len(text)
        tag = np.repeat(tags.astype(np.int32), sizes)
        left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(n)
        order = suffix_order(text, left, tag)
        del left
        letters = (tag * 256 + text)[order - 1]  # place 0 wraps to the last mark
        change = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        start, end = np.concatenate([[0], change]), np.append(change, n)
        self.letter, self.size = letters[start], end - start
        self.top, self.bottom = order[start], order[end - 1]  # sampled run ends
        del order, letters
        runs = len(start)
        by = np.argsort(self.letter, kind="stable")  # runs by letter are also rows by letter
        to = np.empty(runs, np.int64)
        to[by] = np.cumsum(self.size[by]) - self.size[by]
        self.to_run = np.searchsorted(start, to, side="right") - 1
        self.to_offset = to - start[self.to_run]
        self.of_letter = self.letter[by].astype(np.int64) * runs + by  # sorted
        self.padded = data + bytes(64)
        self.words = np.ndarray((n + 56,), ">u8", self.padded, strides=(1,))  # eight bytes from any place on

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, ``most`` at most."""
        out, live, t = most.copy(), np.flatnonzero(most > 0), 0
        while len(live):
            x = (self.words[a[live] + t] ^ self.words[b[live] + t]).astype(np.uint64)
            odd = x != 0
            out[live[odd]] = t + 8 - np.searchsorted(_BYTES, x[odd], side="right")
            t += 8
            live = live[~odd]
            live = live[most[live] > t]
        return np.minimum(out, most)

    def long_matches(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, tags: np.ndarray, length: int) -> np.ndarray:
        """For each of the patterns text[start:start + size], window by window of ``length`` bytes, end to end: whether the index has it in a piece of the pattern's tag."""
        windows = size - length + 1
        hit = np.zeros(windows.sum(), bool)
        by = np.argsort(-size, kind="stable")
        start, size, wide = start[by], size[by], tags[by].astype(np.int64) * 256
        last = (np.cumsum(windows) - 1)[by]  # of each pattern its last window's place in hit
        runs = len(self.letter)
        run, offset, have = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        at = np.full(len(by), self.top[0])
        upto = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # patterns longer than each step
        for step, m in enumerate(upto.tolist()):
            q, o, pos, got = run[:m], offset[:m], at[:m], have[:m]
            want = wide[:m] + text[start[:m] + size[:m] - 1 - step]
            odd = np.flatnonzero(self.letter[q] != want)
            lost = odd[:0]
            if len(odd):
                c = want[odd] * runs
                j = np.searchsorted(self.of_letter, c + q[odd])
                down, up = self.of_letter[np.minimum(j, runs - 1)] - c, self.of_letter[np.maximum(j - 1, 0)] - c
                below, above = (j < runs) & (down >= 0) & (down < runs), (j > 0) & (up >= 0) & (up < runs)
                down, up, here, most = np.where(below, down, 0), np.where(above, up, 0), pos[odd], got[odd]
                more = np.where(below, self._common(self.top[down], here, np.where(below, most, 0)), -1)
                less = np.where(above, self._common(self.bottom[up], here, np.where(above, most, 0)), -1)
                lower = more > less
                taken = np.where(lower, down, up)
                q[odd], o[odd] = taken, np.where(lower, 0, self.size[taken] - 1)
                pos[odd], got[odd] = np.where(lower, self.top[taken], self.bottom[taken]), np.maximum(more, less)
                lost = odd[~(below | above)]
            o += self.to_offset[q]
            q[:] = self.to_run[q]
            on = np.flatnonzero(o >= self.size[q])
            while len(on):
                o[on] -= self.size[q[on]]
                q[on] += 1
                on = on[o[on] >= self.size[q[on]]]
            pos -= 1
            got += 1
            np.minimum(got, length, out=got)
            if len(lost):  # a letter that the index lacks
                q[lost], o[lost], pos[lost], got[lost] = 0, 0, self.top[0], 0
            if step >= length - 1:
                hit[last[:m] - (step - length + 1)] = got >= length
        return hit


_BYTES = np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))


def _runs(keep: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of kept windows; ``within``: each window's place in its string."""
    opens = keep & ((within == 0) | np.concatenate([[True], ~keep[:-1]])[: len(keep)])
    heads = np.flatnonzero(opens)
    return heads, np.bincount((np.cumsum(opens) - 1)[keep], minlength=len(heads))


def _may_match(words: np.ndarray, start: np.ndarray, windows: np.ndarray, group: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of the runs of windows whose hash another owner's window of the group has too.

    Equal windows have equal hashes, so the others can neither be found nor be needed as a reference. ``words``: the text's eight bytes from any place on.
    """
    seg = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = start[seg] + within
    value = group.astype(np.uint64)[seg]
    for k in range(0, length, 8):
        value = (value ^ words[at + k].astype(np.uint64) >> np.uint64(8 * max(0, k + 8 - length))) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
    by = np.argsort(value, kind="stable")
    value, held = value[by], owner[seg[by]]
    heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
    keep = np.zeros(len(seg), bool)
    if len(heads):
        keep[by] = np.repeat(np.minimum.reduceat(held, heads) != np.maximum.reduceat(held, heads), np.diff(np.append(heads, len(value))))
    first, count = _runs(keep, within)
    return seg[first], within[first], count


#: Windows that are hashed at once, and bytes of strings that are indexed and streamed at once, about: whole groups, one at least.
HASHED, STREAMED = 1 << 20, 4 << 20


def _in_turn(heads: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of strings, whole groups, whose ``size`` adds up to about ``most``; ``heads``: each group's first string."""
    upto = np.append(np.cumsum(size) - size, size.sum())
    turn = upto[np.append(heads[1:], len(size))] // most
    cuts = heads[np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])[: len(heads)])].tolist()
    return zip(cuts, [*cuts[1:], len(size)])


def in_smaller(text: np.ndarray, start: np.ndarray, windows: np.ndarray, group: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For strings text[start:start + windows + length - 1], window by window, end to end: whether a string of the same group and a smaller owner has it.

    Windows whose hash no other owner of the group has are passed over. Of the rest each group's owners are halved again and again:
    the strings of the smaller half are the reference, which is indexed, those of the larger half are streamed through it. What a
    stream finds is cut off before the halves are treated on their own: it is in the smaller half, so it is needed no more, neither
    as a reference. Windows must be unlike between groups. Groups go in turn, many at once, as a step of a stream costs about the
    same for one string and for a thousand.
    """
    hit = np.zeros(windows.sum(), bool)
    by = np.lexsort((owner, group))
    base = (np.cumsum(windows) - windows)[by]
    start, windows, group, owner = start[by], windows[by], group[by], owner[by]
    new_group = np.concatenate([[True], group[1:] != group[:-1]])[: len(by)]
    rank = np.cumsum(new_group | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(by)]) - 1
    heads, of = np.flatnonzero(new_group), np.cumsum(new_group) - 1
    low, high = rank[heads][of], np.append(rank[heads[1:]], rank[-1:] + 1)[of]
    words = np.ndarray((len(text) + 56,), ">u8", text.tobytes() + bytes(64), strides=(1,))
    runs = [(np.zeros(0, np.int64),) * 3]
    for a, b in _in_turn(heads, windows, HASHED):
        item, first, count = _may_match(words, start[a:b], windows[a:b], group[a:b], owner[a:b], length)
        runs.append((item + a, first, count))
    del words
    item, first, count = (np.concatenate(x) for x in zip(*runs))
    for a, b in _in_turn(heads, np.bincount(item, count + length - 1, len(by)).astype(np.int64), STREAMED):
        i, j = np.searchsorted(item, [a, b])
        _halved(hit, text, start[a:b], base[a:b], rank[a:b] - rank[a], low[a:b] - rank[a], high[a:b] - rank[a], item[i:j] - a, first[i:j], count[i:j], length)
    return hit


def _halved(hit: np.ndarray, text: np.ndarray, start: np.ndarray, base: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> None:
    """Marks in ``hit`` what ``in_smaller`` finds of the runs (item, first, count); ``rank``: of a string's owner, from ``low`` to ``high`` in its group."""
    tag = np.zeros(len(rank), np.int64)
    while True:
        live = high[item] - low[item] > 1
        item, first, count = item[live], first[live], count[live]
        if not len(item):
            return
        middle = (low + high) // 2
        upper = rank >= middle
        side = upper[item]
        both = [np.bincount(low[item[s]], minlength=len(rank)) > 0 for s in (~side, side)]
        met = (both[0] & both[1])[low[item]]
        left, right = np.flatnonzero(met & ~side), np.flatnonzero(met & side)
        if len(left):
            _, tags = np.unique(np.concatenate([tag[item[left]], tag[item[right]]]), return_inverse=True)
            begin = start[item] + first
            end = begin + count + length - 1
            data = text.data
            index = RunIndex([bytes(data[a:b]) for a, b in zip(begin[left].tolist(), end[left].tolist())], tags[: len(left)])
            found = index.long_matches(text, begin[right], (end - begin)[right], tags[len(left) :], length)
            del index
            n = count[right]
            seg = np.repeat(np.arange(len(right)), n)
            within = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
            place = base[item[right]][seg] + first[right][seg] + within
            hit[place[found]] = True
            # what is left of the streamed strings: runs of windows that were not found
            heads, length_of = _runs(~found, within)
            keep = np.ones(len(item), bool)
            keep[right] = False
            item, first, count = (np.concatenate([x[keep], y]) for x, y in ((item, item[right][seg[heads]]), (first, first[right][seg[heads]] + within[heads]), (count, length_of)))
        wide = high - low > 1
        tag = np.where(wide, 2 * tag + upper, tag)
        low, high = np.where(wide & upper, middle, low), np.where(wide & ~upper, middle, high)
