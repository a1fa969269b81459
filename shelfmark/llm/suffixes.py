"""Suffix arrays of many strings at once, by linear grouping.

First the suffixes are gathered in groups by their longest Lyndon prefix. Groups are processed in descending order:
each member points to its nearest earlier suffix in a lower group (its previous smaller one), and suffixes pointed to
equally often move to a new group right above their old one. Then one ascending pass over the finished positions
emits the order within groups: a suffix in place puts the suffix before it, and the chain of its pointers, at the
next free place of their groups. Nothing is renamed and no smaller string is sorted.

Both passes go over all strings in step, one group or place of each at a time, so that each step is array work.
"""

from __future__ import annotations

import numpy as np


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _groups(symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group (its first place) and previous smaller suffix of each position; -1 where there is none."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(starts)), stops - starts)
    base = np.repeat(starts, stops - starts)
    key = owner * (int(symbols.max(initial=0)) + 1) + symbols
    suffix = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[suffix] = np.arange(n)
    ordered = key[suffix]
    new = np.append(True, ordered[1:] != ordered[:-1])
    head = np.flatnonzero(new)
    last = np.zeros(n, np.int64)
    last[head] = np.append(head[1:], n) - 1
    group = np.empty(n, np.int64)
    group[suffix] = head[np.cumsum(new) - 1]
    previous = np.full(n, -1)
    marked = np.zeros(n, bool)
    top, bottom = stops - 1, starts
    while len(top):
        first = group[suffix[top]]
        size = top - first + 1
        member = suffix[_ranges(first, size)]
        here = np.repeat(first, size)
        link = np.where(member > base[member], member - 1, -1)
        todo = np.flatnonzero((link >= 0) & (group[link] > here))
        while len(todo):
            link[todo] = previous[link[todo]]
            todo = todo[(link[todo] >= 0) & (group[link[todo]] > here[todo])]
        previous[member] = link
        # links that stay within the group are followed, twice as far each time
        todo = np.flatnonzero((link >= 0) & (group[link] == here))
        while len(todo):
            previous[member[todo]] = previous[previous[member[todo]]]
            link = previous[member[todo]]
            todo = todo[(link >= 0) & (group[link] == here[todo])]
        parent = previous[member]
        parent = np.sort(parent[parent >= 0])
        if len(parent):
            fresh = np.append(True, parent[1:] != parent[:-1])
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(parent)))
            parent = parent[at]
            old = group[parent]
            order = np.lexsort((times, old))
            parent, old, times = parent[order], old[order], times[order]
            fresh = np.append(True, old[1:] != old[:-1])
            at = np.flatnonzero(fresh)
            moved = np.diff(np.append(at, len(old)))
            holder = old[at]
            end = last[holder]
            target = _ranges(end - moved + 1, moved)
            # whoever stands where the moved ones go takes their places
            now = place[parent]
            marked[target] = True
            left = np.sort(now[~marked[now]])
            marked[target] = False
            marked[now] = True
            taken = target[~marked[target]]
            marked[now] = False
            swapped = suffix[taken]
            suffix[left], place[swapped] = swapped, left
            suffix[target], place[parent] = parent, target
            partly = end - moved >= holder
            last[holder[partly]] = end[partly] - moved[partly]
            split = fresh | np.append(True, times[1:] != times[:-1])
            begin = np.flatnonzero(split)
            last[target[begin]] = target[np.append(begin[1:], len(target)) - 1]
            group[parent] = target[begin][np.cumsum(split) - 1]
        top = first - 1
        alive = top >= bottom
        top, bottom = top[alive], bottom[alive]
    return group, previous


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` in suffix order, string by string.

    ``sizes`` are the lengths of the strings, which follow one another. Each must end in a symbol that is smaller than
    all its others. Symbols are small integers from 0.
    """
    stops = np.cumsum(sizes)
    starts = stops - sizes
    filled = sizes > 0
    starts, stops = starts[filled], stops[filled]
    group, previous = _groups(symbols, starts, stops)
    n = len(symbols)
    out = np.full(n, -1)
    free = np.arange(n)
    done = np.zeros(n, bool)
    base = np.repeat(starts, stops - starts)
    out[starts] = stops - 1
    done[stops - 1] = True
    free[starts] += 1
    order = np.argsort(starts - stops, kind="stable")  # longest first
    starts, lengths = starts[order], (stops - starts)[order]
    for step in range(int(lengths[0]) if len(lengths) else 0):
        alive = np.searchsorted(-lengths, -step, "left")
        here = out[starts[:alive] + step]
        at = here[here > base[here]] - 1
        at = at[~done[at]]
        while len(at):
            where = group[at]
            spot = free[where]
            free[where] += 1
            out[spot] = at
            done[at] = True
            at = previous[at]
            at = at[at >= 0]
            at = at[~done[at]]
    return out


def repeated_windows(pieces: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each group of byte strings, the starts in each string whose ``length`` bytes also start elsewhere in the group.

    A group is sorted as one string, its members joined by a separator, so equal windows stand side by side.
    """
    joined = [b"".join(p + b"\0" for p in group) for group in pieces]
    sizes = np.array([len(j) for j in joined], np.int64)
    data = np.frombuffer(b"".join(joined), np.uint8)
    # 0 ends a group, 1 stands between members, bytes follow
    symbols = data.astype(np.int64) + 2
    ends = np.cumsum([len(p) + 1 for group in pieces for p in group]) - 1
    symbols[ends] = 1
    symbols[np.cumsum(sizes)[sizes > 0] - 1] = 0
    order = suffix_arrays(symbols, sizes)
    whole = np.zeros(len(data), bool)
    begins = ends - np.array([len(p) for group in pieces for p in group], np.int64)
    room = np.maximum(ends - begins - length + 1, 0)
    whole[_ranges(begins, room)] = True
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    order = order[whole[order]]
    left, right = order[:-1], order[1:]
    same = group_of[left] == group_of[right]
    left, right = left[same], right[same]
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words[: len(data)] |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    # the last word may overlap the one before it
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        equal = words[left + at] == words[right + at]
        left, right = left[equal], right[equal]
    for at in range(length if length < 8 else 0):
        equal = data[left + at] == data[right + at]
        left, right = left[equal], right[equal]
    hit = np.zeros(len(data), bool)
    hit[left] = True
    hit[right] = True
    out, number = [], 0
    for group in pieces:
        found = []
        for p in group:
            b = begins[number]
            found.append(np.flatnonzero(hit[b : b + len(p)]))
            number += 1
        out.append(found)
    return out
