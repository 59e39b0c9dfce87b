"""Periodic runs of words, found from Lyndon words, and texts with their repetitions collapsed.

A run is a stretch with a smallest period that no neighbouring word extends. Its Lyndon root starts a longest Lyndon word
under the order of words or under the opposite one (Bannai et al., 2017), and the first phase of Baier's suffix sorter
(2016) leaves every suffix in the group of just that word (Franek et al., 2017). So the groups of both orders give the
roots, and comparing words to both sides of repeated roots gives the runs.

Here only runs of at least ``repeats`` periods and ``least`` words count. A word that occurs less often than ``repeats``
in its document is in none of them, so such words cut the document into stretches, which are grouped side by side.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import in_batches, task, texts

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string, tkey long, n_words long, n_dropped long")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lyndon_groups(codes: np.ndarray, starts: np.ndarray, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(group, length) of the longest Lyndon word at each place of many strings laid end to end.

    ``starts`` are the strings' first places and, last, the total. Equal groups of one string mean equal words. Each
    step takes the highest group that is left in every string, all strings at once: its suffixes leave the list of
    places, and each place before ``k`` of them in a row takes their word ``k`` times to its own; among the places of
    one group those that grow move up, those with more words further.
    """
    n = len(codes)
    first, last = starts[:-1], starts[1:] - 1
    string = np.repeat(np.arange(len(first)), last - first + 1)
    rank = -codes if descending else codes
    at = np.lexsort((rank, string))  # suffixes by string and group
    ordered, owner = rank[at], string[at]
    opens = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])])) if n else np.zeros(0, np.int64)
    begin = np.repeat(opens, np.diff(np.append(opens, n)))  # for each place of ``at``: where its group begins
    group = np.full(n + 1, -1, np.int64)  # of a suffix: where its group begins; the last entry stands for both ends
    group[at] = begin
    end = np.zeros(n, np.int64)
    end[opens] = np.append(opens[1:], n) - 1
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    left, right = np.arange(-1, n), np.arange(1, n + 2)
    left[first], right[last] = n, n
    length = np.ones(n + 1, np.int64)
    moving = np.zeros(n + 1, bool)
    top, floor = last.copy(), first.copy()
    while len(top):
        low = group[at[top]]
        sizes = top - low + 1
        many = len(top) != sizes.sum()
        if many:
            where = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            members, own = at[where], np.repeat(low, sizes)
        else:
            members, own = at[low], low
        before = left[members]
        inner = np.flatnonzero(group[before] == own)
        while len(inner):  # neighbours of the same group lean on the same place; each look doubles the way
            before[inner] = left[before[inner]]
            left[members[inner]] = before[inner]
            inner = inner[group[before[inner]] == own[inner]]
        after = right[members]
        tails = np.flatnonzero(group[after] != own)
        left[after[tails]], right[before[tails]] = before[tails], after[tails]
        lean = before < n
        places, word = before[lean], length[members[lean]]
        if many and len(places):
            order = np.argsort(places, kind="stable")
            places, word = places[order], word[order]
            fresh = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            times = np.diff(np.append(fresh, len(places)))
            places, word = places[fresh], word[fresh]
        else:
            times = np.ones(len(places), np.int64)
        length[places] += times * word
        old = group[places]
        shared = end[old] > old
        if shared.any():
            _move_up(places[shared], old[shared], times[shared], at, place, group, end, moving)
        top = low - 1
        left_over = top >= floor
        if not left_over.all():
            top, floor = top[left_over], floor[left_over]
    return group[:n], length[:n]


def _move_up(places, old, times, at, place, group, end, moving):
    """Set ``places`` at the top of their groups ``old``, in new groups by ``times``."""
    order = np.lexsort((times, old))
    places, old, times = places[order], old[order], times[order]
    heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
    counts = np.diff(np.append(heads, len(places)))
    base = end[old[heads]] - counts + 1
    target = np.repeat(base - heads, counts) + np.arange(len(places))
    moving[places] = True
    there = at[target]
    pushed = there[~moving[there]]
    freed = place[places]
    freed = freed[freed < np.repeat(base, counts)]
    at[freed], place[pushed] = pushed, freed
    at[target], place[places] = places, target
    moving[places] = False
    partial = base > old[heads]
    end[old[heads][partial]] = base[partial] - 1
    new = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
    group[places] = np.repeat(target[new], np.diff(np.append(new, len(places))))
    end[target[new]] = target[np.append(new[1:], len(places)) - 1]


def _agreeing(codes: np.ndarray, a: int, b: int, step: int, room: int) -> int:
    """How many words agree from ``a`` and ``b`` on, going by ``step`` (1 or -1), at most ``room``."""
    done, width = 0, 16
    while done < room:
        m = min(width, room - done)
        x, y = (codes[a + done:a + done + m], codes[b + done:b + done + m]) if step > 0 else (
            codes[a - done - m + 1:a - done + 1][::-1], codes[b - done - m + 1:b - done + 1][::-1])
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done, width = done + m, width * 4
    return done


def runs(codes: np.ndarray, starts: np.ndarray, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``repeats`` (4 or more) periods in each string.

    A run of four periods holds its root three times in a row at places whose longest Lyndon word is the root.
    """
    found = set()
    string = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for descending in (False, True):
        group, period = lyndon_groups(codes, starts, descending)
        here = np.arange(len(codes))
        nearest = np.minimum(here + period, len(codes) - 1)
        linked = (nearest > here) & (group[nearest] == group) & (string[nearest] == string)
        behind = here - period
        headed = linked & linked[nearest] & ~((behind >= 0) & (group[behind] == group) & (string[behind] == string))
        for i in np.flatnonzero(headed):
            i, q, s = int(i), int(period[i]), string[i]
            low, high = int(starts[s]), int(starts[s + 1])
            start = i - _agreeing(codes, i - 1, i + q - 1, -1, i - low)
            stop = i + q + _agreeing(codes, i, i + q, 1, high - i - q)
            if stop - start >= max(least, repeats * q):
                found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The words of a document whose id says that its tail repeats; None: the words stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return None
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _places(blob: np.ndarray, doc_ends: np.ndarray):
    """First and past-last byte of every word, and how many words each document has; documents end in a line feed."""
    space = _SPACE[blob]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    counts = np.diff(np.searchsorted(begins, doc_ends), prepend=0)
    return space, begins, ends, counts


def _codes(blob: np.ndarray, space: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(blob[~space])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _stretches(codes: np.ndarray, counts: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that lie in stretches of words frequent in their document, and the first of them in each stretch."""
    doc = np.repeat(np.arange(len(counts)), counts)
    span = int(codes.max(initial=0)) + 1
    order = np.argsort(doc * span + codes, kind="stable")
    keys = (doc * span + codes)[order]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(fresh, len(keys)))
    often = np.empty(len(codes), bool)
    often[order] = np.repeat(sizes >= repeats, sizes)
    at = np.flatnonzero(often)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc[at]) != 0)])) if len(at) else np.zeros(0, np.int64)
    widths = np.diff(np.append(cut, len(at)))
    at = at[np.repeat(widths >= max(least, repeats), widths)]
    widths = widths[widths >= max(least, repeats)]
    return at, np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)


def _sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def _describe(batches, least, repeats, repeat_tails, chars, want_text):
    for batch in in_batches(batches, 1 << 20, chars):
        ids, keys = batch.column("id").to_pylist(), batch.column("tkey").to_pylist()
        bodies = [t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.binary())]
        if repeat_tails:
            for i, doc_id in enumerate(ids):
                tail = repeated_tail(doc_id, bodies[i].split()) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 else None
                if tail is not None:
                    bodies[i] = b" ".join(tail)
        blob = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
        doc_ends = np.cumsum([len(b) + 1 for b in bodies])
        del bodies
        space, begins, ends, counts = _places(blob, doc_ends)
        codes = _codes(blob, space, begins, ends)
        at, starts = _stretches(codes, counts, least, repeats)
        base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        told = [[] for _ in ids]
        dropped = np.zeros(len(codes), bool)
        for start, length, period in runs(codes[at], starts, least, repeats):
            word = int(at[start])
            doc = int(np.searchsorted(base, word, "right")) - 1
            told[doc].append((word - int(base[doc]), length, period))
            dropped[word + period:word + length] = True
        # Kept words joined by one space: their bytes and, but for a document's first word, the byte before each.
        keep = np.zeros(len(blob) + 1, np.int8)
        stay = ~dropped
        keep[begins[stay]] += 1
        keep[ends[stay]] -= 1
        keep = np.cumsum(keep[:-1]).astype(bool)
        joints = np.ones(len(codes), bool)
        joints[base[:-1][counts > 0]] = False
        joints = begins[joints & stay] - 1
        keep[joints] = True
        shown = blob.copy()
        shown[joints] = 32
        shown = shown[keep]
        cuts = np.concatenate([[0], np.cumsum(keep)[doc_ends - 1]])
        body = shown.tobytes()
        lost = np.concatenate([[0], np.cumsum(dropped)])
        rows = []
        for i, mine in enumerate(told):
            best = None
            for r in mine:
                if best is None or r[1] * best[2] > best[1] * r[2]:  # by start, then period: the first of equals stays
                    best = r
            text = body[cuts[i]:cuts[i + 1]]
            rows.append((ids[i], len(mine), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                         _sha("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()), _sha(text), keys[i], int(counts[i]),
                         int(lost[base[i + 1]] - lost[base[i]]), text.decode() if want_text else None))
        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["collapsed"]
        types = [pa.string() if c in ("runs_sha256", "collapsed_sha256", "collapsed") else pa.int64() for c in names]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        yield pa.RecordBatch.from_arrays(columns[:len(names) - (not want_text)], names[:len(names) - (not want_text)])


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, repeat_tails: bool = False, collapsed: bool = False,
                  id_col: str = "doc_id", text_col: str = "text", chars: int = 6 << 20) -> DataFrame:
    """One row per document: its runs, the strongest of them, and the text with each run cut to its first period.

    ``exponent_milli`` is length over period in thousandths, rounded down; the strongest run has the largest exact quotient,
    ties going to the smallest start, then period, and four NULLs stand for none. ``collapsed`` adds the collapsed text.
    ``repeat_tails`` first rewrites the documents that :func:`repeated_tail` names. NULL and empty texts have no words and
    no runs; NULL ids are ordinary rows that are never rewritten; repeated rows are told each; an empty table gives none;
    other columns are left aside whatever their names. A text is read whole and must fit a row; about ``chars`` characters
    are worked on at once. Nothing is shuffled.
    """
    if repeats < 4:
        raise ValueError("a root is only sure to stand three times in a row in runs of four periods or more")
    asked = texts(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    return asked.mapInArrow(task(_describe, least, repeats, repeat_tails, chars, collapsed), SCHEMA + (", collapsed string" if collapsed else ""))
