"""Folds over the boxes and rows of pages, for whole Arrow batches: a step takes the next box of all pages of a batch at once.

What a fold carries from box to box is a few numbers a page, so a step costs the same for the tenth thousandth box as for the first. Places without a value are NaN,
which fmin and fmax pass over as SQL's least and greatest do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.functions.text import SPACE
from pagewright.schema import BULLETS, LIMITS, TERMINATORS

SIDES = ("x0", "x1", "y0", "y1")
BOX = pa.struct([*((c, pa.float64()) for c in SIDES), ("text", pa.string())])
#: So many boxes are worked on at once, and so many places for open rows.
PART, PLACES = 500_000, 4_000_000
FREE = np.iinfo(np.int64).max
#: The patterns of functions.text in RE2's words, for text whose white space at the end is gone where they end by $.
_S, _EOL = f"[{SPACE}]", "\n\r\x85\u2028\u2029"
PAGE_NUMBER = r"^\p{Nd}{1,4}[.,]?$"
TRAILING_NUMBER = rf"{_S}\p{{Nd}}{{1,4}}[.,]?$"
TRAILING_JOINED = rf"(?:^|{_S})\p{{Nd}}{{1,4}}[.,]?$"
LEADING_NUMBER = rf"^\p{{Nd}}{{1,4}}{_S}"
LIST_ITEM = rf"^(?:[{BULLETS}]|\p{{Nd}}{{1,2}}[.)]){_S}+[^{SPACE}][^{_EOL}]*(?:\r\n|[{_EOL}])?$"


def lengths(lists: pa.Array) -> np.ndarray:
    """Of each list; null is empty."""
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each of so many begins; the last one's end comes last."""
    return np.concatenate(([0], np.cumsum(counts)))


def listed(counts: np.ndarray, flat: pa.Array, like: pa.Array | None = None) -> pa.Array:
    """Lists of so many elements; null where `like` is."""
    mask = like.is_null() if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(pa.array(starts(counts).astype(np.int32)), flat, mask=mask)


def column(boxes: pa.Array, name: str) -> np.ndarray:
    return pc.struct_field(boxes, name).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., so many of each, one after another."""
    return np.arange(counts.sum()) + np.repeat(first - starts(counts)[:-1], counts)


def least_and_most(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of values, which begin at `first`."""
    return (np.fmin.reduceat(values, first), np.fmax.reduceat(values, first)) if len(first) else (np.zeros(0), np.zeros(0))


def by(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places by owner and value, none first, then as they came."""
    if np.isnan(value).any():
        return np.lexsort((value, ~np.isnan(value), owner))
    return np.lexsort((value, owner))


def in_parts(run: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """run, over columns of which the first holds lists, for as many rows at once as PART elements have, one at least."""

    def parts(lists: pa.Array, *more: pa.Array) -> pa.Array:
        ends, out, at = np.cumsum(lengths(lists)), [], 0
        while at < len(lists) or not out:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            out.append(run(*(c[at:to] for c in (lists, *more))))
            at = to
        return out[0] if len(out) == 1 else pa.concat_arrays(out)

    return parts


def of_each(run: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """run, for lists of what it takes."""

    def each(lists: pa.Array, *more: pa.Array) -> pa.Array:
        return listed(lengths(lists), run(lists.flatten(), *(m.flatten() for m in more)), lists)

    return each


def first_fits(counts: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """For each box, by page and centre, the number of the row of its page that it goes into: the first whose height it shares by half, else a new one.

    A range whose centre lies below a row's end shares less than half with it, so a row that ends well above a box's centre takes no more boxes, and its place is free.
    """
    found, first = np.zeros(len(y0), np.int64), starts(counts)
    pages = np.argsort(-counts, kind="stable")
    at = 0
    while at < len(pages) and counts[pages[at]]:
        # pages of like lengths together, so that the longest alone may have many rows open
        own = pages[at : at + max(1, PLACES // int(counts[pages[at]]))]
        at += len(own)
        n, begin = counts[own], first[own]
        top, bottom, row = np.zeros((len(own), 4)), np.zeros((len(own), 4)), np.full((len(own), 4), FREE)
        made, active = np.zeros(len(own), np.int64), np.searchsorted(-n, -np.arange(n[0]), "left")
        for k in range(int(n[0])):
            m = int(active[k])
            here, i = np.arange(m), begin[:m] + k
            a, b = y0[i, None], y1[i, None]
            t, z, r = top[:m], bottom[:m], row[:m]
            r[z + 1 < (a + b) / 2] = FREE
            both, union = np.fmin(z, b) - np.fmax(t, a), np.fmax(z, b) - np.fmin(t, a)
            with np.errstate(divide="ignore", invalid="ignore"):
                fits = (r != FREE) & (both > 0) & (union > 0) & (both / union >= LIMITS.row_overlap)
            place = np.where(fits, r, FREE).argmin(1)
            new = ~fits[here, place]
            if new.any():
                free = r == FREE
                if not free[new].any(1).all():
                    top, bottom, row = (np.concatenate((x, np.full(x.shape, e)), 1) for x, e in ((top, 0.0), (bottom, 0.0), (row, FREE)))
                    t, z, r = top[:m], bottom[:m], row[:m]
                    free = r == FREE
                place[new] = free[new].argmax(1)
                p, q = here[new], place[new]
                t[p, q], z[p, q], r[p, q] = a[new, 0], b[new, 0], made[p]
                made[p] += 1
            t[here, place], z[here, place] = np.fmin(t[here, place], a[:, 0]), np.fmax(z[here, place], b[:, 0])
            found[i] = r[here, place]
    return found


def _grouped(boxes: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of pages, all boxes, their order by page, row and centre, their page and row, in that order."""
    counts, flat = lengths(boxes), boxes.flatten()
    page, y0, y1 = np.repeat(np.arange(len(counts)), counts), column(flat, "y0"), column(flat, "y1")
    order = by(page, (y0 + y1) / 2)
    row = first_fits(counts, y0[order], y1[order])
    again = np.lexsort((row, page))
    return counts, flat, order[again], page, row[again]


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Places at which one of the keys is another than before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


@in_parts
def group_rows(boxes: pa.Array) -> pa.Array:
    counts, flat, order, page, row = _grouped(boxes)
    first = _begins(page, row)
    sizes = np.diff(np.append(first, len(order)))
    y0, y1 = least_and_most(column(flat, "y0")[order], first)[0], least_and_most(column(flat, "y1")[order], first)[1]
    made = pa.StructArray.from_arrays([doubles(y0), doubles(y1), listed(sizes, flat.take(pa.array(order)))], ["y0", "y1", "boxes"])
    return listed(np.bincount(page[first], minlength=len(counts)), made, boxes)


def _cuts(first: np.ndarray, counts: np.ndarray, x0: np.ndarray, x1: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row of two boxes or more, how many stay left of a split; 0 for none. A row's boxes begin at `first`; left, right: its page's gutter."""
    begin, at = starts(counts - 1)[:-1], ranges(first + 1, counts - 1)
    owner, gap = np.repeat(np.arange(len(first)), counts - 1), x0[at] - x1[at - 1]
    none = len(at)
    place = np.arange(none)
    spans = (gap > 0) & (x1[at - 1] <= right[owner]) & (x0[at] >= left[owner])
    spanning = np.minimum.reduceat(np.where(spans, place, none), begin)
    most = np.fmax.reduceat(gap, begin)
    widest = np.minimum.reduceat(np.where(gap == most[owner], place, none), begin)
    wide = (spanning == none) & (most >= LIMITS.split_gap_px)
    several = np.flatnonzero(wide & (counts > 2))
    if len(several):
        m = counts[several] - 1
        some = np.where(np.isnan(gap), -np.inf, gap)[ranges(begin[several], m)]
        ordered = some[np.lexsort((some, np.repeat(np.arange(len(several)), m)))]
        # without the widest, which is the last, the greater of the two in the middle
        median = ordered[starts(m)[:-1] + (m - 1) // 2]
        wide[several] &= ~((median > 0) & (most[several] < median * LIMITS.split_gap_ratio))
    cut = np.where(spanning < none, spanning, np.where(wide, widest, begin - 1))
    return cut - begin + 1


def _pieces(first: np.ndarray, counts: np.ndarray, x0: np.ndarray, x1: np.ndarray, left: np.ndarray, right: np.ndarray, said: np.ndarray, text: pa.Array) -> np.ndarray:
    """Where the pieces begin that rows are cut into: the left part is done, the right one is looked at again."""
    found, sums = [first], starts(said)
    own = counts > 1
    first, counts, left, right = first[own], counts[own], left[own], right[own]
    while len(first):
        n = _cuts(first, counts, x0, x1, left, right)
        cut = n > 0
        first, counts, left, right, n = first[cut], counts[cut], left[cut], right[cut], n[cut]
        # a page number alone on the right is no column
        begin = first + n
        alone = np.flatnonzero(sums[first + counts] - sums[begin] == 1)
        if len(alone):
            only = np.searchsorted(sums, sums[begin[alone]], "right") - 1
            number = pc.match_substring_regex(pc.utf8_trim(text.take(pa.array(only)), SPACE), PAGE_NUMBER).to_numpy(zero_copy_only=False).astype(bool)
            n[alone[number]] = 0
        cut = n > 0
        first, counts, left, right = (first + n)[cut], (counts - n)[cut], left[cut], right[cut]
        found.append(first)
        own = counts > 1
        first, counts, left, right = first[own], counts[own], left[own], right[own]
    return np.sort(np.concatenate(found))


@in_parts
def rows(boxes: pa.Array, gutter: pa.Array | None = None) -> pa.Array:
    counts, flat, order, page, row = _grouped(boxes)
    first = _begins(page, row)
    sizes = np.diff(np.append(first, len(order)))
    order = order[by(np.repeat(np.arange(len(first)), sizes), column(flat, "x0")[order])]
    x0, x1, y0, y1 = (column(flat, c)[order] for c in SIDES)
    text = pc.struct_field(flat, "text").take(pa.array(order))
    said = pc.not_equal(pc.utf8_ltrim(text, SPACE), "").fill_null(False).to_numpy(zero_copy_only=False)
    left, right = (np.full(len(counts), np.nan) if gutter is None else column(gutter, c) for c in ("left", "right"))
    first = _pieces(first, sizes, x0, x1, left[page[first]], right[page[first]], said, text)
    owner, sides = page[first], [least_and_most(v, first)[k] for v, k in ((x0, 0), (x1, 1), (y0, 0), (y1, 1))]
    words = np.add.reduceat(said.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    joined = pc.binary_join(listed(words, text.filter(pa.array(said))), " ")
    kept = np.flatnonzero(words)
    order = kept[by(owner[kept], (sides[2][kept] + sides[3][kept]) / 2)]
    made = pa.StructArray.from_arrays([*(doubles(s[order]) for s in sides), joined.take(pa.array(order))], [*SIDES, "text"])
    return listed(np.bincount(owner[kept], minlength=len(counts)), made, boxes)


def _some(texts: pa.Array, which: np.ndarray, test: Callable[[pa.Array], pa.Array]) -> np.ndarray:
    """test of those texts; False of others."""
    found = np.zeros(len(texts), bool)
    at = np.flatnonzero(which)
    if len(at):
        found[at] = test(texts.take(pa.array(at))).to_numpy(zero_copy_only=False)
    return found


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def _titled(texts: pa.Array) -> pa.Array:
    """Whether texts, which aren't finished, can be headings."""
    bare = pc.utf8_rtrim(texts, SPACE)
    alnum, digits = pc.count_substring_regex(texts, r"[\p{L}\p{N}]"), pc.count_substring_regex(texts, r"\p{Nd}")
    numeric = pc.and_(pc.greater_equal(alnum, LIMITS.numeric_chars), pc.greater_equal(pc.cast(digits, pa.float64()), pc.multiply(pc.cast(alnum, pa.float64()), LIMITS.numeric_share)))
    numbered = pc.or_(pc.match_substring_regex(bare, TRAILING_NUMBER), pc.match_substring_regex(bare, LEADING_NUMBER))
    return pc.and_(pc.less_equal(pc.utf8_length(texts), LIMITS.ocr_heading_length), pc.and_not(pc.not_equal(bare, ""), pc.or_(numeric, numbered)))


def _medians(counts: np.ndarray, owner: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Of each page's heights the middle one, of two the greater; 10 for 0."""
    median, some = np.full(len(counts), np.nan), counts > 0
    median[some] = heights[by(owner, heights)][(starts(counts)[:-1] + counts // 2)[some]]
    return np.where(median == 0, 10.0, median)


@in_parts
def paragraphs(items: pa.Array) -> pa.Array:
    counts, flat = lengths(items), items.flatten()
    owner, first = np.repeat(np.arange(len(counts)), counts), starts(counts)
    x0, x1, y0, y1 = (column(flat, c) for c in SIDES)
    text = pc.struct_field(flat, "text").fill_null("")
    h = y1 - y0
    median = _medians(counts, owner, h)[owner]
    bare = pc.utf8_rtrim(text, SPACE)
    start, end = pc.utf8_slice_codeunits(text, 0, 1), pc.utf8_slice_codeunits(bare, -1)
    finished = _flags(pc.is_in(end, pa.array(list(TERMINATORS))))
    number_like, item_like = ~_flags(pc.utf8_is_alpha(end)) & ~finished, ~_flags(pc.utf8_is_alpha(start))
    empty = _flags(pc.equal(bare, ""))
    matches = lambda pattern: lambda t: pc.match_substring_regex(t, pattern)
    entry = _some(text, item_like, matches(f"{LEADING_NUMBER}|{LIST_ITEM}"))
    # whether the paragraph ends with this row, by its text, where that is the first of it, and where it is joined to what comes before
    ends = (empty | finished | _some(bare, number_like, matches(TRAILING_NUMBER)), ~empty & (finished | _some(bare, number_like, matches(TRAILING_JOINED))))
    tall = (median > 0) & ((h >= median * LIMITS.ocr_heading_h3) | np.isnan(h))
    # headings begin with a tall row, so that texts before a page's first needn't be looked at
    place = np.arange(len(owner))
    begun = np.full(len(counts), len(owner))
    np.minimum.at(begun, owner[tall], place[tall])
    titled = _some(text, (place >= begun[owner]) & ~finished, _titled)
    head, unknown = tall & titled & ~np.isnan(h), tall & titled & np.isnan(h)
    gap = np.full(len(owner), np.nan)
    gap[1:] = y0[1:] - y1[:-1]
    gap[first[:-1][counts > 0]] = np.nan
    goes_on = head | (median > 0) & (gap <= median * LIMITS.ocr_continued_gap) & (h >= median * LIMITS.ocr_continued_height) & titled
    near = (gap <= median * LIMITS.paragraph_gap) & ~entry

    merged, heading = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    pages = np.argsort(-counts, kind="stable")
    begin, longest = first[pages], int(counts.max(initial=0))
    active = np.searchsorted(-counts[pages], -np.arange(longest), "left")
    was_head = was_merged = np.zeros(len(pages), bool)
    for k in range(longest):
        i = begin[: active[k]] + k
        was_head, was_merged = was_head[: len(i)], was_merged[: len(i)]
        # a page's first row has no gap before it, so it is never near
        closed = np.where(was_merged, ends[1][i - 1], ends[0][i - 1]) | (was_head & ~goes_on[i]) | (unknown[i - 1] & ~was_merged)
        was_merged = near[i] & ~closed
        was_head = np.where(was_merged, was_head & goes_on[i], head[i])
        merged[i], heading[i] = was_merged, was_head

    begins = np.flatnonzero(~merged)
    last = np.append(begins[1:], len(owner)) - 1 if len(begins) else begins
    is_last = np.zeros(len(owner), bool)
    is_last[last] = True
    shown = is_last | ~empty
    parts = pc.if_else(pa.array(is_last), text, bare).filter(pa.array(shown))
    words = np.add.reduceat(shown.astype(np.int64), begins) if len(begins) else begins
    level = np.where(least_and_most(h, begins)[1] >= median[begins] * LIMITS.ocr_heading_h2, 2, 3).astype(np.int32)
    made = pa.StructArray.from_arrays(
        [pc.binary_join(listed(words, parts), " "), doubles(x0[begins]), doubles(least_and_most(x1, begins)[1]), doubles(y0[begins]), doubles(y1[last]), pa.array(level, pa.int32(), mask=~heading[last])],
        ["text", *SIDES, "level"],
    )
    return listed(np.bincount(owner[begins], minlength=len(counts)), made, items)
