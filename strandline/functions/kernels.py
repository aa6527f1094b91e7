"""Sequence kernels: plain Python on strings, called from Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Generator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

# Half-widths of the tiles of the linear competition test, in turn; tile and step of the tail and mate tests.
HALF_TILES = (9, 7, 5, 4, 3)
TILE, STEP, ANCHOR = 10, 5, 7
_OTHER = re.compile("[^ACGTN]")


def canonical(seq: str) -> str:
    """Upper case; letters that are no base or N are one symbol."""
    return _OTHER.sub("X", seq.upper())


@dataclass(frozen=True)
class Region:
    """A stretch of a chromosome of n bases, from offset on."""

    seq: str
    offset: int
    n: int

    def cut(self, start: int, end: int) -> str:
        """Bases [start, end) of the chromosome, as far as it goes."""
        start, end = max(0, start), min(self.n, end)
        return self.seq[start - self.offset : end - self.offset] if end > start else ""

    def padded(self, start: int, end: int) -> str:
        """As cut, with N before the chromosome's start."""
        return "N" * max(0, min(-start, end - start)) + self.cut(start, end)

    def ring(self, site1: int, site2: int) -> str:
        """The junction's own sequence, with the signal's two bases on either side."""
        return self.cut(site1 - 3, site2 + 2)

    def before(self, site1: int, site2: int, width: int) -> str:
        """The linear competitor left of the junction, as wide as asked or as the junction."""
        return self.cut(site1 - 1 - max(width, site2 - site1 + 5), site1 - 1)

    def after(self, site1: int, site2: int, width: int) -> str:
        return self.cut(site2, site2 + max(width, site2 - site1 + 5))


@dataclass(frozen=True)
class Hits:
    """Where tiles are found in a sequence."""

    places: list[int]

    @property
    def found(self) -> int:
        return sum(p >= 0 for p in self.places)

    @property
    def missed(self) -> int:
        return len(self.places) - self.found

    @property
    def longest_gap(self) -> int:
        return max((len(run) for run in re.findall("0+", "".join("01"[p >= 0] for p in self.places))), default=0)

    @property
    def travel(self) -> int:
        """How far apart neighbouring hits are, in all."""
        return sum(abs(b - a) for a, b in pairwise(p for p in self.places if p >= 0))


def look(tiles: list[str], text: str, last: bool = False) -> Hits:
    return Hits([text.rfind(t) if last else text.find(t) for t in tiles])


def tiles_of(part: str, half: int, from_right: bool) -> list[str]:
    """Tiles of twice half, every half bases from one end, and one at the other end if some are left over."""
    n, size = len(part), 2 * half
    starts = range(0, n - size + 1, half)
    tiles = [part[n - s - size : n - s] for s in starts] if from_right else [part[s : s + size] for s in starts]
    if n % half:
        tiles.append(part[:size] if from_right else part[n - size :])
    return tiles


def close_in_ring(ring: Hits, rival: Hits, step: int) -> bool:
    """All tiles are in both: the ring wins if it has them side by side and the rival far apart."""
    if ring.found < 2 and rival.found < 2:
        return False
    return ring.travel <= step * ring.found and 20 * ring.travel < rival.travel


def beats_linear(part: str, ring: str, rival: str, from_right: bool) -> bool:
    """Whether a part of a read belongs to the ring rather than to the linear sequence beside it."""
    for half in HALF_TILES:
        if len(part) < 2 * half:
            continue
        tiles = tiles_of(part, half, from_right)
        mine, theirs = look(tiles, ring, from_right), look(tiles, rival, from_right)
        if not mine.missed and not theirs.missed:
            return close_in_ring(mine, theirs, half)
        if theirs.missed <= mine.missed:
            if theirs.found:
                return False
        elif mine.longest_gap <= 5 and 2 * mine.missed <= len(tiles) - 1:
            return True
    return False


def steps_of(seq: str) -> list[str]:
    return [seq[s : s + TILE] for s in range(0, len(seq) - TILE + 1, STEP)]


def tail_fits(tail: str, ring: str) -> bool:
    """Whether the rest of a read lies in the ring; too short a rest does."""
    tiles = steps_of(tail)
    if not tiles:
        return True
    hits = look(tiles, ring)
    return hits.longest_gap <= 5 and 2 * (hits.missed - 1) <= len(tiles) - 1


def mate_support(mate: str, agrees: int, ring: str, rival: str) -> int:
    """1: the mate lies in the ring; -1: it does not; -2: it lies as well, or rather, in the linear rival.

    Mates of fewer than ten bases say nothing against the ring.
    """
    tiles = steps_of(mate)
    if not tiles:
        return -2 if rival else 1
    mine, trial = look(tiles, ring), len(tiles) - 1
    if rival:
        theirs = look(tiles, rival)
        if not mine.missed and not theirs.missed:
            return 1 if close_in_ring(mine, theirs, STEP) else -2
        if theirs.missed <= mine.missed:
            return -2 if theirs.found else -1
    if 4 * mine.missed > 3 * trial and agrees == 0:
        return -2
    return -1 if mine.longest_gap > 5 or 2 * mine.missed > trial else 1


def local_alignment(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Score and length of the best local alignment; of equal ones the first in b, then in a, and matches before gaps."""
    if not a or not b:
        return 0, 0
    if a == b and match > 0:
        return match * len(a), len(a)
    x, y = (np.frombuffer(s.upper().encode(), np.uint8) for s in (a, b))
    cols, rows = len(x), len(y)
    score = np.zeros((rows + 1, cols + 1), np.int32)
    # Cells of an anti-diagonal do not depend on each other.
    for d in range(2, rows + cols + 1):
        r = np.arange(max(1, d - cols), min(rows, d - 1) + 1)
        c = d - r
        diagonal = score[r - 1, c - 1] + np.where(y[r - 1] == x[c - 1], match, mismatch)
        score[r, c] = np.maximum(np.maximum(diagonal, 0), np.maximum(score[r - 1, c], score[r, c - 1]) + gap)
    r, c = divmod(int(score.argmax()), cols + 1)
    best, length = int(score[r, c]), 0
    while score[r, c] > 0:
        length += 1
        if score[r, c] == score[r - 1, c - 1] + (match if y[r - 1] == x[c - 1] else mismatch):
            r, c = r - 1, c - 1
        elif score[r - 1, c] >= score[r, c - 1]:
            r -= 1
        else:
            c -= 1
    return best, length


def local_alignments(pairs: list[tuple[str, str]], match: int = 1, mismatch: int = -1, gap: int = -1, most_cells: int = 1 << 22) -> list[tuple[int, int]]:
    """local_alignment of many pairs, those of one size side by side: each cell of the table is one step for all of them.

    A cell holds score, way and length in one number, so that the larger number is the better score and, of equal ones, the way
    that comes first: a match, then a gap in a, then one in b. The way is cleared when the cell is left.
    """
    sizes: dict[tuple[int, int], list[int]] = {}
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    coded = [(a.upper().encode(), b.upper().encode()) for a, b in pairs]
    if match <= 0 or mismatch > 0 or gap >= 0:
        return [local_alignment(a, b, match, mismatch, gap) for a, b in pairs]
    for i, (a, b) in enumerate(coded):
        if a and b:
            sizes.setdefault((len(a), len(b)), []).append(i)
    for (cols, rows), places in sizes.items():
        step = max(1, most_cells // (cols * 8))
        for at in range(0, len(places), step):
            mine = places[at : at + step]
            x, y = (np.frombuffer(b"".join(coded[i][k] for i in mine), np.uint8).reshape(len(mine), -1).T.copy() for k in (0, 1))
            for i, found in zip(mine, _side_by_side(x, y, match, mismatch, gap), strict=True):
                out[i] = found
    return out


def _side_by_side(x: np.ndarray, y: np.ndarray, match: int, mismatch: int, gap: int) -> list[tuple[int, int]]:
    """Score and length of each column's alignment; x, y: a place of the strings in each row."""
    (cols, n), rows = x.shape, len(y)
    low = (cols + rows).bit_length()
    most = max(match * min(cols, rows), match - mismatch, -gap) + 1
    kind = np.int16 if most << (low + 2) < 1 << 15 else np.int64
    one, way = 1 << (low + 2), kind(~(3 << low))
    hit, miss = kind(match * one + (2 << low) + 1), kind(mismatch * one + (2 << low) + 1)
    up_gap, left_gap = kind(gap * one + (1 << low) + 1), kind(gap * one + 1)
    gain = kind(hit - miss)
    above = np.zeros((cols + 1, n), kind)
    here = np.zeros((cols + 1, n), kind)
    best, size = np.zeros(n, kind), np.zeros(n, kind)
    t, cell = np.empty(n, kind), np.empty(n, kind)
    least = kind(one)
    for r in range(rows):
        for c in range(1, cols + 1):
            np.multiply(x[c - 1] == y[r], gain, out=cell)
            cell += above[c - 1]
            cell += miss
            np.maximum(cell, np.add(above[c], up_gap, out=t), out=cell)
            np.maximum(cell, np.add(here[c - 1], left_gap, out=t), out=cell)
            np.multiply(cell & way, cell >= least, out=here[c])  # no score: nothing is aligned
        # Of equal scores the first in b, then in a.
        score = here[1:] >> (low + 2)
        first = score.argmax(0)
        top = score[first, np.arange(n)]
        better = top > best
        best[better] = top[better]
        size[better] = (here[1:][first, np.arange(n)] & kind((1 << low) - 1))[better]
        above, here = here, above
    return list(zip(best.tolist(), size.tolist(), strict=True))


def judge_pair(region: Region, pair: dict, signals: list[dict], linear_range: int) -> tuple | None:
    """(tag, site1, site2, strand, left signal, right signal) of a candidate pair that holds; None if it does not.

    pair: site1, site2, adj1, adj2, right, left, tail, mate, reverse, agrees, q1, q2. signals: offset, strand, left, right.
    """
    lead = pair["adj1"] if pair["adj2"] >= 0 else -pair["adj2"]
    right_good, left_good = pair["q1"] == 1, pair["q2"] == 1  # once good, a side stays good
    for s in sorted(signals, key=lambda s: s["offset"]):
        move = s["offset"] - 1 - lead
        site1, site2 = pair["site1"] + move, pair["site2"] + move
        whole, cut = pair["left"] + pair["right"], len(pair["left"]) + move
        if not 0 <= cut <= len(whole):
            continue
        right, left = canonical(s["left"] + whole[cut:]), canonical(whole[:cut] + s["right"])
        ring = canonical(region.ring(site1, site2))
        if min(len(right), len(left)) < ANCHOR or not (ring.startswith(right[:ANCHOR]) and ring.endswith(left[-ANCHOR:])):
            continue
        right_good = right_good or beats_linear(right, ring, canonical(region.after(site1, site2, linear_range)), False)
        left_good = left_good or beats_linear(left, ring, canonical(region.before(site1, site2, linear_range)), False)
        if not (right_good and left_good):
            continue
        if pair["tail"] != "*" and not tail_fits(canonical(pair["tail"]), ring):
            return None
        tag, mate = 1, canonical(pair["mate"] or "")
        if len(mate) > 5:
            if pair["reverse"]:
                # The constant stands where the junction's width would be expected, so this side hardly ever widens.
                rival = region.before(site1, site2, linear_range) if linear_range <= 5 else region.cut(site1 - 1 - linear_range, site1 - 1)
            else:
                rival = region.after(site1, site2, linear_range)
            tag = mate_support(mate, pair["agrees"], ring, canonical(rival))
        return tag, site1, site2, s["strand"], s["left"], s["right"]
    return None


def judge_rescues(items: list[tuple[Region, dict]], linear_range: int, min_mapq: int) -> list[str]:
    """judge_rescue of many (region, row), their clips aligned side by side."""
    judges = [_rescue(region, row, linear_range, min_mapq) for region, row in items]
    asked = [next(j) for j in judges]
    aligned = iter(local_alignments([x for x in asked if not isinstance(x, str)]))
    return [x if isinstance(x, str) else j.send(next(aligned)[0]) for j, x in zip(judges, asked, strict=True)]


def judge_rescue(region: Region, row: dict, linear_range: int, min_mapq: int) -> str:
    """The verdict on a clipped read at a candidate: 0 linear, 2 says nothing, else the mate's tag and how sure (2 or 3).

    row: site1, site2, left_clip, part (the clipped bases with the signal's), tail, mate, reverse, agrees, mapq.
    """
    return judge_rescues([(region, row)], linear_range, min_mapq)[0]


def _rescue(region: Region, row: dict, linear_range: int, min_mapq: int) -> Generator[str | tuple[str, str], int, None]:
    """The verdict, or first the two strings whose alignment's score it needs."""
    ring, part = canonical(region.ring(row["site1"], row["site2"])), canonical(row["part"])
    at_end = row["left_clip"]
    n = len(part)
    if not at_end:
        same_end, probe = ring[:n], lambda s, a, b: s[a:b]
    else:
        same_end, probe = ring[len(ring) - n :] if n else "", lambda s, a, b: s[len(s) - b : len(s) - a]
    if n < ANCHOR:
        yield "2" if same_end == part else "0"
        return
    if not any(probe(ring, a, b) == probe(part, a, b) for a, b in ((2, 4), (4, 7))):
        yield "0"
        return
    if len(ring) < n:
        yield "2"
        return
    score = yield same_end, part
    rival = canonical((region.before if at_end else region.after)(row["site1"], row["site2"], linear_range))
    anchored = probe(ring, 0, ANCHOR) == probe(part, 0, ANCHOR)
    sure, aligned = row["mapq"] >= min_mapq, score >= n - (n - 2) // 10 * 2
    wins = anchored and (sure or not aligned) and beats_linear(part, ring, rival, at_end)
    if not aligned and not wins:
        yield "0"
        return
    if not aligned and not sure:
        yield "2"
        return
    judge = "2" if wins and sure else "3"
    if row["tail"] not in ("*", "") and not tail_fits(canonical(row["tail"]), ring):
        yield "0"
        return
    mate = canonical(row["mate"] or "")
    tag = mate_support(mate, row["agrees"], ring, rival if row["reverse"] == at_end else "") if len(mate) > 5 else 1
    yield f"{tag}{judge}"


def strong_side(pos: int, cigar: str, side: int, anchor: int, slack: int = 6) -> bool:
    """Whether an alignment goes over a site with an anchor on both sides: inside a matched block, or at a skipped stretch (N)."""
    at, before, skipped = pos, None, False
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            block = (at, at + n - 1)
            if block[0] + anchor - 1 <= side <= block[1] - anchor + 1:
                return True
            if skipped and before and min(before[1] - before[0], block[1] - block[0]) + 1 >= anchor and before[1] + 1 - slack <= side <= block[0] - 1 + slack and min(abs(side - before[1]), abs(block[0] - side)) <= slack:
                return True
            before, skipped = block, False
        else:
            skipped = op == "N" and before is not None
        if op in "M=XDN":
            at += n
    return False


def difference_string(query: str, reference: str, cigar: str) -> str:
    """Short difference string of an alignment, its clips left out: :n equal, *rq changed, +ins, -del, ~ddNaa skipped."""
    out, q, r, equal = [], 0, 0, 0

    def flush() -> None:
        nonlocal equal
        if equal:
            out.append(f":{equal}")
        equal = 0

    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for a, b in zip(query[q : q + n].upper(), reference[r : r + n].upper(), strict=False):
                if a == b:
                    equal += 1
                else:
                    flush()
                    out.append(f"*{b.lower()}{a.lower()}")
            q, r = q + n, r + n
            continue
        if op == "S":
            q += n
        if op in "IDN":
            flush()
            skipped = reference[r : r + n].lower()
            out.append({"I": f"+{query[q : q + n].lower()}", "D": f"-{skipped}", "N": f"~{skipped[:2]}{n}{skipped[-2:]}"}[op])
            q, r = q + n * (op == "I"), r + n * (op != "I")
    flush()
    return "".join(out)


_ALIGNED, _LITERAL = 2, 1


def _difference_columns(cigar: str, query: int, reference: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]], list[tuple[int, int, int, int]], list[tuple[int, bytes]]]:
    """The columns of an alignment of sequences of these lengths: what each is (aligned, a letter as it stands, or nothing, as the last
    one is); the stretches (from, to, from, to) of columns that the query and that the reference give; and what marks stand where."""
    what: list[np.ndarray] = []
    mine, theirs, marks = [], [], []
    q = r = at = 0

    def add(kind: int, n: int, from_query: int | None = None, from_reference: int | None = None) -> None:
        nonlocal at
        for given, start in ((mine, from_query), (theirs, from_reference)):
            if start is not None and n:
                given.append((at, at + n, start, start + n))
        what.append(np.full(n, kind, np.uint8))
        at += n

    def mark(text: str) -> None:
        marks.append((at, text.encode()))
        add(_LITERAL, len(text))

    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        left, under = max(0, min(n, query - q)), max(0, min(n, reference - r))
        if op in "M=X":
            add(_ALIGNED, min(left, under), q, r)
        elif op == "I":
            mark("+")
            add(_LITERAL, left, q)
        elif op == "D":
            mark("-")
            add(_LITERAL, under, None, r)
        elif op == "N":
            mark("~")
            add(_LITERAL, min(2, under), None, r)
            mark(str(n))
            add(_LITERAL, min(2, under), None, r + max(0, under - 2))
        q, r = q + n * (op in "M=XIS"), r + n * (op in "M=XDN")
    add(0, 1)
    return np.concatenate(what), mine, theirs, marks


def difference_strings(queries: list[str | None], references: list[str | None], cigars: list[str | None], most_columns: int = 1 << 15) -> list[str | None]:
    """difference_string of many alignments; null where one of the three is. Those of one CIGAR and size are laid out together, and up
    to most_columns columns are looked at side by side, so that memory is a few times what was given."""
    out: list[str | None] = [None] * len(cigars)
    alike: dict[tuple[str, int, int], list[int]] = {}
    size = lambda s: -1 if s is None else len(s)
    for i, key in enumerate(zip(cigars, map(size, queries), map(size, references), strict=True)):
        alike.setdefault(key, []).append(i)
    layouts = []
    for (cigar, a, b), places in alike.items():
        if cigar is None or min(a, b) < 0:
            continue
        texts = ["".join([s[i] for i in places]) for s in (queries, references)]
        if not all(map(str.isascii, texts)):
            for i in places:
                out[i] = difference_string(queries[i], references[i], cigar)  # upper and lower case may differ in length
            continue
        letters = [np.frombuffer(t.lower().encode(), np.uint8).reshape(len(places), -1) for t in texts]
        layouts.append((_difference_columns(cigar, a, b), places, letters))
    layouts.sort(key=lambda x: -len(x[0][0]))
    blocks: list[tuple] = []
    free = width = 0
    for columns, places, letters in layouts:
        done, n = 0, len(columns[0])
        while done < len(places):
            # Half as wide or more: what is padded is never more than what is not.
            if not free or 2 * n < width:
                _fill(out, blocks, width)
                blocks, width, free = [], n, max(1, most_columns // n)
            to = min(len(places), done + free)
            blocks.append((columns, places[done:to], [x[done:to] for x in letters]))
            done, free = to, free - (to - done)
    _fill(out, blocks, width)
    return out


def _fill(out: list[str | None], blocks: list[tuple], width: int) -> None:
    """The difference strings of blocks of (columns, places in out, letters of queries and references)."""
    if not blocks:
        return
    chosen = [i for _, places, _ in blocks for i in places]
    what, mine, theirs = (np.zeros((len(chosen), width), np.uint8) for _ in range(3))
    at = 0
    for (kinds, from_query, from_reference, marks), places, letters in blocks:
        to = at + len(places)
        what[at:to, : len(kinds)] = kinds
        for table, stretches, given in ((mine, from_query, letters[0]), (theirs, from_reference, letters[1])):
            for a, b, c, d in stretches:
                table[at:to, a:b] = given[:, c:d]
        for a, text in marks:
            theirs[at:to, a : a + len(text)] = np.frombuffer(text, np.uint8)
        at = to
    for i, text in zip(chosen, _differences(what, mine, theirs), strict=True):
        out[i] = text


def _differences(what: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> list[str]:
    """The difference string of each row. A letter that stands for itself is in mine or in theirs; the other one is zero.

    Each column has three places; a run of equal columns is written to the places of the run, which are more than it needs.
    """
    aligned = what == _ALIGNED
    equal = aligned & (mine == theirs)
    changed = aligned & ~equal
    cells = np.empty((*what.shape, 3), np.uint8)
    cells[..., 0] = np.where(aligned, np.uint8(ord("*")), mine | theirs)
    cells[..., 1], cells[..., 2] = theirs, mine
    used = np.empty(cells.shape, bool)
    used[..., 0] = changed | (what == _LITERAL)
    used[..., 1] = used[..., 2] = changed
    # Each row ends in a column of nothing, so no run goes on into the next row.
    inside = equal.ravel()
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    begin, left = 3 * edges[::2], edges[1::2] - edges[::2]
    digits = np.ones(len(begin), np.int64)
    for power in range(1, len(str(int(left.max(initial=0))))):
        digits += left >= 10**power
    letters, written = cells.reshape(-1), used.reshape(-1)
    letters[begin], written[begin] = ord(":"), True
    where = begin + digits
    while len(where):
        letters[where], written[where] = ord("0") + left % 10, True
        more = left >= 10
        where, left = where[more] - 1, left[more] // 10
    text = letters[written].tobytes().decode()
    ends = np.cumsum(np.count_nonzero(used.reshape(len(what), -1), axis=1)).tolist()
    return [text[a:b] for a, b in pairwise([0, *ends])]


def parse_difference(text: str) -> list[tuple[str, int, str]] | None:
    """(operation, length, bases) of a difference string; None if it is none. < is a back-splice, written as ~ is."""
    found = list(re.finditer(r":(\d+)|\*([a-zA-Z])([a-zA-Z])|([+-])([a-zA-Z]+)|([~<])([a-zA-Z]{2})(\d+)([a-zA-Z]{2})", text))
    if sum(len(m[0]) for m in found) != len(text):
        return None
    return [(":", int(m[1]), "") if m[1] else ("*", 1, m[3]) if m[2] else (m[4], len(m[5]), m[5]) if m[4] else (m[6], int(m[8]), m[7] + m[9]) for m in found]


def difference_cigar(text: str) -> str | None:
    """The CIGAR of a difference string without back-splices, equal neighbours merged; None if there is none."""
    parts = parse_difference(text)
    if not parts or any(op == "<" for op, _, _ in parts):
        return None
    out: list[list] = []
    for op, n, _ in parts:
        kind = {":": "M", "*": "M", "+": "I", "-": "D", "~": "N"}[op]
        if out and out[-1][1] == kind:
            out[-1][0] += n
        else:
            out.append([n, kind])
    return "".join(f"{n}{k}" for n, k in out)


def rebuilt_bases(text: str, reference: str) -> str | None:
    """The read's bases from its difference string and the reference under it; None where they do not fit."""
    parts = parse_difference(text)
    if parts is None:
        return None
    out, r = [], 0
    for op, n, bases in parts:
        if op == "+":
            out.append(bases.upper())
            continue
        if op in ":*":
            out.append(reference[r : r + n] if op == ":" else bases.upper())
        r += n if op != "<" else 0
    return "".join(out) if r <= len(reference) else None


def clip_places(clip: str, ring: str, least: int = 10, most: int = 4) -> list[tuple[int, int, int]]:
    """(place in the ring, offset in the clip, length) of a clip: whole, else its longest beginning or end of least bases or more;
    those nearest the ring's ends first, at most ``most``."""

    def every(piece: str) -> list[int]:
        out, at = [], ring.find(piece)
        while at >= 0:
            out.append(at)
            at = ring.find(piece, at + 1)
        return out

    found: list[tuple[int, int, int]] = []
    for n in range(len(clip), least - 1, -1):
        for offset in {0, len(clip) - n}:
            found += [(p, offset, n) for p in every(clip[offset : offset + n])]
        if found:
            break
    return sorted(found, key=lambda f: (min(f[0], len(ring) - f[0] - f[2]), f[0], f[1]))[:most]


def junction_signals(region: Region, pair: dict, signals: tuple, exon_offsets: list[dict]) -> list[dict]:
    """The offsets of a pair at which a splice signal stands on both sides, and those that annotated exons give beside them."""
    lead = pair["adj1"] if pair["adj2"] >= 0 else -pair["adj2"]
    follow = pair["adj2"] if pair["adj2"] >= 0 else -pair["adj1"]
    s1, s2 = pair["site1"], pair["site2"]
    left = region.padded(s1 - lead - 4, s1 + follow).upper()
    right = region.cut(s2 - lead - 1, s2 + follow + 3).upper()
    out: dict[int, dict] = {}
    for a, b, strand in signals:
        for i in range(min(len(left), len(right)) - 1):
            if left[i : i + 2] == a and right[i : i + 2] == b:
                out[i] = {"offset": i, "strand": strand, "left": a, "right": b}
    for e in exon_offsets:
        i = e["offset"]
        out.setdefault(i, {"offset": i, "strand": e["strand"], "left": region.cut(s1 - lead + i - 4, s1 - lead + i - 2).upper(), "right": region.cut(s2 - lead - 1 + i, s2 - lead + 1 + i).upper()})
    return list(out.values())
