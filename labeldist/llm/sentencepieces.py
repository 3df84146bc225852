"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has an edge for every vocabulary piece at every place; a path
through it is a segmentation, and its probability is proportional to the
product of its pieces' weights.  Pieces never cross the start of a word, so
sums over paths are taken once for each distinct word.

The first sample of a text is an exact draw, the root's perturbed maximum.
Without that path the space falls into one part per step: the same pieces up
to there, then another.  Each part's perturbed maximum is a Gumbel variable
around the part's log mass, cut at the value of the part it came from; the
best part of all is searched next (A*), which yields the next sample.  The
bound of the best part that is left after k samples is the (k+1)-th largest
value, from which each sample's inclusion score follows.

All random numbers are hashes of the row's key, the sample's number and the
place in the text: a text has the same samples in any batch, task or run.

Weights: a piece of rank r in the vocabulary (its order of merging) weighs
``(r + 1) ** -theta``; characters without a piece are spelt in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeldist.llm.common import column_or_null, lists, slices, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 200_000
HEAD_CHARS = 50_000     # a longer text is cut at starts of words
NO_MASS = -746.0        # exp of this is 0 in doubles
SPACE, LITERAL = 0x2581, 0x110000   # the mark of a space; the same character when it stands in a text
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def spread(h: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def uniform(key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend only on the arguments."""
    with np.errstate(over="ignore"):
        h = spread(key + np.uint64(stream + 1) * M1)
        h = spread(h + place.astype(np.uint64) * M1)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


class Hashes:
    """Hashes of stretches of a character array in constant time each."""

    base = int(M1) | 1
    powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        if len(self.powers[0]) < n:
            Hashes.powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
                                  for x in (self.base, pow(self.base, -1, 2**64)))
        self.back = self.powers[1][:n]
        terms = spread(codes.astype(np.uint64) + np.uint64(1)) * self.powers[0][:n - 1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        size = np.asarray(length).astype(np.uint64)
        return spread((self.sums[start + length] - self.sums[start]) * self.back[start] + size * M1)


class Vocabulary:
    """Pieces of a SentencePiece model: hashes, log weights, and the bytes that an id stands for."""

    def __init__(self, path: str = MODEL, theta: float = 0.5):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes_id = np.zeros(256, np.int32)
        self.spelling: list[bytes] = []
        ids, texts = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:-1], 16)] = i
                self.spelling.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.spelling.append(b"")
            else:
                self.spelling.append(piece.replace("▁", " ").encode())
                ids.append(i)
                texts.append(piece)
        if any("▁" in t.lstrip("▁") for t in texts):
            raise ValueError("a piece crosses the start of a word")
        # all beginnings of pieces: the id of the piece, or -1 where only longer pieces begin so
        begun = dict.fromkeys((t[:j] for t in texts for j in range(1, len(t))), -1) | dict(zip(texts, ids, strict=True))
        length = np.array([len(t) for t in begun])
        self.longest = int(length.max())
        codes = np.frombuffer("".join(begun).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        h = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.longest):
                more = np.flatnonzero(length > j)
                h[more] = self.longer(h[more], codes[start[more] + j])
        sort = np.argsort(h)
        self.hashes, self.ids = h[sort], np.fromiter(begun.values(), np.int32)[sort]
        bucket = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.bucket = np.full(1 << 20, -1, np.int32)   # the first hash with these leading bits
        self.bucket[bucket[::-1]] = np.arange(len(bucket))[::-1]
        self.weight = np.full(n, -np.inf)
        self.weight[np.array(ids)] = -theta * np.log(np.arange(len(ids)) + 2.0)
        self.byte_weight = -theta * np.log(len(ids) + 2.0)
        self.known = np.zeros(LITERAL + 1, bool)
        self.known[[ord(t) for t in texts if len(t) == 1]] = True
        self.n = n

    @staticmethod
    def longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The hash of a stretch of characters from that of its beginning and its last character."""
        h = (h ^ (code + np.uint64(1))) * M1
        h ^= h >> np.uint64(32)
        h *= M2
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes among the known beginnings (-1: none)."""
        place = self.bucket[h >> np.uint64(44)]
        open_ = np.flatnonzero(place >= 0)
        while len(open_):
            open_ = open_[self.hashes[place[open_]] != h[open_]]
            place[open_] += 1   # hashes with the same leading bits are neighbours
            end = place[open_] >= len(self.hashes)
            over = end | ((self.hashes[np.where(end, 0, place[open_])] ^ h[open_]) >> np.uint64(44) > 0)
            place[open_[over]] = -1
            open_ = open_[~over]
        return place


class Lattice:
    """The lattices of the distinct words of some texts: a slot per character and one for each word's end,
    and the edges of each slot next to each other, longest first."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, vocab: Vocabulary):
        slots = length + 1
        self.slot_of_word = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.int64)
        total = int(slots.sum())
        slot = np.arange(total)
        self.to_end = to_end = np.repeat(self.slot_of_word + length, slots) - slot   # 0: the end
        source = np.minimum(np.repeat(start - self.slot_of_word, slots) + slot, max(len(codes) - 1, 0))
        found = []
        code = codes[source].view(np.uint64) if total else np.zeros(0, np.uint64)   # by slot
        at = inner = np.flatnonzero(to_end > 0)
        h = np.zeros(len(at), np.uint64)
        for k in range(1, vocab.longest + 1):   # go on only where some piece begins so
            h = vocab.longer(h, code[at + (k - 1)])
            place = vocab.find(h)
            some = np.flatnonzero(place >= 0)
            at, h, piece = at[some], h[some], vocab.ids[place[some]]
            some = np.flatnonzero(piece >= 0)
            found.append((at[some], k, piece[some]))
            some = np.flatnonzero(to_end[at] > k)
            at, h = at[some], h[some]
        found.reverse()
        # a character that has no piece of its own is one edge, spelt in bytes
        odd = inner[~vocab.known[code[inner]]]
        strange, number = np.unique(code[odd].view(np.int64), return_inverse=True)
        found.append((odd, 1, vocab.n + number))
        spelt = [(chr(SPACE) if c == LITERAL else chr(c)).encode() for c in strange]
        weight = np.concatenate([vocab.weight, [len(b) * vocab.byte_weight for b in spelt]])
        self.spelt = [vocab.bytes_id[list(b)] for b in spelt]
        self.ways = np.bincount(np.concatenate([at for at, _, _ in found]), minlength=total)
        # edges in order of their slot's distance from the end, so that sums over ways run backwards
        deepest = int(to_end.max()) if total else 0
        order = np.argsort(to_end.astype(np.uint16) if deepest < 2**16 else to_end, kind="stable")
        self.edge = np.zeros(total, np.int64)
        self.edge[order] = np.concatenate([[0], np.cumsum(self.ways[order])[:-1]]) if total else 0
        n = int(self.ways.sum())
        self.piece, self.k, target = np.empty(n, np.int32), np.empty(n, np.int8), np.empty(n, np.int64)
        free = self.edge.copy()
        for at, k, piece in found:
            e = free[at]
            self.piece[e], self.k[e], target[e] = piece, k, at + k
            free[at] += 1
        # log mass of all ways to the word's end, each edge's log share and the running share of a slot's edges
        w, self.mass = weight[self.piece], np.zeros(total)
        self.log_q, self.upto = np.empty(n), np.empty(n)
        bound = np.searchsorted(to_end[order], np.arange(1, deepest + 2))
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            at = order[a:b]
            many, first = self.ways[at], self.edge[at]
            e = slice(first[0], first[-1] + many[-1])
            first = first - first[0]
            v = w[e] + self.mass[target[e]]
            top = np.maximum.reduceat(v, first)
            share = np.exp(v - np.repeat(top, many))
            whole = np.add.reduceat(share, first)
            self.mass[at] = top + np.log(whole)
            self.log_q[e] = v - np.repeat(self.mass[at], many)
            run = np.cumsum(share)
            run -= np.repeat(run[first] - share[first], many)
            run /= np.repeat(whole, many)
            run[first + many - 1] = 2   # the last edge takes what rounding leaves
            self.upto[e] = run

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge taken from each slot."""
        e = self.edge[at]
        wait = np.flatnonzero(self.upto[e] <= u)
        while len(wait):
            e[wait] += 1
            wait = wait[self.upto[e[wait]] <= u[wait]]
        return e


def _units(codes: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of words: spaces and what follows, broken at line ends."""
    begin = np.zeros(len(codes), bool)
    space, line = codes == SPACE, codes == 10
    begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begin[doc_start[doc_start < len(codes)]] = True
    start = np.flatnonzero(begin)
    return start, np.diff(np.append(start, len(codes)))


class Paths:
    """Steps (edges taken from a slot) of one sample of several texts, in order of text and place."""

    def __init__(self, doc, place, at, edge):
        self.doc, self.place, self.at, self.edge = doc, place, at, edge

    @staticmethod
    def joined(parts: list[Paths]) -> Paths:
        cols = [np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "place", "at", "edge")]
        order = np.argsort(cols[1], kind="stable")  # places rise from text to text
        return Paths(*[c[order] for c in cols])

    def where(self, rows: np.ndarray) -> Paths:
        return Paths(self.doc[rows], self.place[rows], self.at[rows], self.edge[rows])


def _walk(lat: Lattice, key: np.ndarray, origin: np.ndarray, stream: int, doc, place, at) -> Paths:
    """Draw from each slot on to its word's end."""
    parts = [Paths(*[np.zeros(0, np.int64)] * 4)]
    while True:
        go = np.flatnonzero(lat.to_end[at] > 0)
        if not len(go):
            return Paths.joined(parts)
        doc, place, at = doc[go], place[go], at[go]
        edge = lat.choose(at, uniform(key[doc], stream, place - origin[doc]))
        parts.append(Paths(doc, place, at, edge))
        k = lat.k[edge]
        place, at = place + k, at + k


class Space:
    """What one sample leaves of the space it was found in: a part for each of its steps, the same way up to
    there and another edge.  ``bound`` is the largest perturbed value in it.

    ``branch_place``: where each text's sample left the sample before it (-1: nowhere); ``branch_gone``: the
    edges of that step that were taken before, as (text, edge) pairs."""

    def __init__(self, lat: Lattice, path: Paths, value: np.ndarray, noise: np.ndarray, branch_place, branch_gone):
        n = len(value)
        self.lat, self.path, self.branch_place, self.branch_gone = lat, path, branch_place, branch_gone
        rows = np.flatnonzero(path.place >= branch_place[path.doc])
        q = lat.log_q[path.edge]
        upto = np.cumsum(q)
        before = upto - q
        head = np.flatnonzero(np.diff(path.doc, prepend=-1))
        begin, end, entry = np.zeros(n), np.zeros(n), np.zeros(n)
        begin[path.doc[head]] = before[head]
        last = np.flatnonzero(np.diff(path.doc, append=-1))
        end[path.doc[last]] = upto[last]
        first = rows[np.flatnonzero(np.diff(path.doc[rows], prepend=-1))]
        entry[path.doc[first]] = before[first]
        self.scale = entry - begin           # log probability of the way up to the first of the parts
        self.rest = end - entry              # and of the way from there to the end
        rows = rows[before[rows] - entry[path.doc[rows]] > NO_MASS]     # the parts behind have no mass in doubles
        self.rows, self.doc, self.place = rows, path.doc[rows], path.place[rows]
        self.first = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.texts = self.doc[self.first]
        others = -np.expm1(np.minimum(q[rows], 0.0))
        others[lat.ways[path.at[rows]] < 2] = 0.0
        again = self.first[branch_place[self.texts] >= 0]
        self.gone = branch_gone + [(self.doc[again], path.edge[rows[again]])]
        share, text = self.other_edges(again)
        others[again] = np.bincount(text, weights=share[1], minlength=len(again)) if len(again) else 0.0
        self.share = np.exp(before[rows] - entry[self.doc]) * others
        self.bound = np.full(n, -np.inf)
        self.cut(value, noise)

    def cut(self, value: np.ndarray, noise: np.ndarray) -> None:
        """Draw the largest value of what is left, given that it lies below ``value``."""
        self.bound[:] = -np.inf
        if not len(self.texts):
            return
        with np.errstate(divide="ignore"):
            mass = np.log(np.add.reduceat(self.share, self.first)) + self.scale[self.texts]
            self.bound[self.texts] = np.where(np.isneginf(mass), -np.inf, -np.logaddexp(
                -value[self.texts], np.log(-np.log(noise[self.texts])) - mass))

    def other_edges(self, parts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Edges (and their shares) that the parts may take, and the number of the part each belongs to."""
        at, lat = self.path.at[self.rows[parts]], self.lat
        many = lat.ways[at]
        text = np.repeat(np.arange(len(parts)), many)
        edge = np.repeat(lat.edge[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        free = edge != self.path.edge[self.rows[parts]][text]
        doc = self.doc[parts]
        branch = self.branch_place[doc] == self.place[parts]
        for of, taken in self.gone[:-1]:
            last = np.full(len(self.branch_place), -1, np.int64)
            last[of] = taken
            free &= ~(branch[text] & (edge == last[doc[text]]))
        return (edge[free], np.exp(lat.log_q[edge[free]])), text[free]

    def pick(self, texts: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each text the part that holds the largest value: a draw in proportion to their masses."""
        run = np.cumsum(self.share)
        head = self.first[np.searchsorted(self.texts, texts)]
        tail = np.append(self.first, len(self.share))[np.searchsorted(self.texts, texts) + 1] - 1
        low = run[head] - self.share[head]
        part = np.clip(np.searchsorted(run, low + u * (run[tail] - low), side="right"), head, tail)
        while len(none := np.flatnonzero(self.share[part] <= 0)):   # rounding can hit a part without mass; some part has mass
            part[none] = np.where(part[none] > head[none], part[none] - 1, tail[none])
        return part


def _laid_out(texts: list[str], vocab: Vocabulary, lead: str = " "):
    """The lattice of the texts' words, each text's origin, and start, text and slot of every word.

    ``lead`` goes before every text that isn't empty."""
    size = np.array([len(t) + len(lead) * (len(t) > 0) for t in texts], np.int64)
    codes = np.frombuffer("".join(lead + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes == SPACE, LITERAL, np.where(codes == 32, SPACE, codes))
    origin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    with np.errstate(over="ignore"):
        start, length = _units(codes, origin[size > 0])
        which = pd.factorize(Hashes(codes).of(start, length))[0]
        first = np.zeros(which.max() + 1 if len(which) else 0, np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        lat = Lattice(codes, start[first], length[first], vocab)
    return lat, origin, start, np.searchsorted(origin + size, start, side="right"), lat.slot_of_word[which]


def _ids(lat: Lattice, path: Paths, vocab: Vocabulary, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a path, their number for each of ``n`` texts, and each one's log probability."""
    piece = lat.piece[path.edge]
    log_prob = np.bincount(path.doc, weights=lat.log_q[path.edge], minlength=n).astype(float)
    odd = np.flatnonzero(piece >= vocab.n)
    if not len(odd):
        return piece, np.bincount(path.doc, minlength=n), log_prob
    times = np.ones(len(piece), np.int64)
    times[odd] = np.array([len(x) for x in lat.spelt], np.int64)[piece[odd] - vocab.n]
    ids = np.repeat(piece, times)
    ids[np.repeat(piece >= vocab.n, times)] = np.concatenate([lat.spelt[x] for x in piece[odd] - vocab.n])
    return ids, np.bincount(path.doc, weights=times, minlength=n).astype(np.int64), log_prob


def log_inclusion(log_prob: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Log of the chance that a value of this log probability lies above ``best``."""
    with np.errstate(over="ignore", divide="ignore"):
        chance = np.minimum(log_prob - best, 30.0)
        return np.where(chance < -30, chance, np.log(-np.expm1(-np.exp(chance))))


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, k: int) -> Iterator[tuple]:
    """The samples of rank 1, 2 .. k of all texts that have so many.

    Yields ``(text numbers, rank, all ids, ids of each text, log_prob, perturbed, best, rest)``: ``best`` is the largest
    value among what is left after k samples, ``rest`` the largest log probability of a way from a sample's first part to
    the end (if that is below ``NO_MASS``, what could follow the text changes neither samples nor values)."""
    n = len(texts)
    lat, origin, start, unit_doc, unit_slot = _laid_out(texts, vocab)
    at_text = np.zeros(n, np.int64)

    live = np.arange(n)
    path = _walk(lat, keys, origin, 0, unit_doc, start, unit_slot)
    worth = -np.log(-np.log(uniform(keys, 1000, at_text)))
    branch_place, gone = np.full(n, -1, np.int64), []
    found: list[tuple] = []
    spaces: list[Space] = []
    for rank in range(k):
        found.append((live, path, worth[live]))
        spaces.append(Space(lat, path, worth, uniform(keys, 2000 + rank, at_text), branch_place, gone))
        bounds = np.array([s.bound for s in spaces])
        best, source = bounds.max(axis=0), bounds.argmax(axis=0)
        live = np.flatnonzero(best > -np.inf)
        if rank == k - 1 or not len(live):
            break
        branch_place, gone, steps = np.full(n, -1, np.int64), [], []
        for j, space in enumerate(spaces):
            of = live[source[live] == j]
            if not len(of):
                continue
            part = space.pick(of, uniform(keys[of], 3000 + rank, at_text[of]))
            place, at = space.place[part], space.path.at[space.rows[part]]
            branch_place[of] = place
            # the same steps up to the part's place, another edge there, then fresh draws
            steps.append(space.path.where(np.flatnonzero(space.path.place < np.where(source == j, branch_place, -1)[space.path.doc])))
            (edges, share), text = space.other_edges(part)
            run = np.cumsum(share)
            head = np.flatnonzero(np.diff(text, prepend=-1))
            tail = np.append(head[1:], len(text)) - 1
            low = run[head] - share[head]
            edge = edges[np.clip(np.searchsorted(run, low + uniform(keys[of], 4000 + rank, at_text[of]) * (run[tail] - low),
                                                 side="right"), head, tail)]
            steps.append(Paths(of, place, at, edge))
            last = np.full(n, np.iinfo(np.int64).max)
            last[of] = place
            later = np.flatnonzero(start > last[unit_doc])
            length_taken = lat.k[edge]
            steps.append(_walk(lat, keys, origin, 1 + rank, np.concatenate([of, unit_doc[later]]),
                               np.concatenate([place + length_taken, start[later]]),
                               np.concatenate([at + length_taken, unit_slot[later]])))
            # edges that the new sample's first part must not take: the old sample's, and those gone before
            old = space.path.edge[space.rows[part]]
            gone.append((of, old))
            again = np.flatnonzero(space.branch_place[of] == place)
            for texts_before, taken in space.gone[:-1]:
                keep = np.isin(texts_before, of[again])
                gone.append((texts_before[keep], taken[keep]))
            space.share[part] = 0.0   # searched now; what is left of it belongs to the new sample
            cut = np.full(n, np.nan)
            cut[of] = best[of]
            old_bound = space.bound.copy()
            space.cut(np.where(np.isnan(cut), old_bound, cut), uniform(keys, 5000 + rank, at_text))
            rest = np.ones(n, bool)
            rest[of] = False
            space.bound[rest] = old_bound[rest]
        path, worth = Paths.joined(steps), best

    rest = np.max([x.rest for x in spaces], axis=0)
    for rank, (of, path, value) in enumerate(found, 1):
        ids, count, log_prob = _ids(lat, path, vocab, n)
        yield of, rank, ids, count[of], log_prob[of], value, best[of], rest[of]


def _cuts(text: str, step: int) -> list[int]:
    """Starts of stretches of about ``step`` characters; each but the first starts a word."""
    out = [0]
    while found := _WORD_START.search(text, out[-1] + step):
        out.append(found.start())
    return out


_WORD_START = re.compile(r"(?<! ) |\n")


def sample_long(text: str, key: np.ndarray, vocab: Vocabulary, k: int) -> Iterator[tuple]:
    """The same for one text of any length, in stretches: yields ``(rank, ids, log_prob, perturbed, best)``.

    All samples leave each other within the first stretches (else more are taken), behind which the sample of rank r
    goes on with the draws that belong to it.  One stretch is laid out at a time."""
    cuts, upto = [*_cuts(text, HEAD_CHARS), len(text)], 1
    while True:
        head = list(sample([text[:cuts[upto]]], key, vocab, k))
        if upto == len(cuts) - 1 or all(h[7][0] < NO_MASS for h in head):
            break
        upto = min(2 * upto, len(cuts) - 1)
    for _, rank, ids, _, log_prob, value, best, _ in head:
        parts, total = [ids.astype(np.int32)], log_prob[0]
        for a, b in zip(cuts[upto:-1], cuts[upto + 1:], strict=True):
            lat, _, start, unit_doc, unit_slot = _laid_out([text[a:b]], vocab, lead="")
            path = _walk(lat, key, np.array([-1 - a]), rank - 1, unit_doc, start, unit_slot)
            ids, _, log_prob = _ids(lat, path, vocab, 1)
            parts.append(ids.astype(np.int32))
            total += log_prob[0]
        yield rank, np.concatenate(parts), total, value[0], best[0]


class Spelling:
    """The bytes that ids stand for, to be strung together for whole arrays of ids."""

    def __init__(self, vocab: Vocabulary):
        self.size = np.array([len(x) for x in vocab.spelling])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(vocab.spelling), np.uint8)

    def texts(self, ids: np.ndarray, count: np.ndarray) -> list[memoryview]:
        """The bytes of each text (``count`` ids each), without the space before its first word."""
        size = self.size[ids]
        end = np.cumsum(size)
        flat = np.ones(int(end[-1]) if len(end) else 0, np.int32)
        some = np.flatnonzero(size)
        first = end[some] - size[some]
        flat[first] = self.start[ids[some]] - np.concatenate([[0], (self.start[ids[some]] + size[some] - 1)[:-1]])
        out = memoryview(self.bytes[np.cumsum(flat, dtype=np.int32)]) if len(flat) else memoryview(b"")
        edge = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [out[a + 1:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, key: Column, k: int = 2, theta: float = 0.5, model: str = MODEL,
           keep: list[str] | None = None) -> DataFrame:
    """One row per document and sample: ``keep`` columns (default: all) and
    ``__rank`` (1 .. k, largest perturbed value first), ``__ids`` (array), ``__n_pieces``,
    ``__log_prob``, ``__perturbed``, ``__log_inclusion`` (log of the chance that the value is
    among the k largest, given the (k+1)-th; 0 if the text has no other segmentation) and
    ``__same`` (whether decoding the ids gives the whole text again).

    ``key`` (long) seeds the random numbers: rows with the same key and text have the same
    samples.  A text with fewer than k segmentations has fewer rows.  The empty text has one,
    without pieces; a null text has one row with null ids; an empty table gives none.  Only the
    vocabulary (of fixed size) is sent to the tasks.  Texts of more than ``HEAD_CHARS`` characters
    are worked on in stretches that start with a word, so a task holds the lattice of one slice or
    stretch (or of one longer word), and the ids of one sample.
    """
    text_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, theta))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], column_or_null(docs, "text", "string").alias("__text"),
                       key.cast("long").alias("__key"))
    names = ["__rank", "__ids", "__n_pieces", "__log_prob", "__perturbed", "__log_inclusion", "__same"]
    kinds = ["int", "array<int>", "long", "double", "double", "double", "boolean"]
    schema = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(t).alias(c) for c, t in zip(
        names, kinds, strict=True)]).schema

    def table(part, spelling, texts, of, rank, ids, count, log_prob, value, best) -> pa.RecordBatch:
        at = pa.array(of)
        same = [not len(texts[i]) if not n else x == texts[i].encode() for i, x, n in
                zip(of, spelling.texts(ids, count), count, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*[part.column(c).take(at) for c in keep], pa.array(np.full(len(of), rank, np.int32)),
             lists(np.concatenate([[0], np.cumsum(count)]), ids.astype(np.int32)), pa.array(count),
             *[pa.array(v) for v in (log_prob, value, log_inclusion(log_prob, best))], pa.array(same, pa.bool_())], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shipped.value
        spelling = Spelling(vocab)
        for batch in batches:
            for part in slices(batch, "__text", BATCH_BYTES):
                text = part.column("__text")
                null = np.flatnonzero(text.is_null().to_numpy(zero_copy_only=False))
                if len(null):
                    nothing = [pa.nulls(len(null), t) for t in (
                        pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(null)) for c in keep],
                                                      pa.array(np.ones(len(null), np.int32)), *nothing], names=[*keep, *names])
                    part = part.filter(text.is_valid())
                size = pc.utf8_length(part.column("__text")).to_numpy()
                long_ = part.take(pa.array(np.flatnonzero(size > HEAD_CHARS)))
                part = part.take(pa.array(np.flatnonzero(size <= HEAD_CHARS)))
                keys = part.column("__key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                texts = part.column("__text").to_pylist()
                for of, rank, ids, count, log_prob, value, best, _ in sample(texts, keys, vocab, k):
                    yield table(part, spelling, texts, of, rank, ids, count, log_prob, value, best)
                for i in range(long_.num_rows):
                    one = long_.slice(i, 1)
                    key_ = one.column("__key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    texts = one.column("__text").to_pylist()
                    for rank, ids, *values in sample_long(texts[0], key_, vocab, k):
                        yield table(one, spelling, texts, np.zeros(1, np.int64), rank, ids, np.array([len(ids)]),
                                    *[np.array([v]) for v in values])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, theta: float = 0.5) -> DataFrame:
    """``encoded`` with ``__decoded``: the text that ``__ids`` spell (null for null ids)."""
    shipped = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model, theta))
    schema = encoded.withColumn("__decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(shipped.value)
        for batch in batches:
            ids = batch.column("__ids")
            count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            texts = [bytes(x).decode("utf-8", "replace") for x in spelling.texts(ids.flatten().to_numpy(zero_copy_only=False), count)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(
                zero_copy_only=False))], names=schema.names)

    return encoded.mapInArrow(run, schema)


def row_key(docs: DataFrame, seed: int = 10) -> Column:
    return F.xxhash64(F.lit(seed), column_or_null(docs, "doc_id", "long"))


def op10(docs: DataFrame) -> DataFrame:
    return encode(docs, row_key(docs), keep=["doc_id"]).select(
        "doc_id", F.col("__rank").alias("rank"), F.col("__ids").alias("ids"), F.col("__n_pieces").alias("n_pieces"),
        F.col("__log_prob").alias("log_prob"), F.col("__perturbed").alias("perturbed"),
        F.col("__log_inclusion").alias("log_inclusion"), F.col("__same").alias("round_trip"))
