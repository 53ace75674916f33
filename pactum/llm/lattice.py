"""SentencePiece encoding by sampling, without replacement, and decoding.

A text's segmentations into pieces of a vocabulary form a lattice; a segmentation's
probability is proportional to the product of its pieces' weights, (1 + rank) to the
power of -alpha for a piece of a BPE vocabulary. No piece crosses the begin of a
word (a run of blanks and what follows it), so the lattice is a chain of the words'
lattices, and their backward sums give each arc its conditional probability.

Gumbel top-k draws the k segmentations with the greatest perturbed log probability:
distinct ones, as if drawn one after the other without replacement. The search is
A*: the agenda holds sets of segmentations (those that leave a known path at one
point) with the exact maximum of their perturbed scores, drawn from the Gumbel
distribution cut off at the maximum of the set that they are a part of. The best set
is taken, split at its best member's arcs, and the parts join the agenda. Where it is
taken from, the path goes on by conditional probabilities, which is what the best
member of a set does. The (k+1)-th score kappa gives each sample its inclusion
probability 1 - exp(-exp(log p - kappa)).

All random numbers are hashes of (seed, row key, sample, place), so a row's samples
are the same wherever and however often it is run.

Characters without a piece are written as their UTF-8 bytes' pieces.

Defined results: null text is empty; an empty text has one segmentation, without
pieces; a text with fewer segmentations than k has them all; U+2581 reads back as a
blank; rows that repeat a key have equal samples; a null key counts as -1; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
WORD = re.compile(" *[^ ]+| +")
#: Characters that are handled at once, about, and states and arcs of words that a worker remembers.
SLICE_CHARS, STATES, ARCS = 200_000, 1_200_000, 2_500_000
#: Leading bits of a hash that address the table of begins of pieces.
SLOT_BITS = 20
#: Where an arc leaves less than this to its state's others, what it leaves is summed from them.
SCARCE = 1e-5
#: A Gumbel variable made from a uniform of 52 bits stays below this above its location (53 log 2 is 36.8).
MOST_GUMBEL = 37.0
#: Arcs at the begin of a path whose sets are scored at first; twice as many, and so on, where those may not be enough.
HEAD = 32
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, score double, inclusion double, ids binary"
_U = np.uint64


@dataclass(frozen=True)
class Sampling:
    k: int = 3
    alpha: float = 1.0
    seed: int = 1


class Vocabulary:
    """The pieces of a SentencePiece model file, by hash of their characters; one a process and file."""

    _open: dict[tuple[str, float], Vocabulary] = {}

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        used = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and BLANK not in self.pieces[i].lstrip(BLANK)]
        self.longest = max(len(self.pieces[i]) for i in used)
        rng = np.random.default_rng(97)
        self.mix = rng.integers(1, 1 << 63, dtype=np.uint64) * _U(2) + _U(1)
        ids = np.array(used, np.int32)
        rank = np.minimum(np.abs([model.get_score(i) for i in used]), self.size)
        self.lost = -alpha * np.log1p(4.0 * self.size)  # a character that becomes bytes
        self.weight_of = np.full(self.size, self.lost)
        self.weight_of[ids] = -alpha * np.log1p(rank)
        self._tabulate(used)
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelt = pa.array([*spelt, *[b.removeprefix(b" ") for b in spelt]], pa.large_binary())
        self.lattices = Lattices(self)

    @classmethod
    def of(cls, path: str, alpha: float = 1.0) -> Vocabulary:
        if (path, alpha) not in cls._open:
            cls._open[path, alpha] = cls(path, alpha)
        return cls._open[path, alpha]

    def _tabulate(self, used: list[int]) -> None:
        """hashes: of all begins of pieces, ascending; known: the piece that each is, or -1; slot: the first hash with some leading bits, or -1."""
        of: dict[int, int] = {}
        begins: set[str] = set()
        for i in used:
            h, piece = 0, self.pieces[i]
            for n, c in enumerate(piece, 1):
                h = ((h + ord(c) + 1) * int(self.mix)) & (1 << 64) - 1
                h ^= h >> 31
                begins.add(piece[:n])
                of.setdefault(h, -1)
            of[h] = i
        assert len(of) == len(begins), "two begins of pieces share a hash"
        hashes, known = np.array(list(of), np.uint64), np.array(list(of.values()), np.int32)
        order = np.argsort(hashes)
        self.hashes, self.known = hashes[order], known[order]
        lead = (self.hashes >> _U(64 - SLOT_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot[lead[first]] = first
        self.most = int(np.diff(np.append(first, len(lead))).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are begins of pieces, their places among them)."""
        place = self.slot[(h >> _U(64 - SLOT_BITS)).astype(np.int64)]
        hit = np.flatnonzero(place >= 0)
        place, h = place[hit], h[hit]
        off = np.flatnonzero(self.hashes[place] != h)
        for _ in range(self.most - 1):
            if not len(off):
                break
            place[off] = np.minimum(place[off] + 1, len(self.hashes) - 1)
            off = off[self.hashes[place[off]] != h[off]]
        if len(off):
            real = np.ones(len(hit), bool)
            real[off] = False
            hit, place = hit[real], place[real]
        return hit, place

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_rows([np.asarray(ids).astype("<u4").tobytes()])[0].as_py()

    def decode_rows(self, rows: list[bytes]) -> pa.Array:
        """The texts of rows of ids: their pieces' bytes one after the other; a row's first blank is the encoder's own."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        ids[(ends - sizes)[sizes > 0]] += self.size  # the same pieces without a blank
        bytes_ = self.spelt.take(pa.array(ids))
        offsets = np.frombuffer(bytes_.buffers()[1], np.int64, len(ids) + 1)[np.concatenate([[0], ends])]
        out = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.tobytes()), bytes_.buffers()[2])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no text; in single rows, as a sequence may end within a row
            data = bytes_.buffers()[2].to_pybytes()
            return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())
        return out.cast(pa.string())


def words_of(text: str) -> list[str]:
    """The words, in which a blank stands for the pieces' own character."""
    return [" " + w for w in bare_words(text)]


def bare_words(text: str) -> list[str]:
    """The words without their first blank, which each of them has."""
    text = text.replace(BLANK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in WORD.findall(" " + text)]
    return text.split(" ") if text else []


class Lattices:
    """The lattices of words. A word of n characters, its first blank included, has n + 1 states; those of its end have no arcs.

    start[state], count[state]: a state's arcs, longest first; a state is known by the
    first of them. first: that of each known word's first state. way[arc]: above 32 bits
    the probability that a path at the state takes this arc or one before it, in units
    of 2 to the power of -24, and in 32 bits the first arc of the state that it leads
    to, or END at the word's end; log[arc]: its log probability; others[arc]: that of
    its state's others; piece[arc]: its piece, or -1 - c for a character c that becomes
    several bytes. When the room is used up, all words are forgotten, and those in use
    are built again.
    """

    END = (1 << 32) - 1

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear(STATES, ARCS)

    def _clear(self, states: int, arcs: int) -> None:
        self.first: dict[str, int] = {}
        self.used, self.used_arcs = 0, 0
        self.start, self.count = np.zeros(states, np.int32), np.zeros(states, np.uint8)
        self.log, self.others = np.empty(arcs), np.empty(arcs)
        self.way, self.piece = np.empty(arcs, np.int64), np.empty(arcs, np.int32)

    def firsts(self, words: list[str]) -> np.ndarray:
        """The first state of each word; those that are not known are built."""
        known = lambda: np.fromiter(map(self.first.get, words, repeat(-1)), np.int64, len(words))
        found = known()
        new = list({words[i] for i in np.flatnonzero(found < 0).tolist()})
        if not new:
            return found
        if not self._build(new):
            self._clear(STATES, ARCS)
            self._build(list(set(words)), room_for_all=True)
            return known()
        lost = np.flatnonzero(found < 0)
        found[lost] = [self.first[words[i]] for i in lost.tolist()]
        return found

    def state_of(self, arc: int) -> int:
        """Starts ascend, and a state without arcs has the start of the next."""
        return int(np.searchsorted(self.start[: self.used], np.int32(arc), "right")) - 1

    def _arcs(self, points: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, the places where arcs of it begin, their pieces and weights. points: characters, and left: those to the word's end."""
        v, found = self.v, []
        at = np.flatnonzero(left)
        h = np.zeros(len(at), np.uint64)
        for n in range(v.longest):
            if n:
                stay = left[at] > n
                at, h = at[stay], h[stay]
            if not len(at):
                break
            h = (h + points[at + n].astype(np.uint64) + _U(1)) * v.mix
            h ^= h >> _U(31)
            hit, place = v.find(h)
            known = v.known[place]
            real = known >= 0
            begins, ids = at[hit[real]], known[real]
            weights = v.weight_of[ids]
            if n == 0:
                none = np.ones(len(at), bool)
                none[hit[real]] = False
                lost = points[at[none]]
                begins, ids = np.concatenate([begins, at[none]]), np.concatenate([ids, np.where(lost < 128, v.byte_ids[np.minimum(lost, 127)], -1 - lost)])
                weights = np.concatenate([weights, np.full(len(lost), v.lost)])
            found.append((begins, ids, weights))
            at, h = at[hit], h[hit]
        return found

    def _build(self, words: list[str], room_for_all: bool = False) -> bool:
        """Whether there was room. States are numbered by the characters to the word's end, so that a state's arcs lead to smaller numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        n = int(sizes.sum()) + len(words)
        begin = np.cumsum(sizes + 1) - sizes - 1
        points = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[begin + sizes] = False
        points[inside] = np.frombuffer(f" {' '.join(words)}".replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4")
        left = np.repeat(begin + sizes, sizes + 1) - np.arange(n)
        found = self._arcs(points, left)
        count = np.zeros(n, np.int64)
        for begins, _, _ in found:
            count[begins] += 1
        total = int(count.sum())
        if self.used + n > len(self.start) or self.used_arcs + total > len(self.log):
            if not room_for_all:
                return False
            self._clear(max(STATES, n), max(ARCS, total))
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        count = count[order]
        start = np.cumsum(count) - count
        arcs = slice(self.used_arcs, self.used_arcs + total)
        piece, target, weight = self.piece[arcs], np.empty(total, np.int64), np.empty(total)
        free = start.copy()
        for length in range(len(found), 0, -1):
            begins, ids, weights = found[length - 1]
            of = number[begins]
            place = free[of]
            free[of] += 1
            piece[place], target[place], weight[place] = ids, number[begins + length], weights
        after = self._sum_backward(left[order], start, count, target, weight)

        at = len(words)  # the ends of words have no arcs and come first
        log = weight + after[target] - np.repeat(after[at:], count[at:])
        p = np.exp(log)
        upto = np.cumsum(p)
        chance = upto - np.repeat(upto[start[at:]] - p[start[at:]], count[at:])
        last = start[at:] + count[at:] - 1
        chance[last] = 1.0
        alone = np.repeat(count[at:] == 1, count[at:])
        others = np.maximum(1.0 - p, 0.0)
        scarce = np.flatnonzero((others < SCARCE) & ~alone)  # one of a state's arcs at most
        if len(scarce):
            rest = p.copy()
            rest[scarce] = 0.0
            others[scarce] = np.repeat(np.add.reduceat(rest, start[at:]), count[at:])[scarce]
        others[alone] = 0.0
        log[alone] = 0.0
        with np.errstate(divide="ignore"):
            self.log[arcs], self.others[arcs] = np.minimum(log, 0.0), np.log(others)
        starts = start + self.used_arcs
        self.way[arcs] = (chance * (1 << 24)).astype(np.int64) << 32 | np.where(target < at, self.END, starts[target])
        states = slice(self.used, self.used + n)
        self.start[states], self.count[states] = starts, count
        self.first.update(zip(words, starts[number[begin]].tolist(), strict=True))
        self.used, self.used_arcs = self.used + n, self.used_arcs + total
        return True

    @staticmethod
    def _sum_backward(left: np.ndarray, start: np.ndarray, count: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The log of the weight of all paths from each state to its word's end. left ascends."""
        after = np.zeros(len(left))
        bounds = np.searchsorted(left, np.arange(1, int(left[-1]) + 2 if len(left) else 2)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            first, end = int(start[a]), int(start[b - 1] + count[b - 1])
            s = weight[first:end] + after[target[first:end]]
            cut = start[a:b] - first
            top = np.maximum.reduceat(s, cut)
            after[a:b] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, count[a:b])), cut))
        return after


def _times(r: int, odd: int) -> np.uint64:
    return _U(r * odd & (1 << 64) - 1)


STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash (splitmix64's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included."""
    return ((_mixed(x) >> _U(12)).astype(np.float64) + 0.5) / (1 << 52)


def _gumbel_below(mu, bound, u):
    """A Gumbel variable of location mu, cut off at bound, from a uniform u."""
    with np.errstate(divide="ignore", over="ignore"):
        return mu - np.log(np.exp(mu - bound) - np.log(u))


class _Walk:
    """Paths for many starts at once: for each, from its first state through the rest of its words.

    state: the first arc of the first state of each part (a word, or the rest of one, or END), step: the steps
    that its path has taken in the word before; begin: each start's first part, and the number of parts;
    salt: what the random numbers of a part are hashed from; word: each part's place in its text.
    arc: all paths' arcs, those of a start from cut[start]; total: the log probability of each start's path.
    """

    def __init__(self, lattices: Lattices, state, step, begin, salt, word):
        n = len(state)
        steps = []
        active, now, x = np.arange(n), state, salt + step.astype(np.uint64) * STEP
        going = now != lattices.END
        while True:
            if not going.all():
                active, now, x = active[going], now[going], x[going]
            if not len(active):
                break
            u = (_mixed(x) >> _U(40)).view(np.int64)
            way = lattices.way[now]
            short = np.flatnonzero(way >> 32 < u)
            if len(short):
                now = now.copy()
                while len(short):
                    now[short] += 1
                    found = lattices.way[now[short]]
                    way[short] = found
                    short = short[found >> 32 < u[short]]
            steps.append((active, now))
            now = way & lattices.END
            going = now != lattices.END
            x = x + STEP
        count = np.zeros(n, np.int64)
        for a, _ in steps:
            count[a] += 1
        self.part_begin = np.concatenate([[0], np.cumsum(count)])
        self.arc = np.empty(int(self.part_begin[-1]), np.int32)
        for j, (a, arc) in enumerate(steps):
            self.arc[self.part_begin[a] + j] = arc
        self.lattices, self.step, self.salt, self.word = lattices, step, salt, word
        self.cut = self.part_begin[begin]
        self.total = np.zeros(len(begin) - 1)
        real = np.flatnonzero(self.cut[1:] > self.cut[:-1])
        if len(real):
            self.total[real] = np.add.reduceat(lattices.log[self.arc], self.cut[real])

    def place(self, arcs: np.ndarray | int) -> tuple:
        """The parts that arcs are in, and the steps before them in their words."""
        part = np.searchsorted(self.part_begin, arcs, "right") - 1
        return part, arcs - self.part_begin[part] + self.step[part]

    def heads(self, start_log: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each start the begin of its path, as far as a set that leaves it can be among the k best: the log probability after each arc, and the score of the set that leaves at it.

        A score is less than the log probability of its set and MOST_GUMBEL. The path's
        own only falls; so where that bound is below the k-th best score, neither this
        set nor, beyond, any other is ever taken, and none is scored.
        """
        out: list = [None] * len(self.total)
        size = np.diff(self.cut)
        todo, low, high = np.arange(len(out)), 0, HEAD
        after, rest = start_log[:, None], np.empty((len(out), 0))
        while len(todo):
            high = max(min(high, int(size[todo].max())), low)
            at = np.arange(low, high)
            inside = at < size[todo, None]
            arc = self.arc[(self.cut[todo, None] + at)[inside]]
            logs, mu = np.zeros(inside.shape), np.full(inside.shape, -np.inf)
            logs[inside], mu[inside] = self.lattices.log[arc], self.lattices.others[arc]
            run = np.cumsum(np.concatenate([after[:, -1:], logs], 1), 1)
            mu += run[:, :-1]
            least = np.partition(rest, low - k, 1)[:, low - k] if low >= k else np.full(len(todo), -np.inf)
            row, column = np.nonzero((mu > -np.inf) & (mu + MOST_GUMBEL >= least[:, None]))
            part, within = self.place(self.cut[todo[row]] + low + column)
            u = _uniform((self.salt[part] + within.astype(np.uint64) * STEP) ^ _U(0xD6E8FEB86659FD93))
            new = np.full(inside.shape, -np.inf)
            new[row, column] = _gumbel_below(mu[row, column], bound[todo[row]], u)
            after, rest = np.concatenate([after, run[:, 1:]], 1), np.concatenate([rest, new], 1)
            if high >= k:
                least = np.partition(rest, high - k, 1)[:, high - k]
            done = (size[todo] <= high) | (after[:, -1] + MOST_GUMBEL < least)
            for i in np.flatnonzero(done).tolist():
                m = min(int(size[todo[i]]), high)
                out[todo[i]] = after[i, 1 : m + 1], rest[i, :m]
            more = ~done
            todo, after, rest, low, high = todo[more], after[more], rest[more], high, 2 * high
        return out


class _Path:
    """One sample: its arcs, and those of its begin at which sets of the agenda leave it.

    It was walked as one start of a walk; or up to an arc it is its parent's, by another
    arc it leaves that one there, and the rest was walked.
    """

    __slots__ = ("after", "arcs", "log", "parent", "rest", "score", "shared", "start", "taken", "walk")

    def __init__(self, walk: _Walk, start: int, head: tuple[np.ndarray, np.ndarray], log: float, score: float, parent: _Path | None = None, shared: int = -1, arc: int = -1):
        self.walk, self.start, self.parent, self.shared, self.score = walk, start, parent, shared, score
        self.arcs, self.log = walk.arc[walk.cut[start] : walk.cut[start + 1]], log + float(walk.total[start])
        self.after, self.rest = head
        if parent is not None:
            self.arcs = np.concatenate([parent.arcs[:shared], [arc], self.arcs])
            self.after = np.concatenate([parent.after[:shared], [log], self.after])
            # What leaves the shared part belongs to the path it is shared with.
            self.rest = np.concatenate([np.full(shared + 1, -np.inf), self.rest])
        self.taken: dict[int, list[int]] = {}

    def place(self, at: int) -> tuple[int, int]:
        """The word of an arc, and the steps before it in that word."""
        if at <= self.shared:
            return self.parent.place(at)
        part, within = self.walk.place(int(self.walk.cut[self.start]) + at - self.shared - 1)
        return int(self.walk.word[part]), int(within)


def sample_texts(keys: list[int], texts: list[str | None], v: Vocabulary, s: Sampling) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: (ids, log probability, perturbed score, inclusion probability)."""
    split = [bare_words(t or "") for t in texts]
    if not any(split):
        return [[(np.empty(0, np.int32), 0.0, 0.0, 1.0)] for _ in texts]
    lattices = v.lattices
    ends = np.cumsum([len(words) for words in split])
    firsts = np.split(lattices.firsts(list(chain.from_iterable(split))), ends[:-1])
    seeds = _mixed(np.array(keys, np.int64).view(np.uint64) + _times(s.seed, 0x9E3779B97F4A7C15))
    n = len(texts)

    def walk(r: int, starts: list[tuple[int, int, int, int]], logs, bounds) -> tuple[_Walk, list]:
        """starts: (document, word, state in it, steps before: 0 at the word's begin). Also the heads."""
        state, step, word, seed = [], [], [], []
        seeded = seeds + _times(r, 0xA24BAED4963EE407)
        for doc, w, at, before in starts:
            own = firsts[doc][w:]
            taken = np.zeros(len(own), np.int64)
            if before and len(own):
                own = own.copy()
                own[0], taken[0] = at, before
            state.append(own)
            step.append(taken)
            word.append(np.arange(w, w + len(own)))
            seed.append(np.full(len(own), seeded[doc]))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in state])])
        words = np.concatenate(word)
        salt = _mixed(words.astype(np.uint64) * _U(0x9FB21C651E98DF25) + np.concatenate(seed))
        out = _Walk(lattices, np.concatenate(state), np.concatenate(step), begin, salt, words)
        return out, out.heads(np.asarray(logs, float), np.asarray(bounds, float), s.k)

    roots = -np.log(-np.log(_uniform(seeds ^ _U(0x2545F4914F6CDD1D))))
    w, heads = walk(0, [(d, 0, -1, 0) for d in range(n)], np.zeros(n), roots)
    paths: list[list[_Path]] = [[_Path(w, d, heads[d], 0.0, float(roots[d]))] for d in range(n)]
    kappa = np.full(n, -np.inf)
    for r in range(1, s.k + 1):
        starts, logs, bounds, pending = [], [], [], []
        chosen_by, next_by = (_uniform(seeds + _times(r, odd)).tolist() for odd in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F))
        for d in range(n):
            best, of, at = -np.inf, None, -1
            if len(paths[d]) < r:
                continue  # all segmentations are out
            for p in paths[d]:
                rest = p.rest
                if len(rest):
                    j = int(rest.argmax())
                    if rest[j] > best:
                        best, of, at = float(rest[j]), p, j
            if of is None or best == -np.inf:
                continue
            if r == s.k:
                kappa[d] = best
                continue
            state = lattices.state_of(int(of.arcs[at]))
            first = int(lattices.start[state])
            row = np.exp(lattices.log[first : first + int(lattices.count[state])])
            gone = of.taken.setdefault(at, [int(of.arcs[at]) - first])
            row[gone] = 0.0
            upto = np.cumsum(row)
            place = int((upto < chosen_by[d] * upto[-1]).sum())
            gone.append(place)
            arc, chosen = first + place, float(lattices.log[first + place])
            row[place] = 0.0
            before = float(of.after[at - 1]) if at else 0.0
            of.rest[at] = _gumbel_below(before + np.log(row.sum()), best, next_by[d]) if row.any() else -np.inf
            word, steps = of.place(at)
            starts.append((d, word, int(lattices.way[arc]) & lattices.END, steps + 1))
            logs.append(before + chosen)
            bounds.append(best)
            pending.append((d, of, at, arc))
        if r == s.k or not starts:
            break
        w, heads = walk(r, starts, logs, bounds)
        for k, (d, of, at, arc) in enumerate(pending):
            paths[d].append(_Path(w, k, heads[k], logs[k], bounds[k], of, at, arc))
    out = []
    for d in range(n):
        rows = []
        for p in paths[d]:
            found = lattices.piece[p.arcs]
            if (found < 0).any():
                lost = np.flatnonzero(found < 0)
                spelt = [[v.byte_id[b] for b in chr(x).encode("utf-8", "surrogatepass")] for x in (-1 - found[lost]).tolist()]
                pieces = np.split(found, lost)
                found = np.concatenate([pieces[0], *[x for one, rest in zip(spelt, pieces[1:], strict=True) for x in (one, rest[1:])]])
            gap = p.log - kappa[d]
            rows.append((found.astype(np.int32), p.log, p.score, 1.0 if kappa[d] == -np.inf else float(-np.expm1(-np.exp(min(gap, 700.0))))))
        out.append(rows)
    return out


def _encode(path: str, s: Sampling, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = Vocabulary.of(path, s.alpha)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
    names = ["doc_id", "sample", "n_pieces", "log_prob", "score", "inclusion", "ids"]

    def run(keys: list, texts: list) -> pa.RecordBatch:
        columns: tuple[list, ...] = tuple([] for _ in names)
        for key, rows in zip(keys, sample_texts([-1 if k is None else k for k in keys], texts, v, s), strict=True):
            for i, (ids, log, score, inclusion) in enumerate(rows, 1):
                for c, x in zip(columns, (key, i, len(ids), log, score, inclusion, ids.astype("<u4").tobytes()), strict=True):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            piece = batch.slice(first, 256)
            keys, texts, size = [], [], 0
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text or "") + 1
                if size >= SLICE_CHARS:
                    yield run(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield run(keys, texts)


def encode(docs: DataFrame, model: str, sampling: Sampling = Sampling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """k rows, or as many as there are segmentations, for each row of docs; ids are little-endian unsigned 32-bit integers. Nothing shuffles."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_encode, model, sampling), SCHEMA)


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = Vocabulary.of(path)
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            piece = batch.slice(first, 256)
            texts = v.decode_rows([ids or b"" for ids in piece.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*piece.columns, texts], names=[*piece.schema.names, "decoded"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with the text of its ids, as `decoded`."""
    schema = encoded.withColumn("decoded", F.lit("")).schema
    return encoded.mapInArrow(partial(_decode, model), schema)
