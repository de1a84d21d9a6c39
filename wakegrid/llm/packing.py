"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids; a document longer than a sequence is cut into whole
sequences and a rest.  What is left to decide depends only on how many pieces of
each length there are, so the driver sees a histogram of at most ``size`` numbers,
however many documents there are:

* the configuration program (least number of sequences, one variable per way of
  filling a sequence) is solved by column generation; a knapsack dynamic program
  over the sequence's places finds the fillings that the prices ask for, and the
  prices bound the number of sequences from below;
* fillings are rounded down to whole sequences, and the rest is filled best-fit
  decreasing, still by length and count; best-fit alone and the fullest choice for
  the longest piece are other plans, and rounds go on until one is near the bound;
* pieces of a length are numbered in parallel and take the places of that length.

Null texts count as empty; an empty text is the end id alone.  Rows that repeat a
document are packed like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bucket_count, id_and_text, kept
from .text import SPACE, Hasher, slices, spread, word_bounds

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words whose ids a worker process keeps; the store is begun anew beyond it.
WORDS_KEPT = 2_000_000


class Store:
    """Ids of words by 64 bits of hash (which include the length), as arrays: some 30 bytes for a word."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Take in the ids of keys that are sorted and not held."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.keys = np.insert(self.keys, at, keys)
        self.used += total


#: Marks that may be split off behind an ASCII letter: the vocabulary's rules never join them with it.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain and b != 32]
    return {b: chr(256 + k + (b > 32)) for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


#: A text without any of these and without ' and < holds, beside ASCII, only composed Latin letters;
#: it has no contractions and no names of special ids, so that letters, digits and marks part by kind.
UNUSUAL = re.compile(rb"[\xc6-\xff]|\xc2|\xc3[\x97\xb7]|\xc4\xb0")
#: Kinds of bytes of a lower-case text: 0 white space, 1 letters, 2 digits, 3 marks.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2


def parts(word: bytes) -> tuple[bytes, bytes]:
    """A word as (body, marks behind it) such that its ids are theirs end to end; a plain body in lower case."""
    body = word.rstrip(MARKS)
    if len(body) == len(word) or not body[-1:].isalpha() or b"<" in body:
        body, marks = word, b""
    else:
        marks = word[len(body) :]
    return (body.lower() if body.isascii() and body.isalpha() else body), marks


class WordIds:
    """Token ids of texts, word by word.

    The vocabulary's rules never look across white space, so the ids of a text
    are those of its words, and each distinct word is looked at once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's other cores are other tasks'
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        # for words of letters: the same merges, without the rules that find words
        self.speller = Tokenizer(self.encoder.model)
        self.speller.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.hasher = Hasher(17)
        vocabulary = self.encoder.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.store = Store()

    def spelled(self, words: list[bytes], many: int = 2000) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of composed words of letters only, many to a call: each ends with the one id that closes a word."""
        for at in range(0, len(words), many):
            some = words[at : at + many]
            lowered = b" ".join(some).decode().lower()
            if not lowered.isascii():
                lowered = lowered.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.speller.encode(lowered, add_special_tokens=False).ids
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(ends) == len(some):
                yield from zip(some, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
            else:
                said = self.encoder.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                yield from ((w, e.ids) for w, e in zip(some, said, strict=True))

    def looked_up(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words by the vocabulary's own rules."""
        # what ends in a letter has no marks to split off
        split = [(w, b"") if w[-1] > 96 else parts(w) for w in words]
        new = list(dict.fromkeys(x for pair in split for x in pair if x))
        texts = [w.decode("utf-8", "replace") for w in new]
        plain = [t.isalpha() and (t.isascii() or max(t) < "\u0180" and "\u0130" not in t) for t in texts]
        known: dict[bytes, list[int]] = {b"": []}
        known.update(self.spelled([w for w, p in zip(new, plain, strict=True) if p and w.isascii()]))
        known.update(self.spelled([w for w, p in zip(new, plain, strict=True) if p and not w.isascii()]))
        odd = [(w, t) for w, t, p in zip(new, texts, plain, strict=True) if not p]
        said = self.encoder.encode_batch_fast([t for _, t in odd], add_special_tokens=False)
        known.update((w, e.ids) for (w, _), e in zip(odd, said, strict=True))
        return [known[body] + known[marks] if marks else known[body] for body, marks in split]

    def tokens(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, end to end, and how many each has.  What is new is looked up once."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.hasher.load(np.frombuffer(raw, np.uint8))
        keys, first, which = np.unique(self.hasher.ranges(start, end), return_index=True, return_inverse=True)
        at = self.store.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.store.keys) + len(new) > WORDS_KEPT:
                self.clear()
                new = np.arange(len(keys))
            words = [raw[x:y] for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            self.store.add(keys[new], self.looked_up(words))
            at = self.store.find(keys)
        at = at[which]
        begin, count = self.store.begin[at], self.store.count[at]
        return self.store.flat[np.repeat(begin, count) + spread(count)], count

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of usual texts end to end, and where each text's ids begin."""
        texts = [t.lower() if t.isascii() else t.decode().lower().encode() for t in texts]
        raw, offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])
        kind = KIND[np.frombuffer(raw, np.uint8)]
        # a unit begins where the kind changes, at each digit, and where a text begins
        new = np.ones(len(kind) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[offsets] = True
        bounds = np.flatnonzero(new)
        solid = kind[bounds[:-1]] > 0 if len(kind) else np.zeros(0, bool)
        start, end = bounds[:-1][solid], bounds[1:][solid]
        tokens, count = self.tokens(raw, start, end)
        return tokens, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offsets)]

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        usual = [b"'" not in t and b"<" not in t and (t.isascii() or not UNUSUAL.search(t)) for t in texts]
        tokens, ends = self.units([t for t, u in zip(texts, usual, strict=True) if u])
        ends = ends.tolist()
        k = 0
        for t, u in zip(texts, usual, strict=True):
            if u:
                yield tokens[ends[k] : ends[k + 1]]
                k += 1
            else:
                start, end, _ = word_bounds(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
                yield self.tokens(t, start, end)[0]


def word_ids(path: str) -> WordIds:
    """The worker process's ids for a vocabulary, kept from task to task.

    Functions come to the workers by value, so what shall outlive a task hangs on a
    module that stays.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("word_ids_by_path", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def cut_pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or word_ids(path)
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for at, n, data, offsets in slices(batch):
                raw = data.tobytes()
                texts = [raw[offsets[i] : offsets[i + 1]] for i in range(n)]
                for doc, tokens in zip(ids[at : at + n], words.ids(texts), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(tokens), size)):
                        piece = tokens[start : start + size]
                        rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
            if rows:
                doc, k, start, length, crc = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """A row per piece: its document's id, number, first token, length and checksum."""
    return id_and_text(docs).mapInArrow(cut_pieces(path, size, end_id), PIECES)


def priced(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of places the greatest worth of a filling, and the length to take there (-1: leave one empty)."""
    best, take = np.zeros(size + 1), np.full(size + 1, -1)
    if int((size // lengths).sum()) < size:
        # length after length: stretches of one length's width depend on the stretch before
        for k, (n, w) in enumerate(zip(lengths.tolist(), worth.tolist(), strict=True)):
            for c in range(n, size + 1, n):
                end = min(c + n, size + 1)
                more = best[c - n : end - n] + w
                better = more > best[c:end]
                best[c:end][better] = more[better]
                take[c:end][better] = k
    else:
        short = np.searchsorted(lengths, np.arange(size + 1), "right")
        for c in range(1, size + 1):
            n = short[c]
            best[c] = best[c - 1]
            if n:
                found = best[c - lengths[:n]] + worth[:n]
                k = int(found.argmax())
                if found[k] > best[c]:
                    best[c], take[c] = found[k], k
    return best, take


def traced(lengths: list[int], take: list[int], c: int) -> dict[int, int]:
    """The filling that a table of ``priced`` gives for ``c`` places: which lengths, and how often."""
    filling: dict[int, int] = {}
    while c > 0:
        k = take[c]
        if k < 0:
            c -= 1
        else:
            filling[k] = filling.get(k, 0) + 1
            c -= lengths[k]
    return filling


def knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> np.ndarray:
    """How often each length stands in the filling of greatest worth."""
    filling = np.zeros(len(lengths), np.int64)
    for k, a in traced(lengths.tolist(), priced(lengths, worth, size)[1].tolist(), size).items():
        filling[k] = a
    return filling


def dealt(lengths: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of lengths that begin at these places: the longest length of each, and its pieces."""
    return lengths[np.append(begin[1:], len(lengths)) - 1], np.add.reduceat(counts.astype(float), begin)


class Program:
    """The covering program by column generation: the simplex method over fillings.

    A knapsack under the present prices gives the best filling with each length.
    Beside fillings there is, for each length, the exchange that puts a piece into
    a place of the next longer one; it keeps prices rising with length, without
    which thousands of lengths take very many rounds.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, size: int):
        self.size = size
        self.basis: list[dict[int, int]] = [{k: size // n} for k, n in enumerate(lengths.tolist())]
        self.cost = np.ones(len(lengths))  # 0 where the basis has an exchange
        self.load(lengths, demand)

    def load(self, lengths: np.ndarray, demand: np.ndarray) -> None:
        self.lengths, self.demand = lengths, demand
        # hardly more than asked for, each length by another share, so that no two are used up at once
        self.asked = demand * (1 + 1e-7 * np.random.default_rng(5).random(len(lengths)))
        self.invert()

    def invert(self) -> None:
        square = np.zeros((len(self.basis), len(self.basis)))
        for k, filling in enumerate(self.basis):
            square[list(filling), k] = list(filling.values())
        self.inverse, self.pivots = np.linalg.inv(square), 0
        self.times = np.maximum(self.inverse @ self.asked, 0)
        self.price = self.cost @ self.inverse

    def split(self, lengths: np.ndarray, demand: np.ndarray) -> None:
        """Go on with more lengths: new ones begin in the places of the next longer old one."""
        at = np.searchsorted(lengths, self.lengths)
        self.basis = [{int(at[k]): a for k, a in filling.items()} for filling in self.basis]
        new = np.setdiff1d(np.arange(len(lengths)), at)
        self.basis += [{k: 1, k + 1: -1} for k in new.tolist()]
        self.cost = np.append(self.cost, np.zeros(len(new)))
        self.load(lengths, demand)

    def cover(self) -> float:
        return float(self.cost @ self.times)

    def step(self) -> tuple[float, bool]:
        """One round: a lower bound from the prices before it, and whether some filling or exchange gained."""
        if self.pivots > 1000:
            self.invert()
        n, size = len(self.lengths), self.size
        worth = np.maximum(self.price, 0)
        best, take = priced(self.lengths, worth, size)
        bound = float(self.demand @ worth) / float(best[size])
        value, taken, widths = worth + best[size - self.lengths], take.tolist(), self.lengths.tolist()
        found: dict[tuple, dict[int, int]] = {}
        for k in np.flatnonzero((value > 1 + 1e-9) & (worth > 0)).tolist():
            filling = traced(widths, taken, size - widths[k])
            filling[k] = filling.get(k, 0) + 1
            found[tuple(sorted(filling.items()))] = filling
        pool = [*found.values(), {0: -1}, *({k: 1, k + 1: -1} for k in range(n - 1))]
        due = np.append(np.ones(len(found)), np.zeros(n))
        wide = max(map(len, pool))
        which, often = np.zeros((len(pool), wide), np.int64), np.zeros((len(pool), wide))
        for i, filling in enumerate(pool):
            which[i, : len(filling)], often[i, : len(filling)] = list(filling), list(filling.values())
        before = least = self.cover()
        idle = 0
        while idle <= n:  # prices are asked anew when so many exchanges saved nothing
            gain = (self.price[which] * often).sum(axis=1) - due
            i = int(gain.argmax())
            if gain[i] <= 1e-9:
                break
            along = self.inverse[:, which[i]] @ often[i]
            up = np.flatnonzero(along > 1e-8)
            if not len(up):
                break
            r = int(up[(self.times[up] / along[up]).argmin()])
            times = self.times[r] / along[r]
            self.times = np.maximum(self.times - times * along, 0)
            self.times[r] = times
            row = self.inverse[r] / along[r]
            self.price = self.price - gain[i] * row
            for at in range(0, n, 256):
                self.inverse[at : at + 256] -= np.outer(along[at : at + 256], row)
            self.inverse[r] = row
            self.basis[r], self.cost[r] = pool[i], due[i]
            self.pivots += 1
            now = self.cover()
            idle = 0 if now < least else idle + 1
            least = min(least, now)
        return bound, self.cover() < before * (1 - 1e-12)


#: How far above the lower bound, as a share of it, a plan may end.
TOLERANCE = 0.002
#: Up to so many stretches the program is solved to its end, with more until the tolerance is met.
TO_THE_END = 256


def solutions(lengths: np.ndarray, counts: np.ndarray, size: int, tolerance: float, work: int | None = None) -> Iterator[tuple[list[tuple[dict[int, int], float]], float]]:
    """Ever better covers: fillings (length -> places of it) and how many sequences of each, and a lower bound on the number of sequences.

    Stretches of neighbouring lengths are first taken for their longest one, whose
    places hold all of them, and then split where that costs most.  Prices over
    the worth of their best filling are a dual solution, of stretches and, by
    interpolation, of all lengths, which bounds the program from below.  The last
    cover has each length for itself and no filling that gains, or comes earlier
    when the cover is within ``tolerance`` of the bound.  ``work`` is for callers
    who want it to end before, after so many knapsack steps.
    """
    bound, spent = float((lengths * counts).sum()) / size, 0
    volume = np.cumsum(lengths * counts.astype(float))
    begin = np.unique(np.append(0, np.searchsorted(volume[:-1], volume[-1] * np.arange(1, 32) / 32, "right")))
    program = Program(*dealt(lengths, counts, begin), size)
    while True:
        gains, of_stretches = True, 0.0
        while gains and (work is None or spent < work):
            spent += min(size, int((size // program.lengths).sum()))
            lower, gains = program.step()
            of_stretches = max(of_stretches, lower)
            if len(begin) > TO_THE_END and program.cover() <= (1 + tolerance / 2) * of_stretches:
                break
        rising = np.maximum.accumulate(np.maximum(program.price, 0))
        worth = np.interp(lengths, np.append(0, program.lengths), np.append(0, rising))
        # a stretch's lengths are worth no less than the longest one before them: better where prices jump
        below = np.repeat(np.append(0, rising[:-1]), np.diff(np.append(begin, len(lengths))))
        for some in (worth, below):
            most = float(priced(lengths, some, size)[0][size])
            bound = max(bound, float(counts @ some) / most if most > 0 else 0.0)
        single = len(begin) == len(lengths)
        if single:
            bound = max(bound, of_stretches)
        tops = program.lengths.tolist()
        chosen = zip(program.basis, program.times.tolist(), program.cost, strict=True)
        yield [({tops[k]: a for k, a in f.items()}, t) for f, t, c in chosen if c and t > 0], bound
        if single or program.cover() <= (1 + tolerance) * bound or work is not None and spent >= work:
            return
        # what stretches lose by standing for their longest length
        end = np.append(begin[1:], len(lengths))
        many = end - begin > 1
        lost = np.add.reduceat((np.repeat(rising, end - begin) - worth) * counts, begin)
        cut = many & (lost >= np.median(lost[many]))
        begin = np.unique(np.append(begin, (begin[cut] + end[cut]) // 2))
        program.split(*dealt(lengths, counts, begin))


def configurations(lengths: np.ndarray, counts: np.ndarray, size: int, tolerance: float, work: int | None = None) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The last of the ``solutions``."""
    last: tuple[list[tuple[dict[int, int], float]], float] = ([], 0.0)
    if len(lengths):
        for last in solutions(lengths, counts, size, tolerance, work):
            pass
    return last


def seated(solution: list[tuple[dict[int, int], float]], histogram: dict[int, int]) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Whole sequences of the program's fillings with the longest pieces that fit into each place, and the pieces that remain."""
    left = dict(histogram)
    order = sorted(left, reverse=True)
    whole = [(f, int(t + 1e-6)) for f, t in solution if t + 1e-6 >= 1]
    slots = sorted(((n, i) for i, (f, _) in enumerate(whole) for n, a in f.items() for _ in range(a)), reverse=True)
    runs: list[list[list[tuple[int, int]]]] = [[] for _ in whole]
    at = 0
    for n, i in slots:
        wanted, run = whole[i][1], []
        while wanted and at < len(order):
            if order[at] > n or not left[order[at]]:
                at += 1
                continue
            used = min(wanted, left[order[at]])
            left[order[at]] -= used
            wanted -= used
            run.append((order[at], used))
        runs[i].append(run)
    made = []
    for mine in runs:
        ends = sorted({e for run in mine for e in np.cumsum([u for _, u in run]).tolist()})
        begin = 0
        for end in ends:
            filling: dict[int, int] = {}
            for run in mine:
                passed = 0
                for n, used in run:
                    passed += used
                    if passed > begin:
                        filling[n] = filling.get(n, 0) + 1
                        break
            made.append((filling, end - begin))
            begin = end
    return made, {n: c for n, c in left.items() if c}


def fullest(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Sequence after sequence the longest piece left and, of all that may join it, the fullest choice.

    Sums that can be reached are bits of a number; a filling is used as often as
    there are pieces for it.
    """
    left = {n: c for n, c in histogram.items() if c}
    made = []
    everything = (1 << size + 1) - 1
    while left:
        top = max(left)
        free = size - top
        mask = everything >> top
        parts: list[tuple[int, int]] = []
        reached = [1]
        now = 1
        for n in sorted((n for n in left if n <= free), reverse=True):
            many, k = min(left[n] - (n == top), free // n), 1
            while many > 0:
                k = min(k, many)
                parts.append((n, k))
                now |= now << n * k & mask
                reached.append(now)
                many -= k
                k *= 2
            if now >> free & 1:  # full: shorter pieces are kept for later
                break
        filling = {top: 1}
        c = now.bit_length() - 1
        for i in range(len(parts) - 1, -1, -1):
            if not reached[i] >> c & 1:
                n, k = parts[i]
                filling[n] = filling.get(n, 0) + k
                c -= n * k
        many = min(left[n] // a for n, a in filling.items())
        made.append((filling, many))
        for n, a in filling.items():
            left[n] -= a * many
            if not left[n]:
                del left[n]
    return made


def plan(histogram: dict[int, int], size: int, tolerance: float = TOLERANCE, work: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Fillings (length -> how often) and how many sequences are filled so; every piece has a place.

    The program's covers are rounded down, pieces take their places, and the rest is
    packed best-fit decreasing into the room that is left.  Of these plans, of
    best-fit alone and of fullest choices alone the one with the fewest sequences
    is taken, so the program is never worse.  Covers are refined until a plan is
    within ``tolerance`` of the lower bound, or there is no better cover.
    """
    left = {int(n): int(c) for n, c in histogram.items() if n < size and c > 0}
    made: list[tuple[dict[int, int], int]] = []
    if histogram.get(size):
        made.append(({size: 1}, int(histogram[size])))
    if not left:
        return made
    lengths = np.array(sorted(left), np.int64)
    counts = np.array([left[int(n)] for n in lengths], np.int64)
    needed = lambda p: sum(many for _, many in p)
    best = min(fullest(left, size), best_fit(left, size), key=needed)
    for solution, bound in solutions(lengths, counts, size, tolerance, work):
        some, rest = seated(solution, left)
        # among equals the program's plan
        best = min(best_fit(rest, size, some), best, key=needed)
        if needed(best) <= max(np.ceil(bound - 1e-6), (1 + tolerance) * bound):
            break
    return made + best


def best_fit(histogram: dict[int, int], size: int, begun: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over lengths and counts, into ``begun`` sequences first: those that are filled alike move together."""
    room: dict[int, list[list]] = {}  # free places -> [filling, sequences]
    for filling, many in begun:
        room.setdefault(size - sum(n * a for n, a in filling.items()), []).append([filling, many])
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        for free in sorted(k for k in room if k >= n):
            if not left:
                break
            for group in room.pop(free):
                filling, many = group
                # as many of this length as fit go into one sequence, the fullest first
                each = min(free // n, left)
                used = min(many, left // each) if each else 0
                if used:
                    more = dict(filling)
                    more[n] = more.get(n, 0) + each
                    room.setdefault(free - each * n, []).append([more, used])
                    left -= used * each
                    many -= used
                if many:
                    room.setdefault(free, []).append([filling, many])
        while left:
            each = min(size // n, left)
            used = left // each
            room.setdefault(size - each * n, []).append([{n: each}, used])
            left -= used * each
    return [(filling, many) for groups in room.values() for filling, many in groups]


def places(made: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, how many to a sequence, first offset), by rank."""
    out: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, many in made:
        offset = 0
        for n in sorted(filling, reverse=True):
            out.setdefault(n, []).append((taken.get(n, 0), sequence, filling[n], offset))
            taken[n] = taken.get(n, 0) + many * filling[n]
            offset += n * filling[n]
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def seat(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = held.value
        for batch in batches:
            t = batch.to_pydict()
            length, rank = np.array(t["length"], np.int64), np.array(t["rank"], np.int64)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                rows = where[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + nth // row[:, 2]
                offset[mine] = row[:, 3] + nth % row[:, 2] * n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(items: DataFrame, size: int = 4096, each: int = 20_000) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``items`` is read several times, so it should be a written table.  The
    histogram and the plan that is sent to the tasks hold at most ``size``
    lengths and a few fillings for each.
    """
    spark = items.sparkSession
    by_length = items.groupBy("length").count().collect()
    histogram = {int(r["length"]): int(r["count"]) for r in by_length}
    held = spark.sparkContext.broadcast(places(plan(histogram, size)))
    salts = bucket_count(sum(histogram.values()), each, 16)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside)).join(counts, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(seat(held, names), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack ``docs``; see the module's head."""
    return pack(kept(pieces(docs, path, size, end_id), "pieces"), size)
