"""Packing documents into as few fixed-length sequences as possible, by bin completion.

Documents become token ids; those over the capacity are cut into full pieces and a rest. How pieces can be
packed depends only on how many there are of each length, so the search sees a table of at most
``capacity`` counts, whatever the corpus. It places the largest piece that is left and branches over the
undominated ways to fill the space around it, fullest first, pruned by the waste that the best packing so
far allows and by a lower bound on what is left; best-fit decreasing gives the first such packing. A filling is
first repeated as often as the counts allow, so the plan is a bounded list of patterns. The tree is walked with
a growing number of departures from the first choice, and no branch is dropped: without a limit of steps the
search ends with a proof; with one, ``packing_report`` tells how far the result is from the lower bound.

Pieces then take their places by their number among the pieces of their length. That number is counted in
two levels (within hash buckets, then over the buckets' sums), so a length that many documents share is no
hot group.

Defined results: a null text is empty; every document ends in ``end_id``, so none is without a piece; pieces
of repeated rows are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import math
import string
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Words, fresh, in_small_batches, remembered, spans, stash, worded


# --- tokens -----------------------------------------------------------------------------------


#: CLIP's words, in which letters in a row are one.
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def joined(words: pa.Array) -> str:
    """The words with a space between them."""
    return b" ".join(words.cast(pa.binary()).to_pylist()).decode("utf-8", "replace")


class Remembered:
    """Token ids of the strings seen so far: string i has ``ids[first[i] : first[i] + n[i]]`` and was found again ``again[i]`` times."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.first = self.n = self.again = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The place of each of different strings, -1 where it hasn't been seen."""
        at = np.asarray(pc.index_in(wanted, value_set=self.keys).fill_null(-1)).astype(np.int64)
        self.again[at[at >= 0]] += 1
        return at

    def thin(self, most: int) -> None:
        """Forget all but ``most`` strings, those found again least often first, the older of equal ones first."""
        if len(self.keys) <= most:
            return
        keep = np.sort(np.argsort(self.again, kind="stable")[len(self.keys) - most :])
        self.ids = self.ids[spans(self.first[keep], self.n[keep])]
        self.keys, self.n, self.again = self.keys.take(pa.array(keep)), self.n[keep], self.again[keep] // 2
        self.first = np.cumsum(self.n) - self.n

    def add(self, keys: pa.Array, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        places = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.again = np.concatenate([self.again, np.zeros(len(keys), np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        return places


class ChunkIds:
    """Token ids of each run of characters between ASCII white space.

    The tokenizer drops white space and joins nothing across it, so such runs are encoded apart, and those
    seen lately are remembered (up to ``limit``; past it half stay, those met most often). A run of letters is never joined with the ASCII punctuation after it
    if its letters are letters still once they are normalised: then it is encoded once for all its endings, many at a
    time, and cut at the word-end tokens. Letters whose normal form holds a mark (a nukta, the dot of the
    Turkish I) would join with punctuation, so runs that hold any are encoded whole.

    Where the tokenizer's patterns take a run of letters as one word, such runs are normalised together and pass its model without
    the patterns, which cost more than the model itself.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.of_letters = self.by_spaces(path)
        self.runs, self.bases, self.tails = Remembered(), Remembered(), Remembered()
        self.letters: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def by_spaces(path: str):
        """The tokenizer for normalised runs of letters between spaces; None where its patterns may cut those."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            steps = (json.load(file)["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        split = steps[0]
        if (split["behavior"], split["invert"], split["pattern"].get("Regex")) != ("Removed", True, CLIP_PATTERN):
            return None
        out = Tokenizer.from_file(path)
        out.normalizer = normalizers.Sequence([])
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids end)."""
        for table in (self.runs, self.bases, self.tails):
            if len(table.keys) > self.limit:
                table.thin(self.limit // 2)
        at = self.runs.find(words.distinct)
        lacking = at < 0
        if lacking.any():
            at[lacking] = self.learn(words.distinct.filter(pa.array(lacking)))
        n = self.runs.n[at][words.codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.runs.ids[spans(self.runs.first[at][words.codes], n)], ends[words.offsets[1:]]

    def letter(self, c: str) -> bool:
        """Whether a character is a letter, long known as one, and its normal form has only letters."""
        known = self.letters.get(c)
        if known is None:
            old = unicodedata.ucd_3_2_0
            known = self.letters[c] = all(unicodedata.category(x)[0] == old.category(x)[0] == "L" for x in c + self.tokenizer.normalizer.normalize_str(c))
        return known

    def all_letters(self, words: pa.Array) -> np.ndarray:
        """Whether every character of each word, none of which holds white space, is such a letter."""
        if not len(words):
            return np.zeros(0, bool)
        points = np.frombuffer(joined(words).encode("utf-32-le", "surrogatepass"), "<u4")
        each, which = np.unique(points, return_inverse=True)
        bad = ~np.array([chr(c) == " " or self.letter(chr(c)) for c in each.tolist()])[which]
        ends = np.concatenate([np.flatnonzero(points == 32), [len(points)]])
        return np.diff(np.concatenate([[0], np.cumsum(bad)])[ends], prepend=0) == 0

    def learn(self, new: pa.Array) -> np.ndarray:
        """Places among the runs, all of which are new."""
        base = pc.ascii_rtrim(new, characters=string.punctuation)
        plain = pc.ascii_is_alpha(base)
        wide = np.flatnonzero(~np.asarray(pc.string_is_ascii(base)))
        known = np.asarray(plain).copy()
        known[wide] = self.all_letters(base.take(pa.array(wide)))
        keys = pc.if_else(plain, pc.ascii_lower(base), pc.if_else(pa.array(known), base, new)).dictionary_encode()
        cut = np.flatnonzero(known & (np.asarray(pc.binary_length(new)) > np.asarray(pc.binary_length(base))))
        sizes = np.asarray(pc.binary_length(base))[cut].tolist()
        tails = pa.array([w[k:] for w, k in zip(new.take(pa.array(cut)).cast(pa.binary()).to_pylist(), sizes, strict=True)], pa.binary()).cast(pa.string()).dictionary_encode()
        letters = np.zeros(len(keys.dictionary), bool)
        letters[np.asarray(keys.indices)] = known
        key_at = self.based(self.bases, keys.dictionary, letters)[np.asarray(keys.indices)]
        tail_at = self.based(self.tails, tails.dictionary, np.zeros(len(tails.dictionary), bool))[np.asarray(tails.indices)]
        first, n = np.zeros((len(new), 2), np.int64), np.zeros((len(new), 2), np.int64)
        first[:, 0], n[:, 0] = self.bases.first[key_at], self.bases.n[key_at]
        first[cut, 1], n[cut, 1] = len(self.bases.ids) + self.tails.first[tail_at], self.tails.n[tail_at]
        ids = np.concatenate([self.bases.ids, self.tails.ids])
        return self.runs.add(new, ids[spans(first.ravel(), n.ravel())], n.sum(axis=1))

    def based(self, table: Remembered, keys: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Places in ``table``; those that are new are encoded, ``letters`` many at a time."""
        at = table.find(keys)
        plain, other = np.flatnonzero((at < 0) & letters), np.flatnonzero((at < 0) & ~letters)
        ascii_ = np.asarray(pc.string_is_ascii(keys))[plain]  # lower-cased already
        for few in (x[i : i + 20_000] for x in (plain[ascii_], plain[~ascii_]) for i in range(0, len(x), 20_000)):
            text, tokenizer = joined(keys.take(pa.array(few))), self.tokenizer
            if self.of_letters:
                tokenizer = self.of_letters
                text = text if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(few):  # can't be while all are letters; one at a time is right in any case
                other = np.concatenate([other, few])
                continue
            at[few] = table.add(keys.take(pa.array(few)), ids, np.diff(cuts, prepend=0))
        for few in (other[i : i + 4_000] for i in range(0, len(other), 4_000)):  # the library's encodings are large
            texts = [x.decode("utf-8", "replace") for x in keys.take(pa.array(few)).cast(pa.binary()).to_pylist()]
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            at[few] = table.add(keys.take(pa.array(few)), np.concatenate(found), np.array([len(ids) for ids in found], np.int64))
        return at


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ids_crc32 for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(path)
        gc.freeze()  # else every collection walks the remembered words
        if path not in remembered:
            remembered[path] = ChunkIds(path)
        chunks = remembered[path]
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch, words in worded(batches, "text", most=2_000_000, keep=path):
            ids, ends = chunks.encode(words)
            raw = memoryview(ids.tobytes())
            n = np.diff(ends, prepend=0) + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(n[row] - piece * capacity, capacity)
            crc = []
            for first, size, last in zip(((ends - n + 1)[row] + piece * capacity).tolist(), length.tolist(), (piece == pieces[row] - 1).tolist(), strict=True):
                found = zlib.crc32(raw[first * 4 : (first + size - last) * 4])
                crc.append(zlib.crc32(end, found) if last else found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, piece int, start bigint, length int, ids_crc32 bigint")


# --- the search -------------------------------------------------------------------------------

Pattern = tuple[tuple[int, ...], int]  # lengths, largest first; how many sequences hold them


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Largest first, each into the fullest sequence that has room; equal pieces and equal sequences move together."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, how many]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = sorted(r for r in open_ if r >= size)
        while left and rooms:
            room = rooms.pop(0)
            group = open_[room]
            held, n = group.pop()
            if not group:
                del open_[room]
            fit = room // size
            if left >= fit * n:
                take, put = n, fit
            else:
                take, put = (left // fit, fit) if left >= fit else (1, left)
            if n > take:
                open_.setdefault(room, []).append((held, n - take))
            open_.setdefault(room - put * size, []).append(((*held, *(size,) * put), take))
            left -= take * put
            if left:
                rooms = sorted(r for r in open_ if r >= size)
        if left:
            fit = capacity // size
            if left >= fit:
                open_.setdefault(capacity - fit * size, []).append(((size,) * fit, left // fit))
            if left % fit:
                open_.setdefault(capacity - left % fit * size, []).append(((size,) * (left % fit), 1))
    return [(held, n) for group in open_.values() for held, n in group]


def first_fillings(counts: dict[int, int], sizes: np.ndarray, room: int, limit: int) -> list[tuple[int, ...]]:
    """Some ways to fill ``room``, least waste first: exact fills by one piece, then by two, then deeper ones, largest
    pieces first. At most ``limit`` are looked at; ``all_fillings`` has the others."""
    found: list[tuple[int, tuple[int, ...]]] = []
    smallest = int(sizes[0]) if len(sizes) else 0
    visits = 0

    def best_two(space: int, left: dict[int, int], below: int) -> tuple[int, ...] | None:
        """The one or two pieces up to ``below`` that fill ``space`` best."""
        top = np.searchsorted(sizes, min(space, below), side="right")
        can = sizes[:top]
        if not len(can):
            return None
        one = int(can[-1])
        if one == space:
            return (one,)
        other = can[np.searchsorted(can, space - can, side="right") - 1]
        ok = other + can <= space
        if not ok.any():
            return (one,)
        total = np.where(ok, can + other, 0)
        for at in np.flatnonzero(total == total.max())[::-1]:
            a, b = int(can[at]), int(other[at])
            if a != b or left[a] > 1:
                return (max(a, b), min(a, b)) if a + b > one else (one,)
        return (one,)

    def deeper(space: int, chosen: tuple[int, ...], below: int, left: dict[int, int]) -> None:
        nonlocal visits
        visits += 1
        tail = best_two(space, left, below)
        if tail is None:
            found.append((space, chosen))
            return
        rest = space - sum(tail)
        if rest < smallest or rest == 0:
            found.append((rest, chosen + tail))
        top = int(np.searchsorted(sizes, min(space, below), side="right"))
        for at in range(top - 1, max(-1, top - 9), -1):
            size = int(sizes[at])
            if left[size] < 1:
                continue
            if visits >= limit:
                break
            left[size] -= 1
            deeper(space - size, (*chosen, size), size, left)
            left[size] += 1

    deeper(room, (), room, counts)
    best: dict[tuple[int, ...], int] = {}
    for waste, fill in found:
        best.setdefault(tuple(sorted(fill, reverse=True)), waste)
    return [fill for fill, _ in sorted(best.items(), key=lambda x: (x[1], len(x[0]), [-s for s in x[0]]))]


def all_fillings(counts: dict[int, int] | array, sizes: list[int] | array, room: int) -> Iterator[tuple[int, ...]]:
    """Every way to fill ``room`` in which no smaller piece has room left over, largest pieces first; sizes fall."""

    def deeper(space: int, chosen: tuple[int, ...], at: int) -> Iterator[tuple[int, ...]]:
        while at < len(sizes) and sizes[at] > space:
            at += 1
        if at == len(sizes):
            yield chosen
            return
        for k in range(at, len(sizes)):
            size = sizes[k]
            most = min(counts[size], space // size)
            if most:
                for n in range(most, 0, -1):
                    yield from deeper(space - n * size, (*chosen, *(size,) * n), k + 1)

    yield from deeper(room, (), 0)


def dominated(fill: tuple[int, ...], counts: dict[int, int], sizes: np.ndarray, room: int) -> bool:
    """Whether a piece left out could take the place of one or more pieces of no larger sum, or of free space.

    Such a filling need not be tried: what it frees fits where the piece would have gone.
    """
    free = room - sum(fill)
    sums, several = 1, 0  # bit s: some pieces, or at least two, sum to s
    for size in fill:
        several |= (sums & ~1) << size | several << size
        sums |= sums << size
    used = Counter(fill)
    width = room // 8 + 1
    reach = np.unpackbits(np.frombuffer(sums.to_bytes(width, "little"), np.uint8), bitorder="little")
    before = np.concatenate([[0], np.cumsum(reach)])
    out = sizes[[counts[s] > used.get(s, 0) for s in sizes.tolist()]] if used else sizes
    if (before[out] > before[np.maximum(out - free, 0)]).any():
        return True
    return any(several >> s & 1 for s in out.tolist())


def fewest_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: no packing has fewer sequences.

    For each k, pieces over capacity - k share a sequence with none of k or more; pieces over half the
    capacity share with no other such one; what smaller pieces of k or more don't fit beside those needs sequences
    of its own. k = 0 gives the bound by total waste. Beside it, for each d a piece counts as a d-th part of a sequence
    for each (d + 1)-th part of one that it exceeds (as its own size if it is just such parts): no sequence holds more
    than one by this measure, again with pieces under k left out and those over capacity - k as whole ones.
    """
    size = np.array(sorted(counts), np.int64)
    if not len(size):
        return 0
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    number, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * size))
    half = int(np.searchsorted(size, capacity // 2, side="right"))  # from here on over half
    k = np.concatenate([[0], size[:half]])
    low = np.searchsorted(size, k, side="left")
    high = np.maximum(np.searchsorted(size, capacity - k, side="right"), half)
    alone, halves = number[-1] - number[high], number[high] - number[half]
    room = halves * capacity - (total[high] - total[half])
    rest = total[half] - total[np.minimum(low, half)] - room
    bound = int((alone + halves + np.maximum(0, -(-rest // capacity))).max())
    for d in range(2, 12):
        parts = size * (d + 1)
        measure = np.where(parts % capacity == 0, size * d, parts // capacity * capacity)
        sums = np.concatenate([[0], np.cumsum(n * measure)])
        whole = (sums[high] - sums[np.minimum(low, high)]) + alone * capacity * d
        bound = max(bound, int((-(-whole // (capacity * d))).max()))
    return bound


def tight(counts: dict[int, int], capacity: int, below: float = math.inf, visits: int = 32) -> list[Pattern] | None:
    """Around the largest piece that is left, each time, the fillings looked at that waste least, as often as the counts allow.
    None as soon as that can't end in fewer than ``below`` sequences."""
    left, plan = dict(counts), []
    used, total = 0, sum(s * n for s, n in counts.items())
    while left:
        if used + -(-total // capacity) >= below:
            return None
        size = max(left)
        around = left | {size: left[size] - 1}
        inside = np.array(sorted(s for s, n in around.items() if n and s <= capacity - size), np.int64)
        fills = first_fillings(around, inside, capacity - size, visits) if len(inside) else []
        held = (f for f in fills if all(around[s] >= k for s, k in Counter(f).items()))
        whole = Counter((size, *next(held, ())))
        times = min(left[s] // k for s, k in whole.items())
        plan.append((tuple(sorted(whole.elements(), reverse=True)), times))
        used += times
        for s, k in whole.items():
            total -= s * k * times
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return plan


def split_packings(counts: dict[int, int], capacity: int, fewest: int, cuts: int = 24) -> Iterator[list[Pattern]]:
    """Packings of fewer and fewer than ``fewest`` sequences in which the pieces up to a length are packed tightly and those beyond it by best fit, for lengths spread over
    the pieces.

    Where two large pieces or three small ones fill a sequence, best fit spends small pieces on large ones and ends in
    pairs; apart, the small ones go in threes.
    """
    sizes = sorted(counts)
    upto = np.cumsum([counts[s] for s in sizes])
    places = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], cuts + 1)[1:]))
    for at in places.tolist():
        cut = sizes[min(at, len(sizes) - 1)]
        small = {s: n for s, n in counts.items() if s <= cut}
        large, at_least = {s: n for s, n in counts.items() if s > cut}, fewest_sequences(small, capacity)
        if at_least + fewest_sequences(large, capacity) >= fewest:
            continue
        large = best_fit_decreasing(large, capacity)
        rest = fewest - sum(n for _, n in large)
        found = tight(small, capacity, rest) if at_least < rest else None
        if found is not None and sum(n for _, n in found) < rest:
            yield found + large
            fewest += sum(n for _, n in found) - rest


def bin_completion(counts: dict[int, int], capacity: int, steps: int | None = 3_000, visits: int = 64) -> list[Pattern]:
    """A packing of ``counts`` pieces of each length; optimal where its size meets the lower bound or the search ends.

    ``steps`` bounds the fillings tried (None: search until the optimum is proven) and ``visits`` how many are
    sorted at a node before the rest follow unsorted. Every piece is packed whatever they are.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    total = sum(s * n for s, n in left.items())
    bound = fewest_sequences(left, capacity)
    best = best_fit_decreasing(left, capacity)
    fewest = sum(n for _, n in best)
    taken = 0
    if fewest > bound:
        for other in split_packings(left, capacity, fewest):
            best, fewest = other, sum(n for _, n in other)
            if fewest == bound:
                break

    def beside(size: int) -> tuple[dict[int, int], np.ndarray]:
        """What is left around a piece of ``size``, and the lengths of it that fit."""
        around = left | {size: left[size] - 1}
        return around, np.array(sorted(s for s, n in around.items() if n and s <= capacity - size), np.int64)

    def ways() -> Iterator[tuple[tuple[int, ...], int] | None]:
        """(filling, how often) around the largest piece, None for each that is dominated.

        A path has thousands of these at once. What is left is again as it was when one goes on, so each makes ``beside`` anew
        instead of holding it.
        """
        size = max(left)
        room = capacity - size
        around, inside = beside(size)
        if not len(inside):
            yield (size,), left[size]
            return
        if inside[-1] == room:  # an exact fill by one piece dominates all others
            yield (size, room), min(left[size], left[room]) if size != room else left[size] // 2
            if left[size] > 1:
                yield (size, room), 1
            return
        often = lambda fill: min(left[s] // k for s, k in Counter(fill).items())
        seen = set()
        repeated = []
        guesses = first_fillings(around, inside, room, visits)

        def others() -> Iterator[tuple[int, ...]]:
            around, inside = beside(size)
            number = array("q", bytes(8 * (room + 1)))
            for s in inside.tolist():
                number[s] = around[s]
            sizes = array("i", inside[::-1].tolist())
            del around, inside
            yield from all_fillings(number, sizes, room)

        for fill in chain(guesses, others()):
            if fill in seen:
                continue
            if len(seen) <= len(guesses):
                seen.add(fill)
            if around is None:
                around, inside = beside(size)
            worse = dominated(fill, around, inside, room)
            around = inside = None
            if worse:
                yield None
                continue
            whole = (size, *fill)
            times = often(whole)
            yield whole, times
            if times > 1:
                repeated.append(whole)
                if len(repeated) == 1024:  # hold no more than these
                    yield from ((f, 1) for f in repeated)
                    repeated = []
        yield from ((f, 1) for f in repeated)

    def put(fill: tuple[int, ...], times: int) -> None:
        for s, k in Counter(fill).items():
            rest = left.get(s, 0) - k * times
            if rest:
                left[s] = rest
            else:
                left.pop(s, None)

    def reached(met: dict, used: int, may: int, most: int = 100_000) -> bool:
        """Whether what is left wasn't reached before as well or better. A state is known by a digest of its counts: the
        counts themselves, thousands a state, would fill the driver."""
        table = np.zeros(capacity + 1, np.int64)
        table[list(left)] = list(left.values())
        key = hashlib.blake2b(table, digest_size=32).digest()
        was = met.get(key)
        if was is not None and was[0] <= used and was[1] >= may:
            return False
        if len(met) < most:
            met[key] = used, may
        return True

    def walk(departures: int) -> bool:
        """Search paths with so many departures from first choices; whether none had to be left out."""
        nonlocal best, fewest, taken
        whole = True
        path: list[tuple[tuple[int, ...], int]] = []
        levels = [[ways(), 0, departures]]  # options, how many were taken, departures left
        used = waste = 0
        met: dict[bytes, tuple[int, int]] = {}  # what was left: with how many sequences, and departures left
        while levels:
            options, tried, may = levels[-1]
            option = next(options, None) if (steps is None or taken < steps) and fewest > bound else None
            ended = option is None and (steps is not None and taken >= steps or fewest <= bound or options.gi_frame is None)
            taken += 1
            if option is None and not ended:
                continue
            if ended or tried > may:
                whole &= ended and options.gi_frame is None
                levels.pop()
                if path:
                    fill, times = path.pop()
                    put(fill, -times)
                    used -= times
                    waste -= (capacity - sum(fill)) * times
                continue
            levels[-1][1] += 1
            fill, times = option
            lost = (capacity - sum(fill)) * times
            if waste + lost > (fewest - 1) * capacity - total:
                continue
            put(fill, times)
            if not left:
                if used + times < fewest:
                    best, fewest = [*path, (fill, times)], used + times
            elif reached(met, used + times, may - tried) and used + times + fewest_sequences(left, capacity) < fewest:
                path.append((fill, times))
                used += times
                waste += lost
                levels.append([ways(), 0, may - tried])
                continue
            put(fill, -times)
        return whole

    departures = 0
    while left and fewest > bound and (steps is None or taken < steps):
        if walk(departures):
            break
        departures = 2 * departures + 1
    return best


def packing_report(pieces: DataFrame, capacity: int = 4096, **options) -> DataFrame:
    """One row: pieces, sequences in the packing, and the lower bound on them."""
    counts = {int(size): int(n) for size, n in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = bin_completion(counts, capacity, **options)
    row = (sum(counts.values()), sum(n for _, n in plan), fewest_sequences(counts, capacity))
    return pieces.sparkSession.createDataFrame([row], "pieces bigint, sequences bigint, at_least bigint")


def pack(pieces: DataFrame, capacity: int = 4096, deal: str | None = None, **options) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which has ``length`` and whatever else; ``options`` are those of the search.

    ``deal``: a column of whole numbers that spreads the rows, equal ones too, and is stored, as it is read twice; it isn't kept. Without it rows are dealt by
    a hash, by which equal rows meet in one task.
    """
    spark = pieces.sparkSession
    counts = {int(size): int(n) for size, n in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = places(bin_completion(counts, capacity, **options))
    shared = spark.sparkContext.broadcast(plan)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [c for c in pieces.columns if c != deal]
    spread = F.xxhash64(*columns) if deal is None else F.col(deal)
    dealt = pieces.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int")).select("_bucket", *columns)
    before = dealt.groupBy("length", "_bucket").count()
    before = before.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*columns))
    ranked = dealt.withColumn("_n", within).join(before, ["length", "_bucket"]).withColumn("_n", F.col("_before") + F.col("_n") - 1)
    ranked = ranked.select("_n", *columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, sequence, apart, copies, offset = (shared.value[k] for k in ("first", "length", "sequence", "apart", "copies", "offset"))
        starts = (size.astype(np.int64) << 44) + first
        for batch in batches:
            n = np.asarray(batch.column(0))
            length = np.asarray(batch.column(batch.schema.get_field_index("length"))).astype(np.int64)
            at = np.searchsorted(starts, (length << 44) + n, side="right") - 1
            turn = n - first[at]
            within = sequence[at] + turn // copies[at]
            place_at = offset[at] + (turn % copies[at]) * apart[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(within), pa.array(place_at)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*columns).dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def places(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length in each pattern: the number of its first piece there, and where its pieces go."""
    next_of: dict[int, int] = {}
    rows, sequence = [], 0
    for fill, times in plan:
        offset = 0
        for size, k in sorted(Counter(fill).items(), reverse=True):
            rows.append((size, next_of.get(size, 0), sequence, size, k, offset))
            next_of[size] = next_of.get(size, 0) + k * times
            offset += size * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("length", "first", "sequence", "apart", "copies", "offset"), table.T.copy(), strict=True))


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every document; ``options`` are those
    of the search."""
    pieces = pieces_of(docs, path, capacity, end_id).withColumn("_deal", F.monotonically_increasing_id())
    out = pack(stash(pieces, "pieces"), capacity, "_deal", **options)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")
