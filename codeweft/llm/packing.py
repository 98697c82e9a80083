"""Best-fit packing of token sequences by bin completion on the histogram of lengths.

The pieces stay distributed. Only their histogram (at most `capacity` rows whatever the input) reaches the driver, where
bin completion decides how many sequences of each composition to build; pieces then find their place by their exact rank
among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import bucketed_rank, cut, map_texts, without

#: Distinct strings between spaces whose ids a worker keeps in each of two generations: when the young one is full it
#: becomes the old one, and what is met again comes back. Longer strings are not kept.
TABLE_SIZE, LONGEST = 350_000, 200
#: Characters of text whose words are looked up together, texts given out together, and new strings encoded together.
CHUNK, ROWS, NEW = 4 << 20, 2048, 10_000
#: The search for a better packing than the best known one ends after so many steps, or so many sizes tried while filling bins.
SEARCH_STEPS, PROBES = 3_000, 300_000
#: It also ends within this share of the lower bound: one sequence more in two thousand.
GAP = 0.0005

# The word pattern of the tokenizers whose words are encoded one by one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
_encoders: dict[str, _Encoder] = {}


def _class(kind: str) -> str:
    """Characters of a kind among the plain ones and their lower case, which lies beyond that range for some."""
    return "".join(sorted({c for x in map(chr, range(0x21, 0x250)) for c in (x, *x.lower()) if unicodedata.category(c)[0] == kind}))


class _Encoder:
    """Ids as the library gives them. Texts of plain Latin letters go word by word through a table of known words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        split = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split == _WORDS and not parts.get("post_processor")
        letters, numbers = _class("L"), _class("N")
        # In this range composing changes nothing and lower case is a matter of single characters.
        self.plain = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f\\u2010-\\u2027]*")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.lib.get_vocab_size()
        self.last = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(size)])  # ends a word

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, w: str) -> bool:
        """A known word and known marks after it: their ids follow each other."""
        bare = w.rstrip(".,!?;:%*#$&")
        if len(bare) == len(w) or bare not in self.known or not bare[-1:].isalnum():
            return False
        if (marks := self.known.get(w[len(bare) :])) is None:
            self._learn([w[len(bare) :]])
            marks = self.known[w[len(bare) :]]
        self.known[w] = self.known[bare] + marks
        return True

    def _learn(self, new: list[str]) -> None:
        """Encode strings in one go with spaces between and part the ids where their words end."""
        if not new:
            return
        ids = np.array(self.lib.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        n = np.cumsum([len(self.word.findall(w)) for w in new])
        if len(ends) != n[-1]:  # not the words expected: one by one
            self.known.update(zip(new, self._library(new), strict=True))
            return
        at = 4 * ends[n - 1]
        data = ids.tobytes()
        self.known.update(zip(new, [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True))

    def _table(self, words: list[str]) -> list[bytes]:
        """The ids of distinct strings between spaces, none of them long."""
        known, old = self.known, self.old
        known[""] = b""
        ids = [*map(known.get, words)]
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            known.update({words[i]: old[words[i]] for i in gaps if words[i] in old})
            new = [words[i] for i in gaps if words[i] not in known and not self._parted(words[i])]
            for k in range(0, len(new), NEW):
                self._learn(new[k : k + NEW])
            for i in gaps:
                ids[i] = known[words[i]]
        return ids

    def _by_word(self, texts: list[str]) -> list[bytes | None]:
        """Ids of plain texts: each distinct string is looked up once, and the ids are laid out by their numbers. None: too long a string."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        coded = split.flatten().dictionary_encode()
        words, codes, bounds = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        length = np.fromiter(map(len, words), np.int64, len(words))
        long = length > LONGEST
        ids = self._table(["" if x else w for w, x in zip(words, long.tolist(), strict=True)] if long.any() else words)
        data, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = data[np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], n)] if ends[-1] else data[:0]
        bad = np.add.reduceat(np.append(long[codes], False).astype(np.int64), bounds[:-1]) if long.any() else np.zeros(len(texts))
        return [None if bad[k] else flat[ends[bounds[k]] : ends[bounds[k + 1]]].tobytes() for k in range(len(texts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_word and t and self.plain.fullmatch(t) and not _SPECIAL.search(t)]
        while plain:
            if len(self.known) > TABLE_SIZE:
                self.known, self.old = {}, self.known
            size, part = 0, []
            while plain and (not part or size < CHUNK):
                part.append(plain.pop())
                size += len(texts[part[-1]])
            for i, ids in zip(part, self._by_word([texts[i] for i in part]), strict=True):
                out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._library([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str = "text", end: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (other columns, piece, start, length, ids_crc32[, ids]): a document's ids and `end`, cut every `capacity` ids.

    Null texts count as empty and give one piece with the end id alone. Columns named like the outputs are replaced.
    """
    kind = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    kind += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    docs = without(docs, [n for n, _ in kind])

    def work(texts: list[str]) -> list[list]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        rows = []
        for ids in _encoders[tokenizer].encode(texts):
            ids += end.to_bytes(4, "little")
            parts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
            row = [{"piece": k, "start": k * capacity, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for k, x in enumerate(parts)]
            if with_ids:
                row = [r | {"ids": np.frombuffer(x, "<u4").astype("i4")} for r, x in zip(row, parts, strict=True)]
            rows.append(row)
        return [rows]

    made = map_texts(docs, text, [("__pieces", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kind])))], work, [c for c in docs.columns if c != text], ROWS)
    return made.select("*", F.inline("__pieces")).drop("__pieces")


# --- bin completion -------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Fewest bins possible: for each a, items over C - a stand alone and those from a up share what the larger leave."""
    capacity = len(counts) - 1
    size = counts * np.arange(capacity + 1)
    half, best = capacity // 2, -(-int(size.sum()) // capacity)
    cn, cs = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(size)])
    a = np.arange(1, half + 1)
    large, large_size = cn[capacity - a + 1] - cn[half + 1], cs[capacity - a + 1] - cs[half + 1]
    alone, rest = cn[capacity + 1] - cn[capacity - a + 1], cs[half + 1] - cs[a]
    over = np.maximum(0, -(-(rest - (large * capacity - large_size)) // capacity))
    return max(best, int((alone + large + over).max(initial=0)))


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Compositions (how many bins, lengths in them): the largest item, then again and again the largest that fits."""
    left, out, capacity = counts.copy(), [], len(counts) - 1
    while (sizes := np.flatnonzero(left)).size:
        room, items, taken = capacity, [], {}
        while True:
            fits = sizes[: np.searchsorted(sizes, room, "right")]
            k = len(fits) - 1
            while k >= 0 and left[fits[k]] <= taken.get(int(fits[k]), 0):
                k -= 1
            if k < 0:
                break
            x = int(fits[k])
            items.append(x)
            taken[x] = taken.get(x, 0) + 1
            room -= x
        times = min(int(left[x]) // u for x, u in taken.items())
        for x, u in taken.items():
            left[x] -= times * u
        out.append((times, tuple(items)))
    return out


class _Budget:
    """Sizes that the whole search may still try."""

    def __init__(self, left: int) -> None:
        self.left = left


def fillings(left: np.ndarray, room: int, slack: int, budget: _Budget) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated sets of lengths for the room beside the largest item, one by one: those without waste first, then up to `slack`.

    A set is dominated if a length could still be added, or one in it be exchanged for a longer one that fits: whatever a
    packing does with the dominated set, it does no worse with the other. All are enumerated unless the budget runs out.
    """
    sizes = [int(x) for x in np.flatnonzero(left[: room + 1])]
    have = [int(left[x]) for x in sizes]
    upto = [0, *np.cumsum([x * n for x, n in zip(sizes, have, strict=True)]).tolist()]

    def undominated(items: tuple[tuple[int, int], ...], waste: int) -> bool:
        used = {j: m for j, m in items}
        spare = [x for j, x in enumerate(sizes) if have[j] > used.get(j, 0)]
        if spare and spare[0] <= waste:
            return False
        return not any((k := bisect_right(spare, sizes[j])) < len(spare) and spare[k] <= sizes[j] + waste for j in used)

    def grow(items: tuple[tuple[int, int], ...], free: int, top: int, low: int, high: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        j = min(top, bisect_right(sizes, free) - 1)
        while j >= 0 and free - upto[j + 1] <= high:  # what is left of the smaller ones can fill the room
            for m in range(min(have[j], free // sizes[j]), 0, -1):
                budget.left -= 1
                if budget.left <= 0:
                    return
                yield from grow((*items, (j, m)), free - m * sizes[j], j - 1, low, high)
            j -= 1
        if low <= free <= high and (not free or undominated(items, free)):
            yield free, tuple(sizes[j] for j, m in items for _ in range(m))

    yield from grow((), room, len(sizes) - 1, 0, 0)
    if slack > 0:
        yield from grow((), room, len(sizes) - 1, 1, min(slack, room))


def complete_bins(histogram: dict[int, int], capacity: int, steps: int = SEARCH_STEPS, probes: int = PROBES, gap: float = GAP) -> list[tuple[int, tuple[int, ...]]]:
    """Compositions that use up the histogram in as few bins as found; best fit is the first incumbent.

    Depth first: the largest remaining item takes one of its undominated fillings, as often as the counts and the waste allow,
    then half as often, and so on down to once; a branch ends when the waste so far, or the lower bound of what remains, rules
    out fewer bins than the incumbent has. The search ends at the lower bound, within `gap` of it, or when `steps` or `probes`
    are used up; the best packing found by then stands.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if not counts.any():
        return []
    total, least = sum(int(k) * int(n) for k, n in histogram.items()), lower_bound(counts)
    best, budget = best_fit(counts), _Budget(probes)
    bins = sum(t for t, _ in best)
    left, path, wasted, used = counts.copy(), [], 0, 0

    def options() -> Iterator[tuple[int, int, tuple[int, ...]]]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for waste, filling in fillings(rest, capacity - largest, (bins - 1) * capacity - total - wasted, budget):
            items = (largest, *filling)
            times = min(int(left[x]) // items.count(x) for x in set(items))
            allowed = (bins - 1) * capacity - total - wasted
            times = min(times, allowed // waste) if waste else times
            while times >= 1:
                yield waste, times, items
                times //= 2

    stack = [options()]
    while stack and bins > least + int(gap * least) and steps > 0 and budget.left > 0:
        choice = next(stack[-1], None)
        if choice is None:  # back one step
            stack.pop()
            if path:
                times, items = path.pop()
                for x in items:
                    left[x] += times
                wasted -= times * (capacity - sum(items))
                used -= times
            continue
        steps -= 1
        waste, times, items = choice
        for x in items:
            left[x] -= times
        wasted, used = wasted + times * waste, used + times
        path.append((times, items))
        if not left.any():
            if used < bins:
                best, bins = list(path), used
            stack.append(iter(()))
        else:
            stack.append(options() if used + lower_bound(left) < bins else iter(()))
    return best


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """Add sequence_id and offset: pieces laid end to end in sequences of at most `capacity`, as few as found.

    Equal lengths are dealt by a hash of `order` (default: all columns); rows that tie in it are alike and exchangeable.
    Lengths that are null, under 1 or over `capacity` get null in both. An empty table stays empty.
    """
    pieces = without(pieces, ["sequence_id", "offset"])
    order = order or [c for c in pieces.columns if c != length]
    pieces = cut(pieces.withColumn("__length", F.when(F.col(length).between(1, capacity), F.col(length).cast("long"))))
    histogram = {r[0]: r[1] for r in pieces.groupBy("__length").count().collect()}  # at most capacity + 1 rows
    rows = sum(histogram.values())
    histogram.pop(None, None)
    starts, uses, bases, places = [], [], [], []
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    first = 0
    for times, items in complete_bins(histogram, capacity):
        at = 0
        for x in dict.fromkeys(items):
            u = items.count(x)
            starts.append((x << 44) + used[x])
            uses.append(u)
            bases.append(first)
            places.append(at)
            used[x] += times * u
            at += u * x
        first += times
    # One row for each length in each composition: bounded by the capacity, not by the input.
    by_start = np.argsort(np.array(starts, dtype=np.int64), kind="stable")
    starts, uses, bases, places = (np.array(v, dtype=np.int64)[by_start] for v in (starts, uses, bases, places))
    ranked = bucketed_rank(pieces, ["__length"], order, "__rank", rows)
    schema = T.StructType([*[f for f in ranked.schema if f.name not in ("__length", "__rank")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("__length")
            gone = np.asarray(size.is_null())
            x, r = size.fill_null(0).to_numpy(zero_copy_only=False), batch.column("__rank").to_numpy(zero_copy_only=False)
            row = np.maximum(np.searchsorted(starts, (x << 44) + r, "right") - 1, 0)
            if len(starts):
                k = r - (starts[row] & ((1 << 44) - 1))
                bins, at = bases[row] + k // uses[row], places[row] + k % uses[row] * x
            else:
                bins = at = np.zeros(len(x), dtype=np.int64)
            kept = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins, mask=gone), pa.array(at, mask=gone)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token; repeated rows are packed each; an empty table stays empty; other columns
    are not read.
    """
    return pack(token_pieces(docs.select("doc_id", "text"), tokenizer, capacity), capacity, order=["doc_id", "piece", "ids_crc32"])
