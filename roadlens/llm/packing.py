"""Packing documents into training sequences: first-fit decreasing over a tournament tree.

Texts are tokenized in Arrow batches.  A document longer than a sequence is cut into full sequences
and a tail; everything after that works on (doc_id, start, length) rows only, never on texts.  The
pieces are dealt to randomised groups by a hash of document id, start and content, so rows that share a
null or repeated id spread over all groups (only equal pieces meet); in each group the pieces are taken in decreasing length and each goes to the first open bin with room.  A tournament tree over the
bins' free capacities (every inner node holds the larger of its children) finds that bin in log n
steps.  Groups are independent tasks of a bounded expected size, so the work grows with the rows and
a lost executor repeats only its groups.

Defined results: a null or empty text is the end token alone; a piece's place depends on doc_id,
start, length and content only, so repeated rows of one document are told apart by their order alone
and reruns agree; a null doc_id is dealt like any other value; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

END_ID = 1


LETTER, DIGIT, SIGN, ODD = 1, 2, 3, 4
_KIND = np.full(256, ODD, dtype=np.uint8)
_KIND[33:127] = SIGN
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[[39, 60]] = ODD  # apostrophes start contractions, angle brackets the special tokens


class Tokenizer:
    """Token ids of texts, with a bounded memory of part -> ids.

    The tokenizer file lower-cases, splits at white space and then into runs of letters, single digits and
    runs of other signs, each encoded by itself.  Words of ASCII and Latin-1 letters are split so by byte
    classes for a whole chunk at once; any other word is one part, left to the tokenizer.  Each different
    part is encoded once while it is remembered, and ids are gathered by array operations.
    """

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only spin
        from tokenizers import Tokenizer as Fast

        self.fast, self.remember = Fast.from_file(path), remember
        vocab = self.fast.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that end a part
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # sorted part hashes and their numbers: a quarter of the memory of a dict
        self.names, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _encode_parts(self, parts: list[str], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of ids of each)."""
        if not odd:
            ids = np.array(self.fast.encode("\n".join(parts), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(parts) and stops[-1] == len(ids):
                return ids, np.diff(stops, prepend=0)
        each = [e.ids for e in self.fast.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.array([len(x) for x in each], dtype=np.int64)
        return np.array([i for x in each for i in x], dtype="<u4"), size

    def _learn(self, first: int, parts: list[str], odd: bool) -> None:
        """Encode parts and keep their ids under the numbers from ``first`` on."""
        for at in range(0, len(parts), 20_000):
            ids, size = self._encode_parts(parts[at:at + 20_000], odd)
            n = len(size)
            while first + n > len(self.start):
                self.start, self.size = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[self.used:self.used + len(ids)] = ids
            self.start[first:first + n] = self.used + np.cumsum(size) - size
            self.size[first:first + n] = size
            self.used += len(ids)
            first += n

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before the end of each word) of the words in a chunk of bytes."""
        n = len(data)
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):  # two bytes of a Latin-1 letter, except the multiplication and division signs
            lead = lead[(lead + 1 < n)]
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
        low = C.LOWER[data]
        if len(lead):
            upper = lead[(data[lead + 1] < 0x9F)] + 1
            low[upper] += 32
        strange = np.append(0, np.cumsum(kind == ODD))
        odd_word = strange[ends] > strange[starts]
        opens = np.zeros(n, dtype=bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        opens[starts] = True
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        opens &= np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        if odd_word.any():  # left whole, and as they are
            mask = np.zeros(n + 1, dtype=np.int8)
            mask[starts[odd_word]] += 1
            mask[ends[odd_word]] -= 1
            mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
            low[mask] = data[mask]
            opens[mask] = False
            opens[starts[odd_word]] = True
        at = np.flatnonzero(opens)
        word = np.searchsorted(starts, at, side="right") - 1
        to = np.append(at[1:], n)
        to = np.minimum(to, ends[word])
        names = C.span_names(low, at, to) ^ (odd_word[word].astype(np.uint64) << np.uint64(63))
        kinds, spot, inverse = np.unique(names, return_index=True, return_inverse=True)
        place = np.searchsorted(self.names, kinds)
        new = np.ones(len(kinds), dtype=bool)
        held = place < len(self.names)
        new[held] = self.names[place[held]] != kinds[held]
        if new.any():
            blob, odd = data.tobytes(), odd_word[word[spot]]
            number, first = np.zeros(len(kinds), dtype=np.int64), len(self.names)
            for group, is_odd in ((np.flatnonzero(new & ~odd), False), (np.flatnonzero(new & odd), True)):
                if len(group):
                    number[group] = np.arange(first, first + len(group))
                    self._learn(first, [blob[at[j]:to[j]].decode() for j in spot[group]], is_odd)
                    first += len(group)
            self.number = np.insert(self.number, place[new], number[new])
            self.names = np.insert(self.names, place[new], kinds[new])
        known = self.number[np.searchsorted(self.names, kinds)][inverse]
        size = self.size[known]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.start[known] - (stop - size), size)]
        done = np.append(0, stop)[np.searchsorted(word, np.arange(len(starts)), side="right")]
        return flat, done

    def encode(self, texts: pa.Array):
        """Yield (row, ids of its text)."""
        for first, bounds, _, starts, ends, data in C.text_words(texts):
            if len(self.names) > self.remember:
                self._forget()
            flats, stops, base = [], [np.zeros(1, dtype=np.int64)], 0
            cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)), len(starts)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                lo, hi = starts[a], ends[b - 1]
                flat, done = self._ids(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
                flats.append(flat)
                stops.append(done + base)
                base += len(flat)
            flat = np.concatenate(flats) if flats else np.zeros(0, dtype="<u4")
            edge = np.concatenate(stops)[bounds]
            for row, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                yield first + row, flat[a:b]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a Python worker, kept over its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def narrowed(ids: np.ndarray) -> bytes:
    """A piece's ids as they travel: two bytes each where that holds them all."""
    return (ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids).tobytes()


def widened(ids, sizes) -> pa.Array:
    """The ids of pieces (``sizes`` counts them) as four bytes each, however they travelled."""
    return pa.array([np.frombuffer(x, dtype="<u2").astype("<u4").tobytes() if len(x) == 2 * n else x
                     for x, n in zip((i.as_py() for i in ids), sizes)], type=pa.binary())


def pieces(docs: DataFrame, path: str, length: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) cut at multiples of ``length``; ids as ``narrowed`` gives them."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([END_ID], dtype="<u4")

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), [[] for _ in range(6)]

            def flush():
                cols = [pa.array(c, type=pa.int64()) for c in rows[:5]] + [pa.array(rows[5], type=pa.binary())] * with_ids
                for c in rows:
                    c.clear()
                return pa.RecordBatch.from_arrays(cols, names)

            for row, found in tok.encode(batch.column(1)):
                whole = np.concatenate([found, end])
                n = len(whole)
                for start in range(0, n, length):
                    part = whole[start:start + length]
                    for col, v in zip(rows, (ids[row], start, len(part), zlib.crc32(part.tobytes()), n, narrowed(part) if with_ids else b"")):
                        col.append(v)
                if len(rows[0]) >= 2_000:
                    yield flush()
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Bins:
    """Bins of equal capacity; ``put`` places an item in the first bin with room, by a tournament tree."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.tree, self.used = capacity, 1, [0, capacity], 1

    def _grow(self) -> None:
        old = self.tree[self.leaves:]
        self.leaves *= 2
        self.tree = [0] * self.leaves + old + [self.capacity] * (self.leaves - len(old))
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the item."""
        while self.tree[1] < size:
            self._grow()
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        bin_, offset = i - self.leaves, self.capacity - tree[i]
        tree[i] -= size
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return bin_, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of the items, taken in decreasing size (ties: as given)."""
    bins, order = Bins(capacity), np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    full = sizes[order] == capacity  # a full piece has a bin of its own and can be placed without a search
    n_full = int(full.sum())
    where[order[:n_full]] = np.arange(n_full)
    for i in order[n_full:]:
        b, offset[i] = bins.put(int(sizes[i]))
        where[i] = b + n_full
    return where, offset


#: Sequence ids are group * 2**24 + bin; a group holds far fewer bins (see ``group_docs``).
GROUP_SPAN = 1 << 24


def place(rows: DataFrame, length: int, group_docs: int) -> DataFrame:
    """Add sequence_id and offset to the piece rows (any columns besides doc_id, start, length)."""
    n = rows.count()
    groups = max(1, -(-n // group_docs))
    cols = rows.columns
    # pieces are dealt by the number of their written row, so equal pieces (copies, empty texts) are spread like others
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(29), F.monotonically_increasing_id()), F.lit(groups)))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32") if c in cols]).to_numpy()
        sizes = table.column("length").to_numpy()
        where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        where[order], offset[order] = first_fit_decreasing(sizes[order], length)  # the rows, with their ids, stay where they are
        group = table.column("_group")[0].as_py()
        out = table.select(cols)
        if "ids" in cols:
            out = out.set_column(cols.index("ids"), "ids", widened(table.column("ids"), sizes))
        return out.append_column("sequence_id", pa.array(group * GROUP_SPAN + where)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = 2048, group_docs: int = 20_000, with_ids: bool = True) -> DataFrame:
    """One row per piece with its place; ``with_ids`` also returns the piece's ids (little-endian uint32)."""
    return place(C.saved(pieces(docs, path, length, with_ids), "pieces"), length, group_docs)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens): the packed pieces joined in order, not padded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
