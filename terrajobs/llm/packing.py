"""Token sequences packed into windows, with a certificate for each partition's bin count.

Documents are dealt into partitions of bounded size and packed best-fit decreasing. Dual
feasible functions give a lower bound on the bins any packing of a partition needs; where
the count equals it, the partition is optimal. Partitions with a gap give up the documents
of their emptiest bins, the others those of their last bin that is not full; these are dealt
anew and packed again, and the new packing replaces the old one if it uses fewer bins.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches
from terrajobs.storage import discard, stash

CAPACITY = 4096
END_ID = 1
ITEMS = 1500
TEXT_BYTES = 1 << 18  # of texts encoded at a time, about
SLOT_BITS = 20  # of the table of pieces met, a piece a slot
SHORT = 16  # bytes of the pieces that have slots
STORE = 1 << 22  # ids held for them
TAIL = 4  # bytes of the punctuation that is cut from a word, at most
_MARKS = b".,;:!?|*#$%&()-+="
_NOT_LETTERS = re.compile(r"[\W\d_]")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # of ASCII and Latin-1
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_IS_MARK, _IS_ALNUM, _IS_LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_IS_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_IS_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True  # after 0xC3


def _cut_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words, with a few last marks after a letter or digit as pieces of their own."""
    which = np.flatnonzero(_IS_MARK[data[end - 1]])
    cut = end[which] - 1
    for _ in range(TAIL - 1):
        cut -= (cut > start[which]) & _IS_MARK[data[cut - 1]]
    before = data[cut - 1]
    good = (cut > start[which]) & (_IS_ALNUM[before] | _IS_LATIN[before] & (data[cut - 2] == 0xC3) & (cut > start[which] + 1))
    which, cut = which[good], cut[good]
    return np.insert(start, which + 1, cut), np.insert(end, which, cut), first + np.searchsorted(which, first)


class WordIds:
    """Token ids (little-endian 32-bit) of texts, by pieces of words that are encoded once.

    The tokenizer splits at white space before anything else and drops it, so the ids of a
    text are those of its words in order; words are cut at ASCII white space only. It then
    lowers case and splits letters from other characters, so a word's case and its trailing
    punctuation need no entries of their own. Words with "<" may hold special tokens and are
    encoded as they are; those end with ">", which no cut piece begins or ends with.

    All pieces of some texts are looked up at once in a table of short ones with a slot for
    each hash; it holds the pieces' bytes and lengths, so what it finds is exact. The others,
    those whose slot another piece took included, are encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.head, self.rest = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.length, self.count, self.at = np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(1 << SLOT_BITS, np.uint32)
        self.store, self.held = np.zeros(1 << 16, "<u4"), 0

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, each by itself. Those of one token piece are encoded
        together and told apart by the tokens that end a piece."""
        plain, odd = [], []
        for k, w in enumerate(words):
            one = w.isalpha() or _LETTERS.fullmatch(w) or not w.strip(_MARKS) or not _NOT_LETTERS.search(w.decode())
            (plain if one else odd).append(k)
        out: list[bytes] = [b""] * len(words)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([words[k] for k in plain]).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                for k, a, b in zip(plain, at, at[1:], strict=False):
                    out[k] = data[a:b]
            else:
                odd = odd + plain
        if odd:
            encoded = self.tokenizer.encode_batch_fast([words[k].decode() for k in odd], add_special_tokens=False)
            for k, e in zip(odd, encoded, strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def _put(self, ids: list[bytes]) -> np.ndarray:
        """Where the ids of words begin in the store, put there one after the other."""
        new = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = self.held + np.cumsum(sizes) - sizes
        if self.held + len(new) > len(self.store):
            self.store = np.concatenate([self.store[: self.held], np.zeros(self.held + 2 * len(new), "<u4")])
        self.store[self.held : self.held + len(new)] = new
        self.held += len(new)
        return at

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.held > STORE:
            self.length[:], self.held = 0, 0
        texts = [t if b"<" in t else t.lower() for t in texts]
        whole = b" ".join([*texts, bytes(SHORT)])
        data = np.frombuffer(whole, np.uint8)[:-SHORT]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        start, end, first = B.words(data, np.concatenate([[0], np.cumsum(sizes)]))
        if not len(start):
            return [b""] * len(texts)
        start, end, first = _cut_marks(data, start, end, first)
        length = end - start
        eight = np.ndarray(len(whole) - 7, "<u8", whole, 0, (1,))  # the eight bytes from each place
        head = eight[start] & _FIRST_BYTES[np.minimum(length, 8)]
        rest = eight[start + 8] & _FIRST_BYTES[np.clip(length - 8, 0, 8)]
        slot = (B.mix(head ^ B.mix(rest)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        count, at = self.count[slot].astype(np.int64), self.at[slot].astype(np.int64)
        miss = np.flatnonzero((self.length[slot] != length) | (self.head[slot] != head) | (self.rest[slot] != rest))
        if len(miss):
            words = [whole[s:e] for s, e in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids = self._ids(list(number))
            own, sizes = self._put(ids), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            at[miss], count[miss] = own[which], sizes[which]
            short = miss[(length[miss] <= SHORT) & (count[miss] < 256)]
            _, once = np.unique(slot[short], return_index=True)
            short = short[once]
            s = slot[short]
            self.head[s], self.rest[s], self.length[s], self.count[s], self.at[s] = head[short], rest[short], length[short], count[short], at[short]
        ends = np.cumsum(count)
        ids = self.store[np.repeat(at - ends + count, count) + np.arange(ends[-1])].tobytes()
        cuts = (np.concatenate([[0], ends])[first] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _portions(texts: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, own): the documents' token pieces.

    ``own`` is a sequence number for pieces that fill a window alone, else null. A null or
    empty text has the end id alone. Only documents longer than a window are cut.
    """
    end, portion = np.array([END_ID], "<u4").tobytes(), TEXT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer_path)  # goes with the task, so a reused worker does not keep it
        alone = -1 - (TaskContext.get().partitionId() << 36)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            docs = iter(batch.column("doc_id").to_pylist())
            for texts in _portions((t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())), portion):
                for ids, doc in zip(ids_of(texts), docs, strict=False):  # ids first: zip would else take a doc of the next portion
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        full = len(part) == 4 * capacity
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), alone if full else None), strict=True):
                            column.append(value)
                        alone -= full
            if next(docs, end) is not end:
                raise AssertionError("a document was given no token ids")
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "own"])

    return small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        released(run), "doc_id long, piece int, start long, length long, ids_crc32 long, own long"
    )


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of several dual feasible functions, in integers."""
    size, count = np.unique(lengths.astype(np.int64), return_counts=True)
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    for eps in {int(s) for s in size[size * 2 <= capacity]}:  # over 1 - eps counts whole, under eps nothing
        scaled = np.where(size > capacity - eps, capacity, np.where(size < eps, 0, size))
        best = max(best, -(-int((scaled * count).sum()) // capacity))
    for k in range(1, 21):  # rounded down to multiples of 1/k, but for multiples of 1/(k+1)
        whole, rest = np.divmod((k + 1) * size, capacity)
        kept = rest == 0
        total = int((size * count)[kept].sum()) * k + int((whole * count)[~kept].sum()) * capacity
        best = max(best, -(-total // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, packed best-fit decreasing."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > need:
            open_by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins, offsets


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, bins long, bound long, again boolean"


def _pack_round(items: DataFrame, n: int, turn: int, capacity: int, items_each: int) -> DataFrame:
    buckets = max(1, -(-n // items_each))

    def run(pdf):  # noqa: ANN001, ANN202  pandas is loaded by its workers only
        import pandas as pd

        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        count, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        again = np.zeros(count, bool)
        if count > bound:
            fill = np.bincount(bins, weights=lengths, minlength=count)
            again[np.argsort(fill, kind="stable")[: 8 * (count - bound + 1)]] = True
        elif lengths.sum() < count * capacity:  # the bound holds for this partition only: its emptiest bin joins the others'
            again[np.argmin(np.bincount(bins, weights=lengths, minlength=count))] = True
        return pd.DataFrame(
            {
                **{c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": (turn << 56) + (int(pdf["bucket"].iloc[0]) << 20) + bins,
                "offset": offsets,
                "bins": count,
                "bound": bound,
                "again": again[bins],
            }
        )

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(buckets)).alias("bucket")
    return items.select("doc_id", "piece", "start", "length", "ids_crc32", bucket).groupBy("bucket").applyInPandas(run, _PACKED)


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, rounds: int = 5, items_each: int = ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound) for every piece.

    ``bins`` and ``bound`` are the bin count of the partition that the piece was last packed
    in and the certified least one, bins given up since included; 1 and 1 for a piece that
    fills a window alone.
    Pieces of one sequence lie gapless from offset 0. Null and empty texts give one piece
    of length 1; repeated rows are packed as often as they occur; other columns are not
    read. An empty table gives an empty result.
    """
    cut = stash(pieces(documents, tokenizer_path, capacity, id_col, text_col), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"]
    one = F.lit(1).cast("long")
    done = [cut.filter("own is not null").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))]
    rest = cut.filter("own is null")
    n = rest.count()
    now = stash(_pack_round(rest, n, 0, capacity, items_each), "packed") if n else None
    for turn in range(1, rounds + 1):
        if now is None:
            break
        pool = now.filter("again")
        n, before = pool.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if not n:
            break
        new = stash(_pack_round(pool, n, turn, capacity, items_each), "packed")
        if new.filter("offset = 0").count() >= before:
            discard(new)
            break
        done.append(now.filter("not again").select(columns))
        now = new
    if now is not None:
        done.append(now.select(columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
