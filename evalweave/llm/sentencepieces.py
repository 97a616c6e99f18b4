"""SentencePiece encoding and decoding with batched numpy Viterbi.

The model is a SentencePiece BPE vocabulary with byte fallback. A text is cut
where no piece can cross (before each word mark, around characters that no piece
holds); the distinct words of a batch are encoded once, all words together,
longest first, so that those that reach a position stand in front. At every
position of the words, each substring that ends there is hashed and looked for
among the sorted piece keys, and the best candidate's start is stored as a back
pointer.

A Viterbi path of greatest summed score isn't what a BPE model encodes to, so
the lattice has the one constraint that makes it so: a piece may follow another
only if the merges of BPE would leave a boundary between them (checked through
the pieces' own merge trees). The path that remains is the BPE encoding; tests
hold it against the library.

Cases: a null text has null ids and a null decoded text; an empty text has no
ids; characters outside the vocabulary become byte pieces, and come back;
U+2581 in a text is the word mark itself and comes back as a space, as in the
library; an empty table gives an empty result; rows that repeat are encoded
alike.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .kernels import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text is worked on in parts of about so many bytes, whole documents each.
PART_BYTES = 1 << 20
#: Words kept from part to part; when there are more, the later half is forgotten.
KEEP_WORDS = 1 << 17

#: Characters of a word from which on it is encoded by itself: few words share such a length, and its own substrings fill the arrays.
LONG_WORD = 256
#: Answers about pairs of pieces that are kept for long words.
_MOST_PAIRS = 1 << 18

#: Characters of words that are encoded together.
_TOGETHER = 1 << 18

HEAD_BITS = 20
#: Slots of the table of answers about pairs of pieces; it is overwritten, not grown.
PAIR_BITS = 18

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash_codes(codes: np.ndarray) -> int:
    h = 0
    for c in codes:
        h = (h * int(_BASE) + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """The vocabulary's tables: bounded by its size, never by the data."""

    def __init__(self, texts: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, special: set[int]):
        n = len(texts)
        self.unknown, self.byte_id = unknown, np.full(256, unknown, dtype=np.int32)
        for b, i in byte_ids.items():
            self.byte_id[b] = i
        normal = [i for i in range(n) if i not in special and i not in byte_ids.values()]
        self.space_runs = {len(texts[i]): i for i in normal if set(texts[i]) == {MARK}}
        single = {texts[i]: i for i in normal if len(texts[i]) == 1}
        self.single = single
        merged = [i for i in normal if len(texts[i]) > 1 and set(texts[i]) != {MARK}]
        merged.sort(key=lambda i: (-scores[i], i))
        # Ranks: characters first, then pieces as BPE would merge them.
        rank_text = [texts[i] for i in single.values()] + [texts[i] for i in merged]
        rank_id = list(single.values()) + merged
        by_text = {t: r for r, t in enumerate(rank_text)}
        self.chars = len(single)
        left, right, reachable = np.arange(len(rank_text)), np.arange(len(rank_text)), np.ones(len(rank_text), dtype=bool)
        for r in range(self.chars, len(rank_text)):
            parts = [by_text.get(c, -1) for c in rank_text[r]]
            while len(parts) > 2:
                joined = [by_text.get(rank_text[a] + rank_text[b], 1 << 40) if a >= 0 and b >= 0 else 1 << 40 for a, b in zip(parts, parts[1:], strict=False)]
                best = min(range(len(joined)), key=lambda k: (joined[k] < self.chars, joined[k]))
                if joined[best] >= 1 << 40:
                    break
                parts[best : best + 2] = [joined[best]]
            if len(parts) == 2 and min(parts) >= 0:
                left[r], right[r] = parts
            else:
                reachable[r] = False
        self.left, self.right = left, right
        self.rank_id = np.array(rank_id, dtype=np.int32)
        self.rank_len = np.array([len(t) for t in rank_text], dtype=np.int64)
        self.rank_hash = np.array([_hash_codes([ord(c) for c in t]) for t in rank_text], dtype=np.uint64)
        usable = np.flatnonzero(reachable)
        order = np.argsort(self.rank_hash[usable], kind="stable")
        self.key_rank = usable[order]
        self.keys = self.rank_hash[self.key_rank]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.heads = np.zeros(1 << HEAD_BITS, dtype=bool)
        self.heads[(self.keys >> np.uint64(64 - HEAD_BITS)).astype(np.int64)] = True
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.longest = int(self.rank_len.max(initial=1))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]), dtype=np.uint64)
        # Characters that stand alone in any encoding cut the text into shorter words.
        inside = {c for i in merged for c in texts[i]}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        body = f"[^{MARK}{re.escape(alone)}]"
        self.cut = re.compile(f"{MARK}*{body}+|{MARK}+|[{re.escape(alone)}]" if alone else f"{MARK}*{body}+|{MARK}+")
        decoded = []
        for i, t in enumerate(texts):
            decoded.append(b"" if i in special and i != unknown else " ⁇ ".encode() if i == unknown else t.replace(MARK, " ").encode())
        for b, i in byte_ids.items():
            decoded[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(decoded), dtype=np.uint8)
        self.out_len = np.array([len(x) for x in decoded], dtype=np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)])[:-1]
        known = np.array(sorted(ord(c) for c in single), dtype=np.int64)
        self.char_codes, self.char_rank = known, np.array([by_text[chr(c)] for c in known], dtype=np.int64)

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(p.get_piece_size())
        texts = [p.id_to_piece(i) for i in ids]
        byte_ids = {int(texts[i][3:5], 16): i for i in ids if p.is_byte(i)}
        special = {i for i in ids if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        return cls(texts, [p.get_score(i) for i in ids], byte_ids, p.unk_id(), special)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Rank of the piece with each hash; -1 for none. A bit table of the keys' heads spares most searches."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.heads[(h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)])
        some = h[maybe]
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        out[maybe] = np.where(self.keys[at] == some, self.key_rank[at], -1)
        return out

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a boundary between two pieces (ranks; below 0: a character outside the vocabulary)."""
        pair = (first << 20) | second
        slot = ((pair.view(np.uint64) * _BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero((self.pair_key[slot] != pair) & (first >= 0) & (second >= 0))
        ok[(first < 0) | (second < 0)] = True
        if len(new):
            ok[new] = self._boundary(first[new], second[new])
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = pair[new], ok[new]
        return ok

    def _boundary(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        limit = np.full(len(at), 1 << 40)
        while len(at):
            together = self.rank_len[a] + self.rank_len[b]
            h = self.rank_hash[a] * self.power[np.minimum(self.rank_len[b], self.longest)] + self.rank_hash[b]
            joined = np.where(together <= self.longest, self.probe(h), -1)
            bad = (joined >= 0) & (joined < limit)
            ok[at[bad]] = False
            go = ~bad
            # The later of the two merges is undone first; what it gives at the boundary may merge until then.
            undo_a = a > b
            la, lb = np.where(undo_a, a, limit), b + 1
            next_a = np.where(undo_a, self.right[a], a)
            next_b = np.where(undo_a, b, self.left[b])
            limit = np.where(undo_a, la, lb)
            whole_a, whole_b = undo_a & (next_a == a), ~undo_a & (next_b == b)
            # A character can't be undone: then it is the other's turn.
            turn_b = np.where(whole_a, self.left[b], next_b)
            turn_a = np.where(whole_b, self.right[a], next_a)
            limit = np.where(whole_a, b + 1, np.where(whole_b, a, limit))
            end = (whole_a & (turn_b == b)) | (whole_b & (turn_a == a))
            go &= ~end
            a, b, at, limit = turn_a[go], turn_b[go], at[go], limit[go]
        return ok

    def _encode_together(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: the characters of all words, one word after the other; lengths: descending. Flat ids, and the number of ids of each word."""
        n, longest = len(lengths), int(lengths[0])
        at = np.searchsorted(self.char_codes, codes)
        at[at == len(self.char_codes)] = 0
        char_rank = np.where(self.char_codes[at] == codes, self.char_rank[at], -1)
        begin = np.cumsum(lengths) - lengths
        # Position i of word k is at row[i] + k: of each position there are as many as words that reach it, the first ones.
        reach = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")
        row = np.cumsum(reach) - reach
        size = int(reach.sum())
        prefix, last, back = np.zeros(size, dtype=np.uint64), np.full(size, -2, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for i in range(1, longest + 1):
            m, here, before = int(reach[i]), int(row[i]), int(row[i - 1])
            place = begin[:m] + (i - 1)
            prefix[here : here + m] = prefix[before : before + m] * _BASE + codes[place].astype(np.uint64) + np.uint64(1)
            # The character itself, which may be outside the vocabulary.
            lone = char_rank[place]
            ok = np.ones(m, dtype=bool) if i == 1 else self.may_follow(last[before : before + m], lone)
            last[here : here + m][ok], back[here : here + m][ok] = lone[ok], i - 1
            # Exactly one piece may end here, so a word that has its piece is done.
            open_ = np.flatnonzero(~ok)
            for width in range(2, min(i, self.longest) + 1):
                if not len(open_):
                    break
                j = i - width
                rank = self.probe(prefix[here + open_] - prefix[row[j] + open_] * self.power[width])
                hit = np.flatnonzero(rank >= 0)
                hit = hit[self.rank_len[rank[hit]] == width]
                if j:
                    hit = hit[self.may_follow(last[row[j] + open_[hit]], rank[hit])]
                if len(hit):
                    word = here + open_[hit]
                    last[word], back[word] = rank[hit], j
                    still = np.ones(len(open_), dtype=bool)
                    still[hit] = False
                    open_ = open_[still]
        # Walk all back pointers at once, last piece first.
        ends, steps, live = lengths.copy(), [], np.arange(n)
        while len(live):
            i = ends[live]
            cell = row[i] + live
            steps.append((live, last[cell], i))
            ends[live] = back[cell]
            live = live[ends[live] > 0]
        word = np.concatenate([s[0] for s in steps])
        rank = np.concatenate([s[1] for s in steps])
        end = np.concatenate([s[2] for s in steps])
        order = np.lexsort((end, word))
        word, rank, end = word[order], rank[order], end[order]
        ids = np.where(rank >= 0, self.rank_id[np.maximum(rank, 0)], -1)
        outside = np.flatnonzero(ids < 0)
        if len(outside):
            spelled = [self.byte_id[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in codes[begin[word[outside]] + end[outside] - 1].tolist()]
            size_of = np.ones(len(ids), dtype=np.int64)
            size_of[outside] = [len(x) for x in spelled]
            flat = np.repeat(ids, size_of)
            flat[np.repeat(ids < 0, size_of)] = np.concatenate(spelled)
            return flat.astype(np.int32), np.bincount(np.repeat(word, size_of), minlength=n)
        return ids.astype(np.int32), np.bincount(word, minlength=n)

    def _encode_long(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long word (a text without spaces): all its substrings are probed at once, width by width, and the back pointers follow one by one."""
        length = len(codes)
        at = np.searchsorted(self.char_codes, codes)
        at[at == len(self.char_codes)] = 0
        lone = np.where(self.char_codes[at] == codes, self.char_rank[at], -1)
        power = np.full(length + 1, _BASE, dtype=np.uint64)
        inverse = np.full(length + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        power[0] = inverse[0] = 1
        power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        prefix = np.zeros(length + 1, dtype=np.uint64)
        prefix[1:] = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * inverse[1:]) * power[1:]
        ends, widths, ranks = [np.arange(1, length + 1)], [np.ones(length, np.int64)], [lone]
        for width in range(2, min(length, self.longest) + 1):
            rank = self.probe(prefix[width:] - prefix[:-width] * self.power[width])
            hit = np.flatnonzero(rank >= 0)
            hit = hit[self.rank_len[rank[hit]] == width]
            ends.append(hit + width)
            widths.append(np.full(len(hit), width))
            ranks.append(rank[hit])
        end, width, rank = (np.concatenate(x) for x in (ends, widths, ranks))
        order = np.lexsort((width, end))
        end, width, rank = end[order].tolist(), width[order].tolist(), rank[order].tolist()
        last, back = [-2] * (length + 1), [0] * (length + 1)
        done = 0
        for i, w, r in zip(end, width, rank, strict=True):
            # Exactly one piece may end at a place.
            if i > done and (i == w or self._may_follow_one(last[i - w], r)):
                last[i], back[i], done = r, i - w, i
        out = []
        i = length
        while i:
            out.append((last[i], i))
            i = back[i]
        out.reverse()
        flat: list[int] = []
        for r, i in out:
            flat += [int(self.rank_id[r])] if r >= 0 else self.byte_id[np.frombuffer(chr(int(codes[i - 1])).encode("utf-8", "surrogatepass"), dtype=np.uint8)].tolist()
        return np.array(flat, dtype=np.int32)

    def _may_follow_one(self, first: int, second: int) -> bool:
        if first < 0 or second < 0:
            return True
        pair = (first, second)
        if pair not in self.pairs:
            if len(self.pairs) >= _MOST_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = bool(self._boundary(np.array([first]), np.array([second]))[0])
        return self.pairs[pair]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and for each word where its ids begin and how many there are. A word may begin with several marks."""
        n = len(words)
        at, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        flat: list[np.ndarray] = []
        total = 0

        def place(k: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal total
            at[k], size[k] = total + np.cumsum(sizes) - sizes, sizes
            flat.append(ids)
            total += len(ids)

        double = MARK + MARK
        spaced = [k for k, w in enumerate(words) if w.startswith(double) or w == MARK]
        # Of several marks the last one may join the word, which is encoded with it; nothing is left of marks alone.
        body = list(words)
        for k in spaced:
            rest = words[k].lstrip(MARK)
            body[k] = MARK + rest if rest else ""
        length = np.fromiter(map(len, body), dtype=np.int64, count=n)
        for k in np.flatnonzero(length > LONG_WORD):
            ids = self._encode_long(np.frombuffer(body[k].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64))
            place(np.array([k]), ids, np.array([len(ids)]))
        short = np.flatnonzero((length > 0) & (length <= LONG_WORD))
        short = short[np.argsort(-length[short], kind="stable")]
        cut = (np.cumsum(length[short]) - 1) // _TOGETHER
        for some in np.split(short, np.flatnonzero(np.diff(cut)) + 1) if len(short) else []:
            codes = np.frombuffer("".join([body[k] for k in some.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            place(some, *self._encode_together(codes, length[some]))
        if spaced:
            mark, found = self.single.get(MARK, self.unknown), np.concatenate(flat) if flat else np.zeros(0, np.int32)
            for k in spaced:
                ids, runs = found[at[k] : at[k] + size[k]], len(words[k]) - max(0, int(length[k]) - 1)
                # Where BPE doesn't have the last mark join the word, all marks stand together.
                alone = len(ids) == 0 or ids[0] == mark
                ids = np.concatenate([self._space_ids(runs - (not alone)), ids[1:] if alone else ids])
                place(np.array([k]), ids, np.array([len(ids)]))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), at, size

    def _space_ids(self, n: int) -> np.ndarray:
        """A run of n marks: pieces of marks have one score, so the leftmost pair that makes a piece merges first."""
        size: list[int] = []
        for _ in range(n):
            size.append(1)
            while len(size) > 1 and size[-2] + size[-1] in self.space_runs:
                size[-2:] = [size[-2] + size[-1]]
        return np.array([self.space_runs[k] for k in size], dtype=np.int32)


class Encoder:
    """Encodes parts of a column, keeping the words it knows."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self, keep: int = 0) -> None:
        """Forgets all words but the first ones, which are mostly the frequent ones."""
        kept = list(itertools.islice(self.known.items(), keep)) if keep else []
        #: A word that isn't known gets the next number by being asked for.
        self.known: defaultdict[str, int] = defaultdict(itertools.count(len(kept)).__next__, kept)
        if keep:
            self.at, self.size = self.at[:keep], self.size[:keep]
            end = int((self.at + self.size).max())
            self.ids = self.ids[:end].copy()
        else:
            self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the number of ids of each."""
        if len(self.known) > KEEP_WORDS:
            self._forget(KEEP_WORDS // 2)
        known, cut = self.known, self.pieces.cut.findall
        before = len(known)
        units: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                here = cut(MARK + t.replace(" ", MARK))
                units += here
                counts[k] = len(here)
        unit = np.fromiter(map(known.__getitem__, units), dtype=np.int64, count=len(units))
        if len(known) > before:
            new = list(itertools.islice(known, before, None))
            ids, starts, sizes = self.pieces.encode_words(new)
            self.at = np.concatenate([self.at, len(self.ids) + starts])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, sizes])
        sizes = self.size[unit]
        flat = self.ids[np.repeat(self.at[unit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(upto[ends])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the decoded texts, and the number of bytes of each; the mark that encoding adds goes."""
        p = self.pieces
        size = p.out_len[flat]
        ends = np.cumsum(size)
        data = p.out_bytes[np.repeat(p.out_at[flat] - (ends - size), size) + np.arange(int(size.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        length = np.diff(upto)
        lead = np.zeros(len(data), dtype=bool)
        first = upto[:-1][length > 0]
        lead[first] = data[first] == 32
        length = length.copy()
        length[np.flatnonzero(length > 0)] -= lead[first]
        return data[~lead], length


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about PART_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART_BYTES)) + 1
        yield lo, min(hi, len(column))
        lo = hi


_encoders: dict[str, Encoder] = {}


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded: the ids of every text, and the text that they decode to."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker process keeps its encoder, and the words that it knows, from task to task.
        if model not in _encoders:
            _encoders[model] = Encoder(pieces.value)
        encoder = _encoders[model]
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                flat, counts = encoder.encode(texts)
                data, sizes = encoder.decode(flat, counts)
                null = np.array([t is None for t in texts])
                mask = pa.array(null)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=mask)
                valid = np.packbits(~null, bitorder="little") if null.any() else None
                text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)), pa.py_buffer(valid) if valid is not None else None, int(null.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, mask=null), ids, text], names=["doc_id", "n_tokens", "token_ids", "decoded"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
