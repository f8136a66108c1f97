"""SentencePiece byte-pair encoding in vectorised merge rounds, and decoding.

The words of a batch are one flat array of symbols. In every round each word finds the pair of lowest rank it has, by a
minimum over its segment, and merges all its leftmost occurrences at once; ranks are looked up anew only beside a merge,
merged symbols are squeezed out, and words without a pair leave the array. The rounds end when no pair is left. Words are
cut before each run of word marks, which no piece has inside, so a word met again is not merged again.

Merging several occurrences at once equals the library's order (lowest rank first, then leftmost) unless a merge makes a
pair of lower rank than its own. The vocabulary shows which symbols can do so; for these a round merges the leftmost only.

Defined results:
* null or empty text: no ids, and decodes to the empty text; repeated rows are encoded each; an empty table stays empty;
* characters outside the vocabulary become their UTF-8 bytes' pieces, as in the library;
* decoding takes any ids of the vocabulary; bytes that are no UTF-8 become U+FFFD one by one; control ids vanish;
* very long texts and very long words: memory in proportion to the batch; null ids stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import map_batches, quoted, small_batches
from spendlake.llm.wordbpe import gathered

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Stands for a control piece while bytes are read as text: it is nothing itself, but no character spans it.
CUT = "\U0010ffff"

#: Distinct words a worker remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 250_000
#: Symbols that are merged in one array, characters that are encoded and ids that are decoded in one.
TOGETHER = 300_000


class PieceModel:
    """The tables of a model: ids of characters, and rank and result of each pair of pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = sp.unk_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sp.normalize(" a  b İ\tc ") != f"{MARK}{MARK}a{MARK}{MARK}b İ\tc{MARK}" or not all(map(sp.is_byte, self.byte_ids)):
            raise ValueError("the model normalises text or has no byte pieces")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has a word mark inside")
        ids = {self.pieces[i]: i for i in plain}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        # Pieces in the order of their scores, best first; equal scores have equal ranks.
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {i: rank_of[sp.get_score(i)] for i in plain}
        keys, ranks, made = [], [], []
        # Symbols from n on stand for characters without a piece; they merge with nothing.
        self.base = 1 << 21
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = ids.get(p[:cut]), ids.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    ranks.append(rank[i])
                    made.append(i)
        order = np.argsort(keys)
        self.n, self.keys = n, np.asarray(keys, np.int64)[order]
        self.ranks, self.made = np.asarray(ranks, np.int32)[order], np.asarray(made, np.int32)[order]
        self._hash()
        parts = np.stack([self.keys // n, self.keys % n])
        own = np.full(n, -1, np.int64)
        for i, r in rank.items():
            own[i] = r
        # Symbols that can be part of a pair ranked below themselves.
        self.early = np.zeros(n, bool)
        for side in parts:
            self.early[side[self.ranks < own[side]]] = True
        self.surface = self._surfaces(sp)

    def _hash(self) -> None:
        """An open table of the pairs, for look-ups of many keys at once."""
        self.bits = int(np.ceil(np.log2(max(2, len(self.keys))))) + 2
        size = 1 << self.bits
        self.table = np.full(size, -1, np.int32)
        todo = np.arange(len(self.keys), dtype=np.int32)
        slot = self._slot(self.keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair in the tables, or -1."""
        out = np.full(len(left), -1, np.int32)
        at = np.flatnonzero((left < self.n) & (right < self.n))
        keys = left[at].astype(np.int64) * self.n + right[at]
        slot = self._slot(keys)
        for _ in range(self.probes):
            row = self.table[slot]
            hit = (row >= 0) & (self.keys[row] == keys)
            out[at[hit]] = row[hit]
            go = (row >= 0) & ~hit
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & (len(self.table) - 1)
            if not len(at):
                break
        return out

    def _surfaces(self, sp) -> list[bytes]:
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in range(self.n):
            if sp.is_control(i):
                out[i] = CUT.encode()
        out[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the length of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        first = np.asarray([self.chars.get(chr(c), self.base + int(c)) for c in kinds], np.int32)
        sym = first[inverse] if len(points) else np.zeros(0, np.int32)
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []

        def ranked(left: np.ndarray) -> np.ndarray:
            """Rows of the pairs that begin at ``left``; -1 at the end of a word."""
            row = np.full(len(left), -1, np.int32)
            inner = left + 1 < len(sym)
            inner[inner] = word[left[inner]] == word[left[inner] + 1]
            row[inner] = self.look_up(sym[left[inner]], sym[left[inner] + 1])
            return row

        pair = ranked(np.arange(len(sym)))
        while len(sym):
            rank = np.where(pair >= 0, self.ranks[pair], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, sizes)
            go_on = best < NONE
            if not go_on.all():
                done_sym.append(sym[~go_on])
                done_word.append(word[~go_on])
                sym, word, pair, rank, best = sym[go_on], word[go_on], pair[go_on], rank[go_on], best[go_on]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # Of occurrences that overlap, every second one from the left.
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            nth = np.arange(len(hit)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            first_of_word = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            risky = self.early[self.made[pair[hit]]]
            if risky.any():  # a word with a risky merge makes its leftmost merge only
                which = np.cumsum(first_of_word) - 1
                any_risky = np.logical_or.reduceat(risky, np.flatnonzero(first_of_word))[which]
                take = np.where(any_risky, first_of_word, nth % 2 == 0)
            else:
                take = nth % 2 == 0
            at = hit[take]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            at = moved[at]
            before = at[at > 0] - 1
            near = np.concatenate([at, before])
            pair[near] = ranked(near)
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        return self._with_bytes(sym[order], word[order], len(words))

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        odd = np.flatnonzero(sym >= self.base)
        if len(odd):
            kinds, inverse = np.unique(sym[odd], return_inverse=True)
            spelled = [[self.byte_ids[b] for b in chr(int(c) - self.base).encode("utf-8", "surrogatepass")] for c in kinds]
            sizes = np.asarray(list(map(len, spelled)), np.int64)
            starts = np.r_[0, np.cumsum(sizes)]
            times = np.ones(len(sym), np.int64)
            times[odd] = sizes[inverse]
            flat = np.repeat(sym, times)
            ids, _ = gathered(np.asarray([b for s in spelled for b in s], np.int32), starts, inverse, np.ones(len(odd), np.int64))
            flat[np.repeat(sym >= self.base, times)] = ids
            sym, word = flat, np.repeat(word, times)
        return sym.astype(np.int32), np.bincount(word, minlength=n_words)


class WordMemory(dict):
    """The ids of the words met so far, side by side in one array: word -> its number."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model, self.ids, self.starts = model, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Know all of ``words`` afterwards, and perhaps no others."""
        if len(self) > REMEMBERED:
            self.clear()
            self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = list({w for w in words if w not in self})
        at, size = 0, 0
        for i, w in enumerate([*new, ""]):
            size += len(w)
            if size > TOGETHER or i == len(new):
                if at < i:
                    self._add(new[at:i])
                at, size = i, len(w)

    def _add(self, words: list[str]) -> None:
        ids, lengths = self.model.merge([MARK + w for w in words])
        self.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])


_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def split_text(text: str) -> list[str]:
    """The words of a text, each without its first word mark."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]


@lru_cache(maxsize=2)
def memory(path: str) -> WordMemory:
    """One memory for each Python worker."""
    return WordMemory(PieceModel(path))


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Rows side by side whose sizes add up to ``TOGETHER`` or a little more; a row is never cut."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= TOGETHER:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encode_texts(path: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after the other, and how many each text has."""
    known = memory(path)
    ids, per_text = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part in _slices([len(t) if t else 0 for t in texts]):
        words = [split_text(t) if t else [] for t in texts[part]]
        flat = [w for ws in words for w in ws]
        known.learn(flat)
        codes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        found, lengths = gathered(known.ids, known.starts, codes, np.fromiter(map(len, words), np.int64, len(words)))
        ids.append(found)
        per_text.append(lengths)
    return np.concatenate(ids), np.concatenate(per_text)


@lru_cache(maxsize=2)
def _surface_arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, where each begins, which begin with a word mark, and which are control pieces."""
    model = memory(path).model
    starts = np.r_[0, np.cumsum([len(s) for s in model.surface])]
    marked = np.asarray([p.startswith(MARK) for p in model.pieces])
    control = np.asarray([s == CUT.encode() for s in model.surface])
    return np.frombuffer(b"".join(model.surface), np.uint8), starts, marked, control


def _lenient(raw: bytes) -> str:
    """UTF-8, with each byte that is part of no character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


def decode_ids(path: str, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
    """The texts of ids that follow each other, ``per_text`` of them for each text."""
    out: list[str] = []
    ends = np.cumsum(per_text)
    for part in _slices(per_text.tolist()):
        sizes = per_text[part]
        out += _decode_slice(path, ids[ends[part.start] - sizes[0] : ends[part.stop - 1]], sizes)
    return out


def _decode_slice(path: str, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
    pool, starts, marked, control = _surface_arrays(path)
    raw, n_bytes = gathered(pool, starts, ids.astype(np.int64), per_text)
    raw, out, at, begin = raw.tobytes(), [], 0, 0
    any_control = control[ids].any()
    for n_ids, n in zip(per_text.tolist(), n_bytes.tolist(), strict=True):
        part, own = raw[at : at + n], ids[begin : begin + n_ids]
        at, begin = at + n, begin + n_ids
        try:
            text = part.decode()
        except UnicodeDecodeError:
            text = _lenient(part)
        if any_control and control[own].any():
            text, own = text.replace(CUT, ""), own[~control[own]]
        out.append(text[1:] if len(own) and marked[own[0]] else text)
    return out


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with its text replaced by an array of ids; the other columns stay."""
    return _replace(docs, text_col, ids_col, T.ArrayType(T.IntegerType()), lambda column: _encoded(model_path, column))


def _encoded(path: str, column: pa.Array) -> pa.Array:
    ids, per_text = encode_texts(path, column.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)), pa.array(ids))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with a column of the decoded text behind the others."""
    return _replace(rows, ids_col, text_col, T.StringType(), lambda column: _decoded(model_path, column), keep=True)


def _decoded(path: str, column: pa.Array) -> pa.Array:
    per_text = np.diff(np.asarray(column.offsets))
    texts = decode_ids(path, np.asarray(column.flatten()), per_text)
    return pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())


def _replace(rows: DataFrame, old: str, new: str, kind: T.DataType, work, keep: bool = False) -> DataFrame:
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if keep or c != old]
    if new.lower() in {c.lower() for c in kept}:
        raise ValueError(f"there is a column {new} already")
    schema = T.StructType([*(f for f in rows.schema if f.name in kept), T.StructField(new, kind)])
    where = rows.columns.index(old)
    own = [rows.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), work(batch.column(where))], names=[*kept, new])

    return map_batches(rows, run, schema)


def digests(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_tokens``, and the digests of its ids, comma-joined, and of its decoded text."""
    ids = quoted(ids_col)
    return rows.select(
        quoted(id_col).alias(id_col), F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(quoted(text_col), 256).alias("decoded_sha256"),
    )


def default_model() -> str:
    """The place of the public model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
