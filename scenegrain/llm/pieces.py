"""SentencePiece encoding and decoding: vectorised merge rounds over the flat symbols of many words."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import named, table, text_of

#: What stands for a space in pieces.
MARK = "▁"
NEVER = np.iinfo(np.int32).max
#: Words of which a task keeps the ids, and characters in them; past either it starts anew.
WORDS_KEPT, CHARS_KEPT = 1 << 18, 1 << 23
#: Rows of a batch that are encoded together, as long as their texts have no more bytes than this; words are merged together up to as many characters.
ROWS, TOGETHER = 512, 1 << 22

ITEM = re.compile(r" +[^ ]*")


def from_left(n: int, lengths) -> list[int]:
    """Lengths of the pieces of n equal characters whose merges all have one rank: the leftmost merge is always next."""
    run = [1] * n
    while (at := next((i for i in range(len(run) - 1) if run[i] + run[i + 1] in lengths), None)) is not None:
        run[at : at + 2] = [run[at] + run[at + 1]]
    return run


class Words(dict):
    """Words numbered as they are met; fresh: those whose ids aren't known yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Pieces:
    """The tables of a BPE model with byte fallback, whose only normalisation is a space before the text.

    Symbols are ids of pieces; a character without a piece is the symbol `size` + code point. pair_key is
    an open hash table of every two symbols that merge, as left * span + right, pair_rank has the order of
    the merge (equal scores have equal ranks) and pair_to the symbol that comes of it.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, spec, trained = proto.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        if trained.model_type != proto.TrainerSpec.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and white space before words")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models that put a space before the text and change nothing else")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.size, self.begin, self.end = len(model.pieces), trained.bos_id, trained.eos_id
        self.span = self.size + 0x110000
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        score = {piece: model.pieces[i].score for piece, i in normal.items()}
        order = {s: rank for rank, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = {c: self.size + ord(c) for piece in normal for c in piece} | normal

        blanks = {len(p): i for p, i in normal.items() if not p.strip(MARK)}
        if 1 not in blanks or len({score[MARK * k] for k in blanks}) > 1 or any(s <= score[MARK] for p, s in score.items() if len(p) > 1 and p.strip(MARK)):
            raise ValueError("pieces of white space must share the last rank")
        if any(MARK in p[1:] for p in normal if p.strip(MARK)):
            raise ValueError("white space within a piece")
        self.blank_most = most = max(blanks)
        runs = [from_left(k, blanks) for k in range(3 * most)]
        if any(runs[k] != [most] + runs[k - most] for k in range(most, len(runs))):
            raise ValueError("white space isn't cut into its longest piece first")
        self.blank = np.zeros((most, max(map(len, runs[:most]))), np.int64)  # pieces of a run shorter than the longest piece
        for k, run in enumerate(runs[:most]):
            self.blank[k, : len(run)] = [blanks[x] for x in run]
        self.blank_count, self.blank_whole = np.array([*map(len, runs[:most])]), blanks[most]

        found = []
        for piece, i in normal.items():
            if len(piece) > 1 and piece.strip(MARK):
                found += [(symbol[piece[:k]] * self.span + symbol[piece[k:]], order[score[piece]], i) for k in range(1, len(piece)) if piece[:k] in symbol and piece[k:] in symbol]
        self.pair_table(*np.array(found or [(-1, NEVER, 0)], np.int64).T)
        self.beside = np.zeros(1 << 24, bool)  # by hash: where two characters aren't told apart from two of a piece, a word isn't cut
        for piece in normal:
            for a, b in zip(piece, piece[1:], strict=False):
                self.beside[self.beside_slot(ord(a), ord(b))] = True
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.size
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.of_byte = np.zeros(256, np.int64)

        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.of_byte[value] = i
                surface.append(bytes([value]))
            elif p.type == kinds.UNKNOWN:
                surface.append(trained.unk_surface.encode())
            else:
                surface.append(b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.is_silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.leads = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in model.pieces])
        self.surface_ends = np.cumsum([0, *map(len, surface)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

        self.words = Words()
        self.forget()

    def forget(self) -> None:
        self.words.clear()
        self.words.fresh.clear()
        self.kept = 0
        self.ids, self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def pair_table(self, key: np.ndarray, rank: np.ndarray, to: np.ndarray) -> None:
        self.mask = (1 << (8 * len(key)).bit_length()) - 1
        self.pair_key = np.full(self.mask + 1, -1, np.int64)
        self.pair_rank, self.pair_to = np.full(self.mask + 1, NEVER, np.int32), np.zeros(self.mask + 1, np.int32)
        left, self.steps = np.arange(len(key)), 0  # the longest way from a key's own slot to where it is
        slot = self.slot(key)
        while len(left):
            free = self.pair_key[slot[left]] < 0
            at, which = np.unique(slot[left[free]], return_index=True)
            put = left[free][which]
            self.pair_key[at], self.pair_rank[at], self.pair_to[at] = key[put], rank[put], to[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask
            self.steps += 1

    @staticmethod
    def beside_slot(a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & 0xFFFFFF

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of two symbols, NEVER where there is none, and the symbol that comes of it."""
        key = left * self.span + right
        at = self.slot(key)
        found = self.pair_key[at]
        rank, to = np.where(found == key, self.pair_rank[at], NEVER), self.pair_to[at].astype(np.int64)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.steps):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            there = at[open_]
            found = self.pair_key[there]
            hit = found == key[open_]
            rank[open_[hit]], to[open_[hit]] = self.pair_rank[there[hit]], self.pair_to[there[hit]]
            open_ = open_[~hit & (found >= 0)]
        return rank, to

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words after all merges, and how many each word has; starts: of each word, none empty.

        A round finds the smallest rank of each word and merges all pairs of that rank from the left, of
        overlapping ones the first. Where such a merge makes a pair of a rank no larger, which would
        be merged before those further right, the word's later merges wait for the next round. Words
        without pairs are taken out, so that a round costs what is still unsettled.
        """
        n_words = len(starts)
        name, counts = np.arange(n_words), np.diff(np.append(starts, len(symbols)))
        done_symbols, done_words = [], []
        sym, word = symbols, np.repeat(name, counts)
        rank, to = self.next_ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < NEVER, size)
            if not open_.all():
                done_symbols.append(sym[~open_])
                done_words.append(word[~open_])
                sym, word, rank, to = sym[open_], word[open_], rank[open_], to[open_]
                keep = least < NEVER
                least, size = least[keep], size[keep]
                first = np.cumsum(size) - size
            if not len(sym):
                break
            at = np.arange(len(sym))
            hit = rank == np.repeat(least, size)
            begins = hit & ~np.append(False, hit[:-1])
            hit &= (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
            take = np.flatnonzero(hit)
            made, mine = to[take], word[take]
            # what stands before a merge, merges further left done, and behind it, those further right not done
            before = np.maximum(take - 1, 0)
            joined = (take >= 2) & hit[take - 2]
            before_sym = np.where(joined, to[take - 2], sym[before])
            behind = np.minimum(take + 2, len(sym) - 1)
            left = np.where((take >= 1) & (word[before] == mine), self.pairs(before_sym, made)[0], NEVER)
            right = np.where((take + 2 < len(sym)) & (word[behind] == mine), self.pairs(made, sym[behind])[0], NEVER)
            sooner = np.minimum(left, right) <= rank[take]
            if sooner.any():
                stop = np.full(n_words, len(sym))
                np.minimum.at(stop, mine[sooner], take[sooner])
                take = take[take <= stop[mine]]
                made = to[take]
            sym[take] = made
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            new = np.cumsum(keep) - 1
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            changed = np.concatenate([new[take], np.maximum(new[take] - 1, 0)])
            follow = np.minimum(changed + 1, len(sym) - 1)
            r, t = self.pairs(sym[changed], sym[follow])
            same = (changed + 1 < len(sym)) & (word[changed] == word[follow])
            rank[changed], to[changed] = np.where(same, r, NEVER), t
        all_words = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        by = np.argsort(all_words, kind="stable")
        out = np.concatenate(done_symbols)[by] if done_words else np.empty(0, np.int64)
        return out, np.bincount(all_words, minlength=n_words)

    def next_ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, to = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, t = self.pairs(sym[:-1], sym[1:])
            rank[:-1], to[:-1] = np.where(word[:-1] == word[1:], r, NEVER), t
        return rank, to

    def learn(self, words: list[str]) -> None:
        """Ids of words that weren't met yet. A word stands for a space and itself; further spaces lead it.

        Only the last of several spaces can merge with what follows, and spaces merge with each other
        last and from the left, all at one rank: so they are cut into the longest piece again and again,
        and the rest as from_left() has it.
        """
        bare = [w.lstrip(" ") for w in words]
        extra = np.array([len(w) - len(b) for w, b in zip(words, bare, strict=True)], np.int64)
        lengths = np.array([len(b) + 1 for b in bare], np.int64)
        chars = np.frombuffer("".join(MARK + b for b in bare).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.zeros(len(chars), bool)
        begins[np.cumsum(lengths) - lengths] = True
        cut = begins.copy()
        if len(chars) > 1:
            cut[1:] |= ~self.beside[self.beside_slot(chars[:-1], chars[1:])]  # no piece holds the two side by side
        part_word = np.cumsum(begins)[cut] - 1
        sym, in_part = self.merged(self.of_char[chars], np.flatnonzero(cut))
        count = np.bincount(part_word, in_part, len(words)).astype(np.int64)
        first = np.cumsum(count) - count
        alone = (sym[first] == self.of_char[ord(MARK)]) & (extra > 0)  # the last space merged with nothing
        run = extra + alone
        whole, short = np.divmod(run, self.blank_most)
        spaces = whole + self.blank_count[short]
        lens = spaces + count - alone
        out = np.empty(int(lens.sum()), np.int64)
        start = np.cumsum(lens) - lens
        which = np.repeat(np.arange(len(words)), spaces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(spaces) - spaces, spaces)
        out[start[which] + nth] = np.where(nth < whole[which], self.blank_whole, self.blank[short[which], np.maximum(nth - whole[which], 0)])
        rest = np.ones(len(sym), bool)
        rest[first[alone]] = False
        which = np.repeat(np.arange(len(words)), count)[rest]
        nth = (np.arange(len(sym)) - np.repeat(first, count) - np.repeat(alone, count))[rest]
        out[start[which] + spaces[which] + nth] = sym[rest]
        ids, per = self.with_bytes(out)
        lens = np.bincount(np.repeat(np.arange(len(words)), lens), per, len(words)).astype(np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lens) - lens])
        self.count = np.concatenate([self.count, lens])
        self.ids = np.concatenate([self.ids, ids])
        self.kept += int(lengths.sum() + extra.sum())

    def with_bytes(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece replaced by the ids of their bytes, and how many ids each symbol has."""
        char = sym - self.size
        without = np.flatnonzero(char >= 0)
        per = np.ones(len(sym), np.int64)
        if not len(without):
            return sym, per
        c = char[without]
        per[without] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(sym, per)
        raw = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(char >= 0, per)] = self.of_byte[raw]
        return ids, per

    def encode(self, texts: list[str], *, begin: bool = True, end: bool = True) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > WORDS_KEPT or self.kept > CHARS_KEPT:
            self.forget()
        split = []
        for text in texts:
            text = text.replace(MARK, " ")
            if not text:
                words = []
            elif "  " in text or text[0] == " " or text[-1] == " ":
                words = [w[1:] for w in ITEM.findall(" " + text)]
            else:
                words = text.split(" ")
            split.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        fresh, lo = self.words.fresh, 0
        ends = list(accumulate(map(len, fresh)))
        while lo < len(fresh):
            hi = max(lo + 1, bisect_right(ends, ends[lo] + TOGETHER))
            self.learn(fresh[lo:hi])
            lo = hi
        fresh.clear()
        out = []
        for at in split:
            count = self.count[at]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            ids = np.empty(begin + total + end, np.int64)
            ids[begin : begin + total] = self.ids[np.repeat(self.first[at] - ends + count, count) + np.arange(total)]
            if begin:
                ids[0] = self.begin
            if end:
                ids[-1] = self.end
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces are silent, the space that leads the text goes, and a byte that is no character's is U+FFFD."""
        ids = np.asarray(ids, np.int64)
        said = ~self.is_silent[ids]
        if not said.any():
            return ""
        first, last = int(said.argmax()), len(said) - int(said[::-1].argmax())
        count = np.diff(self.surface_ends)[ids[first:last]]  # of a silent piece 0
        begin = self.surface_ends[ids[first:last]]
        if self.leads[ids[first]]:
            begin[0] += 1
            count[0] -= 1
        ends = np.cumsum(count)
        raw = self.surface[np.repeat(begin - ends + count, count) + np.arange(ends[-1])]
        cuts = ends[~said[first:last]]  # bytes on both sides of a silent piece are no character
        return "".join(characters(part.tobytes()) for part in np.split(raw, cuts))


def characters(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each single byte that doesn't begin a whole character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The tables of a model, made once in each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows and about TOGETHER bytes of text; the text is column 1."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + ROWS, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _mapped(df: DataFrame, of, fields: list[T.StructField], id_col: str, text_col: str, model: str | None) -> DataFrame:
    """doc_id and what of(tables, ids of each text) gives as columns, in one pass over the texts."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(path)
        for batch in batches:
            for part in parts_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *of(tables, tables.encode(part.column(1).to_pylist()))], names=["doc_id", *(f.name for f in fields)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])
    return df.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def encoded(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int, begin and end included) of every row, exactly those of the sentencepiece library.

    A null text is the empty one, whose ids are begin and end; null ids and repeated rows are rows like
    any other; an empty table gives no rows; other columns are ignored. Each word is merged once per
    task, as long as at most WORDS_KEPT words of CHARS_KEPT characters are kept. A text without
    spaces is one word, cut wherever no piece holds two characters side by side.
    """
    return _mapped(df, lambda _, ids: [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], [T.StructField("ids", T.ArrayType(T.IntegerType()))], id_col, text_col, model)


def decoded(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids. Null or empty ids give the empty text; an id the model doesn't have, null ones included, is an error."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if any(i is None or not 0 <= i < tables.size for i in ids or ()):
                    raise ValueError("an id that the model doesn't have")
                texts.append(tables.decode(np.array(ids or [], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = df.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digested(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, texts encoded and decoded in one task; odd rows as in encoded()."""

    def of(tables: Pieces, rows: list[np.ndarray]) -> list[pa.Array]:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        return [pa.array([len(i) for i in rows], pa.int64()), pa.array([sha(i.astype("<u4").tobytes()) for i in rows], pa.string()), pa.array([sha(tables.decode(i).encode()) for i in rows], pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, of, fields, id_col, text_col, model)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
