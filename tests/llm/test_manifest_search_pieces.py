"""Merkle manifest, tiered search and pieces: brute force, odd rows and properties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenegrain.llm import merkle, pieces, tiered

from .test_operators import clashing

# 11 manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_in(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1], at & 1) if at ^ 1 < len(level) else ("", 0))
        at >>= 1
    return out


def leaf(row, columns):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))


def manifest(rows, columns=merkle.FIELDS, group="lang"):
    """(row, leaf, path, subroot, root) of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[group]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, columns), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (some := sorted(groups[g], key=lambda x: x[:3]), levels_of([x[2] for x in some])) for g in names}
    top = levels_of([trees[g][1][-1][0] for g in names])
    return [(x[3], x[2], path_in(levels, i) + path_in(top, names.index(g)), levels[-1][0], top[-1][0]) for g, (some, levels) in trees.items() for i, x in enumerate(some)]


def fold(digest, path):
    for sibling, side in path:
        digest = h(sibling + digest if side else digest + sibling)
    return digest


@pytest.mark.parametrize("subtree", [1, 2, 3, 5, 9])
def test_paths_are_those_of_the_whole_tree(subtree):
    for n in [*range(1, 35), 63, 64, 65, 127]:
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        for more in (0, 2):  # a last block in a larger tree goes on hashing its only node
            deep = levels + [[h(levels[-1][0])], [h(h(levels[-1][0]))]][:more]
            height = len(deep) - 1
            assert merkle.root_of(leaves, height) == deep[-1][0]
            got = [[(s[1:], int(s[:1] == "L")) for s in p] for p in merkle.paths(leaves, height, subtree)]
            assert got == [path_in(deep, i) for i in range(n)]


def test_the_traversal_keeps_two_subtrees_a_band(monkeypatch):
    """Besides its leaves a block of 2 ** 10 never holds more than two subtrees of a band, and a path costs few digests."""
    made = 0
    plain = merkle.joined

    def counted(left, right):
        nonlocal made
        made += 1
        return plain(left, right)

    monkeypatch.setattr(merkle, "joined", counted)
    walk, most, before = merkle.paths([h(str(i)) for i in range(1024)], 10), 0, 0
    next(walk)
    before = made
    for _ in walk:
        frame = walk.gi_frame.f_locals
        held = sum(len(level) for tree in [*frame["existing"], *filter(None, frame["ready"])] for level in tree)
        most = max(most, held, 0)
    assert most <= 3 * (2**6 - 1) and made - before <= 2 * 1024


def rows_for_manifest(rng, n):
    langs = [None, "en", "é", "z", "Z", "", "a\U0001f600"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5, 10**12]), rng.choice([None, "", "text", "é" * 7, "long " * 9000])) for _ in range(n)]
    return rows + rows[: n // 3]


@pytest.mark.parametrize(("n", "block"), [(120, 2), (1, 10)])
def test_manifest_against_whole_trees(spark, n, block):
    rows = rows_for_manifest(random.Random(n), n)
    df = clashing(spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string"))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS)))
    got = Counter(map(tuple, merkle.checked(df, claimed, block=block).collect()))
    plain = manifest([r.asDict() for r in df.collect()])
    want = Counter()
    for r, digest, path, subroot, root in plain:
        changed = r | {"n_chars": r["n_chars"] + 1} if r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else r
        found = fold(leaf(changed, merkle.FIELDS), path)
        want[(r["doc_id"], digest, subroot, root, h("".join(s for s, _ in path)), found, found == root)] += 1
    assert got == want
    paths = Counter((r.doc_id, r.leaf, tuple(r.path), r.subroot, r.root) for r in merkle.proofs(df, block=block).collect())
    assert paths == Counter((r["doc_id"], d, tuple(("LR"[1 - side] + s) if s else "" for s, side in path), a, b) for r, d, path, a, b in plain)


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, source string, n_chars long, text string")
    assert merkle.checked(df, F.lit(None)).count() == 0 and merkle.proofs(df).count() == 0


# 12 search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=10):
    lists = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in lists]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for k, ((doc, c), n) in enumerate(zip(lists, sizes, strict=True)):
            m = 25 + 75 * n * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score:
                scores.append((-score, doc is None, doc or 0, k, doc))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


def found(spark, docs, items, **more):
    d, i = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(items, "item_id long, text string"))
    return Counter(map(tuple, tiered.search(d, i, **more).collect()))


DOCS = [(1, None), (1, None), (None, "some Text of words"), (None, None), (2, ""), (3, " \n\t "), (4, "word other thing " * 7000), (5, "one two three four"), (5, "one two three four"), (6, "é ß 漢字 \U0001f600 É a1b2"), (7, "ONE-two_Three"), (8, "one one one\x00two")]
ITEMS = [(0, "one two"), (0, "one two"), (1, None), (2, ""), (3, "nothing known"), (4, "É é 漢字 a1B2"), (5, "thing words one one TEXT"), (None, "four"), (6, "other"), (6, "word")]


def test_search_odd(spark):
    assert found(spark, DOCS, ITEMS) == ranked(DOCS, ITEMS)
    assert found(spark, DOCS, ITEMS, top=2) == ranked(DOCS, ITEMS, 2)
    assert not found(spark, DOCS, []) and not found(spark, [], ITEMS) and not found(spark, [(1, None)], ITEMS)


def zipf_docs(rng, n, vocabulary=400):
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 120)))) for i in range(n)]


def test_search_against_brute_force_at_every_tier(spark, monkeypatch):
    """Items of seldom words are proven in the first tier, items of frequent ones fall through; all are exact, ties included."""
    monkeypatch.setattr(tiered, "LEAST", 12)
    rng = random.Random(7)
    docs = zipf_docs(rng, 700)
    copies = [(2000 + i, docs[i % 5][1]) for i in range(60)]  # ties
    passage = " ".join(f"r{i}" for i in range(12))
    planted = [(3000 + i, docs[i][1][:90] + " " + passage) for i in range(12)]
    docs += copies + planted
    items = [(i, " ".join(rng.sample(docs[i * 9][1].split(), min(8, len(docs[i * 9][1].split()))))) for i in range(60)] + [(100, passage), (101, passage + " w0 w1"), (102, "w0"), (103, "w0 w1 w2 w3 w4")]
    assert found(spark, docs, items) == ranked(docs, items)
    rows, proved = tiered._search_block(spark.createDataFrame(docs, "doc_id long, text string"), [(100, passage), (101, passage + " w0 w1"), *items[:20]], 10, "doc_id", "text")
    assert proved[0] > 0 and proved[-1] > 0 and sum(proved) == 22
    assert Counter(rows) == ranked(docs, [(100, passage), (101, passage + " w0 w1"), *items[:20]])


def test_search_in_blocks_of_items_and_pieces_of_texts(spark, monkeypatch):
    monkeypatch.setattr(tiered, "ITEM_BYTES", 1200)
    monkeypatch.setattr(tiered, "TOGETHER", 8)
    docs = zipf_docs(random.Random(3), 60, 30)
    items = docs[:12]
    assert found(spark, docs, items) == ranked(docs, items)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9 _-é漢\x00\x7f\u0085\n"), max_size=40))
def test_terms(text):
    assert [w.decode() for some in tiered.terms_of(text.encode()) for w in some] == terms(text)


# 13 pieces


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


PARTS = ["▁", " ", "  ", " " * 15, " " * 17, " " * 33, "the", "a", "e", "th", "er", "in", "\n", "\t", "漢", "字", "é", "0", "12", "ß", "'", "\U0001f600", "\x00", "....", "====", "hello", "ing", " t", " th", "▁▁", "<s>", "</s>", "<0x41>", "<unk>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
def test_pieces_are_those_of_the_library(text):
    tables, processor = pieces.pieces(pieces.default_model()), library()
    got = tables.encode([text])[0].tolist()
    assert got == processor.encode(text, add_bos=True, add_eos=True)
    assert tables.decode(np.array(got)) == processor.decode(got)


def test_words_of_pieces_whose_merges_are_out_of_order():
    """Pieces side by side without spaces: many merges make a pair that comes before others of the same round."""
    rng, tables, processor = random.Random(5), pieces.pieces(pieces.default_model()), library()
    vocabulary = [processor.id_to_piece(i) for i in range(259, processor.get_piece_size())]
    texts = ["".join(rng.choices(vocabulary, k=rng.randint(1, 40))).replace("▁", rng.choice(["", "▁"])) for _ in range(4000)]
    texts += ["a" * 5000, "the" * 3000, " " * 5000, "漢字執梦" * 2000, "".join(rng.choices(vocabulary, k=5000)).replace("▁", "")]
    assert [t.tolist() for t in tables.encode(texts)] == processor.encode(texts, add_bos=True, add_eos=True)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=14))
def test_decoding_is_that_of_the_library(ids):
    assert pieces.pieces(pieces.default_model()).decode(np.array(ids, np.int64)) == library().decode(ids)


def test_pieces_odd(spark):
    rows = [(1, None), (1, None), (None, "some text"), (2, ""), (3, " \n\t "), (4, "word other thing " * 7000), (5, "one two"), (5, "one two"), (6, "é ß 漢字 \U0001f600"), (7, "x" * 30000), (8, "\x00▁ ▁")]
    df, processor = clashing(spark.createDataFrame(rows, "doc_id long, text string")), library()
    want = [(i, processor.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows]
    ids = pieces.encoded(df)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((i, tuple(x)) for i, x in want)
    assert Counter(map(tuple, pieces.decoded(clashing(ids)).collect())) == Counter((i, processor.decode(x)) for i, x in want)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert Counter(map(tuple, pieces.digested(df).collect())) == Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(processor.decode(x).encode())) for i, x in want)
    assert pieces.encoded(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decoded(nothing).collect()] == ["", ""]


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 50)
    monkeypatch.setattr(pieces, "TOGETHER", 30)
    tables, processor = pieces.Pieces(pieces.default_model()), library()
    for k in range(20):
        texts = [f"word{k}{i} other{i} the" for i in range(9)]
        assert [t.tolist() for t in tables.encode(texts)] == processor.encode(texts, add_bos=True, add_eos=True)
        assert len(tables.words) <= 50 + 27
