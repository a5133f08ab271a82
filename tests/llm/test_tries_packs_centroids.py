"""The prefix trie, the packing and the clustering against plain versions, on odd rows and on tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quantloom.llm import centroids, packing, prefix_trie

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """Every node by walking all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    found = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(found):
        for d in range(len(found[c]) + 1):
            members[found[c][:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: ",".join(str(c) for c in members[p] if found[c] == p)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def odd_conversations() -> list[tuple]:
    rng = random.Random(4)
    rows = [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 1, "user", "a" * 50_000), (12, 3, "", ""), (9, 1, "b", ""), (9, 1, "", "b")]
    for c in range(20, 400):
        if c % 7:
            kind = rng.choice(["copy", "near", "own", "long"])
            for t in range({"copy": 10, "near": 12, "own": rng.randrange(1, 12), "long": 60 if c % 50 == 1 else 3}[kind]):
                text = f"t{t}" if kind == "copy" or (kind == "near" and t < 10) else f"é{rng.randrange(3)}"
                rows.append((c, t, "user" if t % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize("shard", [640, 10])
def test_trie_equals_plain_version(spark, shard):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(5)
    got = prefix_trie.trie(frame, shard=shard).select(*NODE).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1], r[7])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1], r[7]))
    assert prefix_trie.trie(frame.limit(0)).count() == 0


def test_trie_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op11_trie(spark, data)
    assert got.columns == list(NODE)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1], r[7])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1], r[7]))


def test_trie_refuses_shards_that_cut_a_group(spark):
    with pytest.raises(ValueError):
        prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), shard=7)


def hold_packing(docs: list[tuple], rows: list, length: int) -> None:
    """Every id of every document lies in one piece, sequences have no gaps, and only full or power-of-two ones exist."""
    library = packing.library(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    by_text, ids_of = defaultdict(list), {}
    for i, text in docs:
        ids_of.setdefault(i, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    for r in rows:
        held = [x for x in ids_of[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert held and r["length"] > 0
        by_text[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(n * k for (_, _, n), k in want.items())
    for (i, n), spans in by_text.items():
        copies = sum(k for (j, _, m), k in want.items() if (j, m) == (i, n))
        covered = Counter(x for s, size in spans for x in range(s, s + size))
        assert len(covered) == n and set(covered.values()) == {copies}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for spans in sequences.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        sizes.append(at)
        assert at == length or at < length and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences))) and sum(n < length for n in sizes) <= math.log2(length)


@pytest.mark.parametrize("length", [4096, 64])
def test_packing_of_odd_documents(spark, odd_docs, no_docs, length):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(odd_docs, path, length=length).collect()
    hold_packing([(r["doc_id"], r["text"]) for r in odd_docs.collect()], rows, length)
    assert packing.pack(no_docs, path).count() == 0


def test_packing_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.op12_packing(spark, data)
    hold_packing([(r["doc_id"], r["text"]) for r in docs.collect()], out.collect(), 4096)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_cached_runs_give_the_library_s_ids(kind):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path, 2, kind)
    assert packing.id_type(path, 2) == "<u2" and packing.id_type(path, 1 << 16) == "<u4"
    rng = random.Random(1)
    letters = ["a", "B", "'", "s", "'S", " ", "\xa0", "\n", "\t", "é", "É", "ß", "ſ", "İ", "9", "²", "-", "…", "—", "“", "́", "Σ", "東", " ", "\x1c", "\x1f", "\x85", "\u2003", "\u200b", "\u180e", "😀", "<|endoftext|>", "'ll", "€", "\xad", "ǆ"]
    texts = ["".join(rng.choice(letters[: 25 if n % 2 else None]) for _ in range(rng.randrange(12))) for n in range(3000)] + ["x" * 300 + " it's", "\u0130a \u0130"]
    for begin in range(0, len(texts), 500):
        part = texts[begin : begin + 500]
        for text, got in zip(part, encoder.ids([t.encode() for t in part]), strict=True):
            assert np.frombuffer(got, kind).tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [2], repr(text)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_words_of_plain_runs_are_cut_in_arrays_and_learnt_once(kind):
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2, kind)
    rng = random.Random(2)
    letters = ["ab", "Z", "À", "Þ", "ÿ", "ß", "×", "÷", "7", "42", ".", ",-", "'", "'re", "\x7f", "\x00", "½", "œ", "İ", "東", "\u0301", "\xa0", " ", "\n", "  "]
    texts = ["".join(rng.choice(letters[: (10, 13, 25)[n % 3]]) for _ in range(rng.randrange(14))) for n in range(3000)]
    texts += ["", " ", "À", "×", "y" * 300 + "." + "Ö" * 300, "İ" * 200, "it's", "'s's ''s", *map(chr, range(0x300))]
    for begin in range(0, len(texts), 700):
        part = texts[begin : begin + 700]
        for text, got in zip(part, encoder.ids([t.encode() for t in part]), strict=True):
            assert np.frombuffer(got, kind).tolist() == encoder.library.encode(text, add_special_tokens=False).ids + [2], repr(text)
    assert encoder.ids([]) == []
    fresh = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2, kind)
    assert len(fresh.ids([b"Haus haus, HAUS; (haus) haus. Haus!", "Élan élan, ÉLAN.".encode()])) == 2
    assert set(fresh) == {"haus", ",", ";", "(", ")", ".", "!", "élan"}  # 9 runs more were kept when each run was looked up whole


def test_hilbert_places_are_a_walk_through_all_cells():
    for bits, d in ((3, 2), (2, 3), (4, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        order = np.argsort(packing.hilbert(cells, bits))
        assert sorted(packing.hilbert(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_of_the_curve_share_words(spark):
    """Documents of one topic lie together far more often than chance has it."""
    rng = random.Random(9)
    topics = [[f"{a}{b}" for b in ("stone", "river", "cloud", "paper", "light", "metal")] for a in ("red", "old", "far", "dry")]
    docs = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), length=512).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["doc_id"] % 4))
    pairs = [a[1] == b[1] for v in held.values() for a, b in zip(sorted(v), sorted(v)[1:])]
    assert np.mean(pairs) > 0.9


def plain_clusters(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    kept = [(i, tuple(math.floor(1024 * (x if abs(x) < 1e300 else int(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        now = [tuple(sum(x) // len(of[j]) for x in zip(*of[j], strict=True)) if of[j] else c for j, c in enumerate(now)]
    found = [(i, *near(v)) for i, v in kept]
    cap = lambda x: min(x, 2**63 - 1)
    by = Counter()
    for _, d, j in found:
        by[j] += cap(d)
    return [(i, j, cap(d), cap(by[j]), cap(sum(by.values())), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, d, j in found]


def vectors(seed: int, huge: bool) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(500, 540)] + [rows[3], (None, rows[4][1]), (600, None), (601, [1.0] * 63), (602, [float("nan")] * 64), (603, [None] * 64), (604, [0.0] * 64), (605, [])]
    return rows + [(700, [1e20] + [0.0] * 63), (701, [-3e30] * 64), (702, [1e20] + [0.001] * 63), (703, [1.7e308] * 64)] * huge


@pytest.mark.parametrize("huge, k", [(False, 8), (True, 8), (False, 30), (False, 1)])
def test_clusters_equal_plain_version(spark, huge, k):
    rows = vectors(3, huge)
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = [tuple(r) for r in centroids.clusters(frame, k=k, rounds=4).collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(rows, k, 4), key=repr)


def test_clusters_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)], "vec_id long, embedding array<double>")
    assert {r["distance"] for r in centroids.clusters(frame).collect()} == {0}
    assert centroids.clusters(frame.limit(0)).count() == 0


def test_tree_finds_the_nearest_of_many_and_of_equals():
    rng = np.random.default_rng(2)
    whole = [tuple(int(v) for v in rng.integers(-3, 4, size=3)) for _ in range(60)]
    tree = centroids.VantageTree(whole)
    x = rng.integers(-4, 5, size=(500, 3))
    number, gap = tree.nearest(x)
    d = ((x[:, None] - np.array(whole)[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (gap == d.min(axis=1)).all()


def test_tree_prunes_where_centroids_lie_apart():
    rng = np.random.default_rng(5)
    spots = rng.integers(-10_000, 10_000, size=(64, 2))
    tree, asked = centroids.VantageTree([tuple(map(int, s)) for s in spots]), []
    plain = tree._distances
    tree._distances = lambda x, j: asked.append(len(x)) or plain(x, j)
    tree.nearest(spots[rng.integers(0, 64, size=1000)] + rng.integers(-9, 10, size=(1000, 2)))
    assert sum(asked) < 0.5 * 64 * 1000
