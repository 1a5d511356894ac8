from __future__ import annotations

import base64
import hashlib
import json
import random
import string
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from filigree.llm import linededup, media, mixing, neighbours, packing, pii, queries, repeats, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choice(string.ascii_lowercase) for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def documents(n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, nulls in all columns, empty and long texts, repeated rows."""
    rng = random.Random(4)
    out, passage = [], prose(rng, 70)
    for i in range(n):
        t = prose(rng, rng.randint(1, 160))
        if i % 6 == 1:
            t = out[i - 1][1]
        elif i % 6 == 2 and out[i - 2][1]:
            w = (out[i - 2][1] or "").split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        elif i % 6 == 3:
            t = f"{t}\n{passage}\n{prose(rng, 20)}"
        out.append((i, t, "en", f"src{i % 4}", len(t)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \t\n", "en", None, 3), (n + 3, "ÄÖ ü 😀 " * 30, "de", "src2", 1), (n + 4, "word " * 20_000, "en", "src3", 1), (None, out[0][1], "en", "src0", 5), (None, "alone " * 30, None, "src0", None)]
    return [*out, out[5], out[5], (7, "another text with an id that is taken " * 3, "en", "src1", 9)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns whose names operators use inside must not get in the way.
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(1) for c in ("size", "rank", "b", "row", "fp", "node", "block", "place", "mark", "copies", "score", "t", "spans", "kept", "_part")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def use(monkeypatch, **tables):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: tables[name])


# 1


def test_simhash_components(spark, monkeypatch, docs, rows):
    use(monkeypatch, documents=docs)
    got = brute.multiset((r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, "").collect())
    fp = [brute.simhash(r[1]) for r in rows]
    root = brute.groups(len(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    least = {}
    for r, g in zip(rows, root, strict=True):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    assert got == brute.multiset((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fp, root, strict=True))


def test_links_in_dense_and_split_shards(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            values.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1)
    values = sorted(values)
    d = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = brute.groups(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)
    for most in (8192, 20):
        near = simhash.links(d, 3, most).collect()
        at = {v - (1 << 64) if v >> 63 else v: i for i, v in enumerate(values)}
        pairs = {(at[r.a], at[r.b]) for r in near} | {(at[r.b], at[r.a]) for r in near}
        assert brute.groups(len(values), lambda a, b: (a, b) in pairs) == want  # noqa: B023
        assert most < 8192 or len(near) < 4 * len(values)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    v = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    a, b = simhash.tree_links(v, 3)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_similar_groups(docs, rows):
    got = {r.node: r.group for r in simhash.similar_groups(docs).collect()}
    sets = [set(brute.shingles(r[1], 5)) for r in rows]
    root = brute.groups(len(rows), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(got.values())) == len(set(root))
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    firsts = {}
    for r, g in zip(rows, root, strict=True):
        firsts[g] = min((x for x in (firsts.get(g), r[0]) if x is not None), default=None)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x in firsts.values() if x is not None)


def template_documents(n: int = 1500, pairs: int = 60) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Documents that share a template (pairwise 0.70 to 0.79), and among them pairs at 0.8 to 0.86."""
    rng = random.Random(21)
    template = [f"t{k}" for k in range(340)]
    own = lambda m: [f"u{rng.getrandbits(40):x}" for _ in range(m)]
    texts = [[*template, *own(rng.randint(46, 56))] for _ in range(n)]
    planted = []
    for k in range(pairs):
        tail, swap = own(50), rng.randint(31, 39)
        planted.append((len(texts), len(texts) + 1))
        texts += [[*template, *tail], [*template, *tail[: 50 - swap], *own(swap)]]
    return [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], planted


def test_similar_groups_among_templates(spark):
    """A pair is found although hundreds of other documents are nearer by their bits, or are near and fail."""
    made, planted = template_documents()
    got = {r.first: r.group for r in simhash.similar_groups(spark.createDataFrame(made, DOCS)).collect()}
    sets = [set(brute.shingles(r[1], 5)) for r in made]
    assert all(0.8 <= brute.jaccard(sets[a], sets[b]) <= 0.86 for a, b in planted)
    assert all(0.7 <= brute.jaccard(sets[0], s) < 0.8 for s in sets[1:1500])
    missed = [p for p in planted if p[1] in got]  # a pair's second is in the group of its first
    assert not missed
    assert len(got) == len(made) - len(planted)


def test_similar_groups_of_short_texts(spark):
    """Every pair of few shingles is found, also among texts that share their most frequent ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.getrandbits(40):x}"
    texts = []
    for k in range(400):  # 0.8 exactly: four of five shingles, eight of ten, or nine of ten and one other
        first = [word() for _ in range((9, 14, 14, 24)[k % 4])]
        texts += [first, first[: len(first) - (1, 2, 1, 4)[k % 4]] + ([word()] if k % 4 == 2 else [])]
    texts += [["a", "common", "line", "of", "six", "words", *(word() for _ in range(rng.randint(0, 9)))] for _ in range(300)]
    made = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    sets = [set(brute.shingles(t[1], 5)) for t in made]
    want = brute.groups(len(sets), lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    got = {r.first: r.group for r in simhash.similar_groups(spark.createDataFrame(made, DOCS)).collect()}
    assert len({want[2 * k] for k in range(400)}) == 400 and sum(want[2 * k] == want[2 * k + 1] for k in range(400)) >= 300
    # One row a different text; a group's first is its smallest id.
    least = {}
    for i, r in enumerate(want):
        least[r] = min(least.get(r, i), i)
    assert set(got) == set(least.values())


def test_short_links_in_hot_cells(spark):
    """Blocks of a hot shingle meet block against block, with the same pairs as a plain loop."""
    rng = random.Random(6)
    sets = [sorted({1, 2, *rng.sample(range(3, 14), rng.randint(1, 6))}) for _ in range(200)]
    nodes = spark.createDataFrame([(i, i % 150, s) for i, s in enumerate(sets)], "node long, group long, short array<long>")
    want = {(a, b) for a in range(200) for b in range(a) if a % 150 != b % 150 and brute.jaccard(set(sets[a]), set(sets[b])) >= 0.8}
    for most in (16, 1024):
        assert {(r.a, r.b) for r in simhash.short_links(nodes, 0.8, most).collect()} == want
    assert simhash.short_links(nodes.limit(0), 0.8).count() == 0


def hot_shard(n: int = 5000, planted: int = 200) -> list[bytes]:
    """Fingerprints that share the 16 bits of one shard, and near copies of the first of them, anywhere in their order."""
    rng = np.random.default_rng(13)
    order = simhash._orders(1, 11)[0]
    bits = rng.integers(0, 2, (n, 256), np.uint8)
    bits[:, order[:16]] = 1
    near = bits[:planted].copy()
    for row in near:
        row[rng.choice(order[16:], 45, replace=False)] ^= 1
    return [f.tobytes() for f in np.packbits(np.concatenate([bits, near]), axis=1)]


def test_hot_shards_are_compared_whole(spark):
    """In a shard over the bound all pairs are found once, and no cell is much larger than two blocks."""
    n, fps = 5000, hot_shard()
    d = spark.createDataFrame([(i, f, 100, i) for i, f in enumerate(fps)], "node long, fp binary, size int, group long").persist()
    for most in (4096, 700):
        got = sorted((r.a, r.b) for r in simhash.crossing_links(d, 58, 1, 0.8, most).collect())
        assert got == [(n + i, i) for i in range(200)]
        largest = simhash.cells(simhash._dealt(d, 1, 11), most).groupBy("shard", "i", "j").count().agg(F.max("count")).head()[0]
        assert most < largest < 2.4 * most
    alike = d.withColumn("group", F.lit(1).cast("long"))
    assert simhash.crossing_links(alike, 58, 1, 0.8).count() == 0


# 2


def vectors(n: int = 400, dim: int = 32) -> list[tuple]:
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[40:80] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = [(i, [float(np.float32(v)) for v in row], i % 7) for i, row in enumerate(x)]
    bad = [(1000, None, 1), (1020, [0.0] * dim, 1), (1040, [float("nan")] * dim, 1), (1060, [None] * dim, 1), (1080, [1.0], 1), (1100, [float("inf")] * dim, 1), (None, made[3][1], 1)]
    return [*made, *bad, made[20], made[21]]


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_against_brute_force(spark, monkeypatch, scale):
    v = vectors()
    if scale:
        v = [(i, None if e is None else [None if x is None else x * (1 + (i or 0) % 3) for x in e], y) for i, e, y in v]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1))
    use(monkeypatch, embeddings=d)
    got: dict[int, list] = {}
    for r in queries.op2_neighbours(spark, "").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {i: np.array(e, np.float32).astype(float) for i, e, _ in v[:400]}
    assert set(got) == set(range(0, 400, 20))
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert all(abs(h[2] - x[h[1]] @ x[q]) < 1e-9 for h in hits)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(hits, hits[1:], strict=False))
        best = sorted((j for j in x if j != q), key=lambda j: (-round(float(x[j] @ x[q]), 10), j))[:20]
        found += len(set(best) & {h[1] for h in hits})
    assert found >= 0.9 * 20 * len(got)


def test_few_vectors(spark):
    d = spark.createDataFrame(vectors()[:5], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in neighbours.search(d).orderBy("rank").collect()].__len__() == 4
    assert neighbours.search(d.filter("false")).count() == 0


def test_index_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    codes[50:60] = codes[0]
    index = neighbours.MultiIndex(codes, 22)
    for q in range(0, 500, 50):
        far = np.unpackbits(codes ^ codes[q], axis=1).sum(1)
        got = index.within(codes[q], 1)
        assert got.tolist() == np.flatnonzero(far <= 22).tolist()


# 3


def place(i):
    return (1 << 63) - 1 if i is None else i


@pytest.mark.parametrize("hot", [2000, 20, 1, 0])
def test_repeats_against_brute_force(spark, docs, rows, hot):
    want = brute.repeats([(place(r[0]), r[1]) for r in rows], 50)
    got = repeats.drop_repeats(docs, block_bytes=4000, hot=hot).collect()
    assert brute.multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute.multiset((r[0], *w) for r, w in zip(rows, want, strict=True))


def log_like(lines: int, seed: int) -> str:
    """A fixed field of 45 bytes and 30 that vary: nearly all stretches have one of few minimisers."""
    rng = random.Random(seed)
    return "".join(f"{'level=info service=checkout-frontend region=eu ':<45.45}{rng.getrandbits(115):030x}"[:75] for _ in range(lines))


@pytest.mark.parametrize("hot", [2000, 30])
def test_repeats_of_a_frequent_field(spark, hot):
    """Minimisers of thousands of different stretches within three documents are dealt again by string."""
    rows = [(i, log_like(900, i)) for i in range(3)]
    rows += [(3, rows[0][1][1000:9000] + "tail" + rows[2][1][5000:5200])]
    asked = [(0, i, t.encode(), *repeats.minimisers(t.encode(), 50)) for i, t in rows]
    key, several, times = (x for x in zip(*((k, s, t) for _, _, k, s, t in repeats.ask_keys(asked, 1, 50)), strict=True))
    assert repeats.unpacked(times[0], "<u4").max() > 600
    want = brute.repeats(rows, 50)
    got = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=100_000, hot=hot).collect()
    assert brute.multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute.multiset((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_minimisers_of_pieces(monkeypatch):
    """A string has the same key however a long text is cut."""
    t = log_like(40, 1).encode() + bytes(random.Random(2).choices(b"abc ", k=4000))
    keys = []
    for piece in (1 << 20, 700):
        monkeypatch.setattr(repeats, "PIECE", piece)
        key, start, count = repeats.minimisers(t, 50)
        assert count.sum() == len(t) - 49 and (start[1:] == start[:-1] + count[:-1]).all()
        keys.append(np.repeat(key, count).tolist())
    assert keys[0] == keys[1]


def test_repeats_asks_a_row_a_shard():
    """However many blocks ask: a row for each pair of block and shard would hold a minimiser or two on many GB."""
    blocks, shards = 300, 75
    texts = [f"{i:03} " + "".join(chr(97 + (i * k * k + 7 * k) % 23) for k in range(400)) + " a passage that every third text has, of more than fifty bytes" * (i % 3 == 0) for i in range(900)]
    asked = [(i % blocks, i, t.encode(), *repeats.minimisers(t.encode(), 50)) for i, t in enumerate(texts)]
    rows = list(repeats.ask_keys(asked, shards, 50))
    assert len(rows) == len({r[0] for r in rows}) <= shards
    places: dict[int, set[int]] = {}
    for _, place, _, keys, _, _ in asked:
        for k in keys.tolist():
            places.setdefault(k, set()).add(place)
    for shard, *row in rows:
        answers = dict(repeats.answer_keys(*([x] for x in row), 2000))
        for b in range(blocks):
            mine = sorted({k for a in asked if a[0] == b for k in a[3].tolist() if repeats.shard_of(np.array([k], np.uint64), shards)[0] == shard}) if shard % 25 == 0 else []
            if mine:
                shared, hot = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=2 * len(mine)).reshape(2, -1)
                assert shared.tolist() == [len(places[k]) > 1 for k in mine]
                assert not hot.any()


@pytest.mark.parametrize("length", [9, 20, 300])
def test_repeats_of_other_lengths(docs, rows, length):
    want = brute.repeats([(place(r[0]), r[1]) for r in rows if r[0] != 64], length)
    got = repeats.drop_repeats(docs.filter("doc_id IS NULL OR doc_id <> 64"), length=length, block_bytes=4000).collect()
    assert brute.multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute.multiset((r[0], *w) for r, w in zip([r for r in rows if r[0] != 64], want, strict=True))


def test_repeats_query(spark, monkeypatch, docs, rows):
    use(monkeypatch, documents=docs)
    want = brute.repeats([(place(r[0]), r[1]) for r in rows], 50)
    got = queries.op3_repeats(spark, "").collect()
    assert brute.multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute.multiset((r[0], *w[:3], brute.sha256(w[3])) for r, w in zip(rows, want, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=12))
def test_collection_is_the_suffix_order(texts):
    raw = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in raw])
    c = repeats.Collection(np.frombuffer(b"".join(raw) + b"\0", np.uint8)[:-1], np.cumsum(sizes) - sizes, sizes, 10)
    got = [(int(o), int(a)) for o, a in zip(c.owner, c.at, strict=True)]
    want = sorted(((i, j) for i, t in enumerate(raw) for j in range(len(t) + 1)), key=lambda x: (raw[x[0]][x[1] :], x[0]))
    assert [raw[o][a:] for o, a in got] == [raw[o][a:] for o, a in want] and sorted(got) == sorted(want)
    for k in range(1, len(got)):
        x, y = (raw[o][a:] for o, a in (got[k - 1], got[k]))
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert c.common[k] == min(n, 10)


# 4


def test_mix(spark, monkeypatch, docs, rows):
    use(monkeypatch, documents=docs)
    got = queries.op4_mixing(spark, "").collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = brute.targets(sizes, [1, 2, 3], 3)
    assert brute.multiset((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == brute.multiset((r[0], size(r[1]), sizes[r[3]], round(want[r[3]], 6)) for r in rows)
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    again = queries.op4_mixing(spark, "").collect()
    assert brute.multiset(got) == brute.multiset(again)


def test_taken_words_against_brute_force(spark, docs, rows):
    got = brute.multiset((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect())
    assert got == brute.mix([(r[0], r[3], r[1]) for r in rows], [1, 2, 3], 3, 20, 64, mixing.RUN)


@pytest.mark.parametrize("counts", [(5, 10, 17), (1, 16, 33), (2, 3, 160)])
def test_taken_words_of_small_sources(spark, counts):
    """Places are a permutation of 0 to n - 1, so a source gives the copies that its own prefix sums say, give or take one."""
    rng = random.Random(sum(counts))
    rows = [(1000 * k + i, prose(rng, rng.randint(1, 300)), "en", f"s{k}", 0) for k, n in enumerate(counts) for i in range(n)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert brute.multiset((r.doc_id, r.size, r.taken) for r in out) == brute.mix([(r[0], r[3], r[1]) for r in rows], [1, 2, 3], 3, 20, 64, mixing.RUN)
    for k, n in enumerate(counts):
        mine = [r for r in out if r.source == f"s{k}"]
        copies = n * mine[0].target / mine[0].source_size
        assert len(mine) == n and abs(sum(r.copies for r in mine) - copies) < 1 and max(r.copies for r in mine) - min(r.copies for r in mine) <= 1


def test_mix_comes_near_the_targets(spark):
    rng = random.Random(6)
    many = [(i, prose(rng, rng.randint(1, 200)), "en", rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(many, DOCS)).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) < 0.01 * r.t for r in out)


def test_mixed_documents(docs, rows):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    got = out.groupBy("doc_id").count().collect()
    assert brute.multiset(got) == brute.multiset(copies)


# 5


def toxic_documents(n: int = 900) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(2)
    d, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(VOCABULARY) for _ in range(8)) for _ in range(rng.randint(2, 9))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['vilething', 'foulword', 'zzxqa', 'zzxqb', 'zzxqc'])}"
        d.append((i, ". ".join(sentences) + ".", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return d, labels


def test_toxicity_on_held_out_documents(spark, monkeypatch, rows):
    d, labels = toxic_documents()
    labels += [(None, 1, 1), (3, 1, None), (5, None, 7), (0, 1, 1)]
    frame = spark.createDataFrame(d + [(None, "vilething", None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0), d[0]], DOCS).withColumn("y", F.lit(3))
    use(monkeypatch, documents=frame, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = queries.op5_toxicity(spark, "").collect()
    assert len(got) == len(d) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert len(held) > 150 and right >= 0.95 * len(held)
    assert {r.doc_id: r.score for r in got}[5001] == 0


def test_scores_against_brute_force(spark):
    d, labels = toxic_documents(300)
    d += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "1234 ... !!\n", "en", "s", 0), (903, "vilething " * 30_000, "en", "s", 0), (904, "ÄÖ vilething\nfoulword", "de", "s", 0)]
    frame = spark.createDataFrame(d, DOCS)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for m in (model, toxicity.Model({}, -30.0)):
        got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(frame, m).collect()}
        for i, text, *_ in d:
            want = brute.toxicity(text, m.weights, m.bias, toxicity.BUCKETS)
            assert abs(got[i][0] - want) < 1e-9 and got[i][1] == int(got[i][0] >= 0.3)
        assert all(str(got[i][0]) == "0.0" for i in (900, 901, 902))
    assert max(s for s, _ in got.values()) == 0


def test_toxic_sentences_are_located(spark):
    d, labels = toxic_documents()
    frame = spark.createDataFrame(d, DOCS)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.score(frame.filter("doc_id = 4"), model).head()
    text = d[4][1]
    assert out.predicted == 1 and len(out.sentences) == 1
    s = out.sentences[0]
    assert any(w in text[s.start : s.end] for w in ("vilething", "foulword", "zzxq"))
    none = toxicity.fit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(frame, none).agg(F.max("predicted")).head()[0] == 0


def test_labels_of_held_out_documents_are_not_used(spark):
    d, labels = toxic_documents(300)
    frame = spark.createDataFrame(d, DOCS)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    one, two = (toxicity.fit(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert one == two


# 6


def page_rows() -> list[tuple]:
    rng = random.Random(1)
    big = "<p>" + prose(rng, 400) + "</p>"
    assert len(big) >= 1000
    out = [(i, f"http://a.example/{i} x\n", f"<html>{prose(rng, 30)}é😀\r\n\r\nWARC/1.1\r\n</html>") for i in range(40)]
    out += [(100 + i, "http://b.example/", big) for i in range(30)]
    out += [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", big), (None, "u", "x" * 2000), (129, "u", big), (300, "u", "y" * 300_000)]
    return out


def test_warc_against_brute_force(spark, monkeypatch):
    pages = page_rows()
    use(monkeypatch, pages=spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kept", F.lit(1)).repartition(3))
    best: dict[bytes, int] = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = best.get(b) is not None and i != best[b]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    assert brute.multiset(queries.op6_warc(spark, "").collect()) == brute.multiset(want)
    use(monkeypatch, pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert queries.op6_warc(spark, "").count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    """By records and by bytes; what is read again is the same, nulls and repeated rows included."""
    pages = [(i, "u", "z" * 50_000 + str(i)) for i in range(30)] + [(None, None, None), (3, "u", "z" * 50_000 + "3")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    records = warc.revisits(warc.arc_to_warc(warc.pages_to_arc(d))).coalesce(1)
    warc.write_warc(records, f"{tmp_path}/w", most_records=7, most_bytes=200_000)
    sizes = []
    for f in Path(f"{tmp_path}/w").rglob("*.gz"):
        raw = b"".join(warc.unzipped(f.read_bytes()))
        sizes.append((len(raw), raw.count(b"WARC/1.1")))
    assert len(sizes) >= 8 and max(b for b, _ in sizes) < 300_000 and max(n for _, n in sizes) <= 7
    got = warc.read_warc(spark, f"{tmp_path}/w").filter("record_type <> 'warcinfo'")
    assert brute.multiset((r.page_id, r.payload_bytes) for r in got.collect()) == brute.multiset((i, len(h or "")) for i, _, h in pages)


def test_arc_versions_and_damage():
    v1 = warc.arc_version_block("a.arc", 1, "20010203040506") + b"http://x/a b 1.2.3.4 20010203040506 text/html 5\nhello\n" + b"broken line\n" + b"http://y/ 1.2.3.4 20010203040507 text/plain 3\nabc\n"
    got = list(warc.read_arc(v1))
    assert [(r.fields["URL"], r.body) for r in got[1:]] == [("http://x/a b", b"hello"), ("http://y/", b"abc")]
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    v2 = warc.arc_version_block("b.arc", 2, "20010203040506") + warc.arc_line(2, "http://z/", "20010203040506", "text/html", 200, body, "b.arc", 99) + body + b"\n"
    r = list(warc.read_arc(v2))[1]
    assert (r.fields["Result-code"], r.fields["Filename"], r.body) == ("200", "b.arc", body)
    assert not list(warc.read_arc(b"")) and not list(warc.read_arc(b"no line end"))


def test_converter_synthesises_headers(spark):
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    arc = warc.arc_version_block("b.arc", 1, "20010203040506") + warc.arc_line(1, "http://z/", "20010203040506", "text/html", 200, body, "b.arc", 0) + body + b"\n" + b"dns:z 0 bad text/dns 4\n1234\n"
    out = warc.arc_to_warc(spark.createDataFrame([("b.arc", bytearray(arc)), (None, None), ("e", bytearray())], "arc_name string, content binary"))
    info, page, dns = out.collect()
    assert [r.record_type for r in (info, page, dns)] == ["warcinfo", "response", "resource"]
    assert (page.date, dns.date) == ("2001-02-03T04:05:06Z", "1970-01-01T00:00:00Z")
    assert page.record_id.startswith("urn:uuid:") and bytes(page.payload) == b"hi" and bytes(page.payload_sha1) == hashlib.sha1(b"hi").digest()
    assert base64.b32encode(bytes(page.payload_sha1))


def test_warc_reader_takes_small_pieces():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for size in (1, 3, 7, 1000):
        data = one * 3
        got = list(warc.warc_records(data[i : i + size] for i in range(0, len(data), size)))
        assert [b for _, b in got] == [b"ab\r\nc"] * 3


# 7


def test_packing(spark, monkeypatch, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    use(monkeypatch, documents=docs)
    got = sorted(queries.op7_packing(spark, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert (r.sequence_id * 2048 + r.offset, r.length > 0) == (at, True) and r.offset + r.length <= 2048
        at += r.length
    want = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], len(ids), ids))
    assert at == sum(n for _, n, _ in want)
    ids = {(i, n): x for i, n, x in want}
    assert brute.multiset((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == brute.multiset((i, n) for i, n, _ in want)
    for r in got:
        if r.doc_id not in (None, 5, 7):
            assert r.ids_crc32 == zlib.crc32(ids[(r.doc_id, r.doc_tokens)][r.start : r.start + r.length].tobytes())


def test_sequences_hold_the_ids(spark):
    d = spark.createDataFrame([(i, "some words to pack " * (i + 1)) for i in range(9)], "doc_id long, text string")
    p = packing.pack(d, window=16).persist()
    s = {r.sequence_id: r.ids for r in packing.sequences(p).collect()}
    encode = packing.load_encoder(packing.default_tokenizer())
    flat = []
    for r in p.orderBy("sequence_id", "offset").collect():
        assert list(np.frombuffer(bytes(r.ids), "<u4")) == s[r.sequence_id][r.offset : r.offset + r.length]
        flat.append((r.doc_id, r.start, list(np.frombuffer(bytes(r.ids), "<u4"))))
    for i in range(9):
        assert [x for j, _, ids in sorted(flat) if j == i for x in ids] == [*encode("some words to pack " * (i + 1)), 1]
    assert all(len(x) == 16 for k, x in s.items() if k < max(s))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_gives_the_ids_of_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert packing.load_encoder(path)(text) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "some <|endoftext|> words", " <|endoftext|><|endoftext|>\n", "<|endoftext |>"])
def test_added_tokens_are_those_of_the_plain_call(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.load_encoder(path)(text) == want and (50256 in want) == ("<|endoftext|>" in text)


LONG = {"spaces": " " * 3_000_000, "feeds": "\n" * 1_000_000, "before a letter": " " * 3_000_000 + "x", "inside": "word" + "\u2003" * 400_000 + "word", "letter": "a" * 1_000_000, "mixed": "\t \n" * 200_000 + "end"}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_runs_have_the_ids_of_tokenizers(name):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.load_encoder(path)(LONG[name]) == Tokenizer.from_file(path).encode(LONG[name], add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    d = spark.createDataFrame([(1, " " * 1_000_000), (2, "some words")], "doc_id long, text string")
    got = packing.pack(d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and all(r.n == r["all"] for r in got)


def test_other_tokenizer_files(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert json.load(open(path, encoding="utf-8"))["model"]
    assert len(packing.load_encoder(path)("some words")) >= 2


# 8


def spans_of(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in df.collect()}


def test_personal_data_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "@", ".", "1", "2", " ", "-", "+", "4111111111111111", "1.2.3.4", "b.c", "(", ")", "😀", "é", "\n", "_", "25", "555"]
    texts = [None, "", "a.b@c.d@e.f a@b.c_x@d.e", "999.1.2.3.4 001.2.3.0004 1.2.3.4.5.6.7.8", "1" * 4000, "a" * 4000 + "@", "+1" + " " * 3000, "4111  1111 1111 1111 4111 1111-1111 1111"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    got = spans_of(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.lit("x"))))
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == brute.personal(t), t


def test_added_kinds(spark):
    t = {1: "my IBAN is GB82 WEST 1234 5698 7654 32.", 2: "GB82 WEST 1234 5698 7654 33", 3: "social security 123-45-6789", 4: "part 123-45-6789 of it", 5: "ssn 000-45-6789"}
    got = spans_of(pii.find_pii(spark.createDataFrame(list(t.items()), "doc_id long, text string")))
    assert got[1] == [("iban", 11, 38)] and got[2] == [] and got[3] == [("ssn", 16, 27)] and got[4] == [] and got[5] == []


def test_ibans_end_where_their_country_says(spark):
    t = ["IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "ES9121000418450200051332 NOW", "BE68 5390 0754 7034 CALL", "NO93 8601 1117 947 and MT84 MALT 0110 0001 2345 MTLC AST0 01S", "XX82 WEST 1234 5698 7654 32", "xGB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32x"]
    got = spans_of(pii.find_pii(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")))
    assert got == {0: [("iban", 5, 34)], 1: [("iban", 0, 24)], 2: [("iban", 0, 19)], 3: [("iban", 0, 18), ("iban", 23, 61)], 4: [], 5: [], 6: []}


def test_many_spans_in_one_text(spark):
    """Places of 100,000 addresses, and what is left without them."""
    n = 100_000
    text = " ".join(f"ü{i} a{i}@b.example" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [(s.start, s.end) for s in pii.find_pii(d).head().spans]
    assert len(found) == n and all(text[s:e] == f"a{i}@b.example" for i, (s, e) in enumerate(found))
    assert pii.redact(d).head().text == " ".join(f"ü{i} <email>" for i in range(n))


def test_redaction_of_overlapping_spans(spark):
    """Held against a plain loop, on texts with matches of several kinds over one another."""
    rng = random.Random(12)
    bits = ["a@b.c", "4111111111111111", "+1 (988) 555-2485", "1.2.3.4", "+14111111111111111", " ", "x", "é😀", "-", "y" * 700, "BE68539007547034"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["a@b.c " * 700]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = spans_of(pii.find_pii(d))
    for r in pii.redact(d).collect():
        at, want = 0, ""
        for kind, s, e in found[r.doc_id]:
            if s >= at:
                want += texts[r.doc_id][at:s] + f"<{kind}>"
            at = max(at, e)
        assert r.text == want + texts[r.doc_id][at:]


def test_context_raises_the_score(spark):
    d = spark.createDataFrame([(1, "call me: +1 (988) 555-2485"), (2, "it is +1 (988) 555-2485")], "doc_id long, text string")
    s = {r.doc_id: r.spans[0].score for r in pii.find_pii(d).collect()}
    assert s[1] > s[2]
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == ["call me: <phone>", "it is <phone>"]


def test_redaction_follows_the_spans(spark):
    """Kinds beyond the base ones go, what the checks turn down stays, and texts around the spans are kept."""
    texts = ["iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789 😀", "no card 4111 1111 1111 1112, no ip 999.1.1.1", "card 4111 1111 1111 1111 and a.b@c.de!", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.redact(d).orderBy("doc_id").collect()]
    assert got == ["iban <iban>, ssn <ssn> 😀", texts[1], "card <card> and <email>!", "", ""]


def test_pii_query(spark, monkeypatch, docs, rows):
    use(monkeypatch, documents=docs)
    q = queries.op8_pii(spark, "")
    plan = q._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = brute.multiset((r[0], brute.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal(r[1])).encode())) for r in rows)
    assert brute.multiset((r.doc_id, r.base_sha256) for r in q.collect()) == want


# 9


@pytest.mark.parametrize("least", [50, 5, 1])
def test_lines_against_brute_force(docs, rows, least):
    gone = brute.line_runs([(place(r[0]), r[1]) for r in rows], least)
    want = []
    for r, g in zip(rows, gone, strict=True):
        lines = (r[1] or "").split("\n")
        kept = r[1] if not g else "\n".join(x for i, x in enumerate(lines) if i not in g)
        want.append((r[0], kept, len(lines)))
    got = linededup.dedup_lines(docs, least).collect()
    assert brute.multiset((r.doc_id, r.text, r.n_lines) for r in got) == brute.multiset(want)


def test_seeds_are_what_documents_share():
    shared = [f"line number {i} of the passage with more words" for i in range(8)]
    a = linededup.seeds("\n".join(["one line here"] + shared + ["x"]).encode(), 20)
    b = linededup.seeds("\n".join(shared + ["other text", "and more"]).encode(), 20)
    assert {fp for fp, _, _ in a} & {fp for fp, _, _ in b}
    reach = [{c for _, _, r in x for c, _, _ in r} for x in (a, b)]
    # Every window of the passage alone is in both: 9 words a line, so 3 lines each.
    assert len(reach[0] & reach[1]) >= 6
    long = linededup.seeds("\n".join(f"line {i} {i * 7919 % 1000}" for i in range(3000)).encode(), 50)
    assert len(long) < 3000 / 4  # a window has 17 lines, so about one place in nine is selected


def test_documents_of_which_nothing_is_left(spark):
    """Whether or not a line feed ends the text; texts that never had a word stay."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [passage + "\n", passage + "\n", passage, f"\n{passage}\n \t\n", passage + "\nmore", "", "\n", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.text) for r in linededup.dedup_lines(d).collect()}
    assert {i for i, (kept, _) in got.items() if kept} == {0, 4, 5, 6}
    assert got[4][1] == "more" and got[5][1] == "" and got[7] == (False, None)


def test_lines_of_a_long_text(spark):
    """600 kB: runs in the middle of long texts, a line repeated on and on, and one very long line."""
    rng = random.Random(3)
    lines = [prose(rng, 12) for _ in range(8000)]
    other = [*(prose(rng, 12) for _ in range(3000)), *lines[4000:4030], *(prose(rng, 12) for _ in range(3000))]
    one = prose(rng, 20_000, 20_000)
    rows = [(1, "\n".join(lines)), (2, "\n".join(other)), (3, "again and again\n" * 20_000), (4, one), (5, f"x\n{one}\ny")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(1, 6)] == [0, 30, 19_999, 0, 1]
    assert got[2].text == "\n".join(other[:3000] + other[3030:]) and got[5].text == "x\ny"


# 10


def test_media_query(spark, monkeypatch, docs, rows):
    use(monkeypatch, documents=docs)
    got = queries.op10_media(spark, "").collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        m = media.wav_header(len(p)) + p
        want.append((r[0], len(b), len(p), brute.sha256(p), zlib.crc32(p[-64:]), len(m), brute.sha256(m)))
    assert brute.multiset((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == brute.multiset(want)
    assert all(r.feature.startswith("audio/wav;") for r in got)
    one = media.wav_features(media.identify(media.text_as_wav(docs), id_col="id")).collect()
    assert brute.multiset((r.id, r.feature) for r in one) == brute.multiset((r.doc_id, r.feature) for r in got)


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples() -> dict[str, bytes]:
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xda\x00\x04\x01\x00\x12\xff\x00\x34\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    return {"image/png": png(), "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "application/gzip": gzip.compress(b"hello" * 100), "application/zip": z.getvalue(), "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF", "audio/wav": media.wav_header(64) + bytes(64)}


def test_types_are_corrected_and_media_carved(spark):
    made = samples()
    rows = [(i, bytearray(b), "text/plain") for i, b in enumerate(made.values())]
    rows += [(100, bytearray(b"junk" + made["image/png"] + b"RIFF more BM" + made["audio/wav"] + b"tail"), "text/plain"), (101, None, None), (102, bytearray(b"\x89PNG\r\n\x1a\nbroken"), "text/x"), (103, bytearray(made["image/png"][:-3]), None)]
    out = media.identify(spark.createDataFrame(rows, "doc_id long, media binary, declared string"))
    got = {r.id: (r.media_type, r.length) for r in out.collect()}
    for i, (kind, b) in enumerate(made.items()):
        assert got[i] == (kind, len(b))
    assert got[100][0] == "text/plain" and got[101] == (None, 0) and got[102][0] == "text/x" and got[103][0] is None
    parts = {(r.media_type, bytes(r.data)) for r in media.carve(out.filter("id = 100")).collect()}
    assert parts == {("image/png", made["image/png"]), ("audio/wav", made["audio/wav"])}


# All


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.split("_")[0] not in ("op2", "op6")])
def test_empty_tables(spark, monkeypatch, nothing, name):
    use(monkeypatch, documents=nothing, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert queries.QUERIES[name](spark, "").count() == 0
