"""Queries that SQL cannot express, against plain Python on the whole sf0.001 table and made rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventfold.llm import mixing, near_dup, ngram_lm, packing, quality, recompression, secret_scan, syncmers, tokenfile, toxicity
from eventfold.llm.common import ship_package
from eventfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def frame(spark, texts):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def encode(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for x in texts]


# --- near duplicates ----------------------------------------------------------

def shingles(text, n=3):
    w = (text or "").encode().lower().split()
    if len(w) >= n:
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    """rows: (id, text); all pairs of distinct texts."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b:
                both = len(a & b)
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[find(i)], least[find(i)] == d) for i, (d, s) in enumerate(sets)]


def test_near_duplicates_against_all_pairs(spark, docs):
    got = sorted(tuple(r) for r in QUERIES["op2_near_duplicates"](spark, SF).collect())
    assert got == sorted(brute_components(docs))


def edits(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_chains_and_dense_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)] * 4 + [edits(rng, base, rng.randrange(1, 9)) for _ in range(160)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):  # neighbours are close, the ends are not
        chain[4 * i % 120] = f"x{i}"
        texts.append(" ".join(chain))
    texts += ["", None, "one", "one", "one two", "ONE two", " one\ttwo ", "é É", "É É"]
    df = frame(spark, texts)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted(brute_components(list(enumerate(texts))))


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = [edits(rng, base, rng.randrange(1, 9)) for _ in range(80)]
    monkeypatch.setattr(near_dup, "LEFT_BLOCK", 7)
    monkeypatch.setattr(near_dup, "RIGHT_PART", 20)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, texts)).collect())
    assert got == sorted(brute_components(list(enumerate(texts))))


@pytest.mark.parametrize("chunk", [4, 5])
def test_buckets_longer_than_a_piece_lose_no_member(spark, monkeypatch, chunk):
    """Groups of alike sets that end one, two or more members after a piece of a bucket."""
    ship_package(spark)
    for size in (chunk + 1, chunk + 2, 2 * chunk, 2 * chunk + 1, 2 * chunk + 2, 3 * chunk + 2):
        node = np.arange(size + 3, dtype=np.int64)
        key = np.array([7] * size + [8] * 3, np.int64)
        sig = np.zeros((size + 3, 1), np.int64)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(node), pa.ListArray.from_arrays(pa.array(np.arange(size + 4, dtype=np.int32)), pa.array(sig.reshape(-1)))],
            names=["key", "node", "signature"])
        monkeypatch.setattr(near_dup, "CHUNK", chunk)
        for batches in ([batch], [batch.slice(i, 1) for i in range(size + 3)], [batch.slice(0, chunk), batch.slice(chunk)]):
            out = pa.Table.from_batches(list(near_dup._forest(near_dup.Estimator(32, 2), 0.5)(iter(batches)))).to_pydict()
            members = sorted(a for k, a in zip(out["kind"], out["a"]) if k == 1)
            assert members == node.tolist(), (size, members)
            root = list(range(size + 3))
            for k, a, b in zip(out["kind"], out["a"], out["b"]):
                if k == 0:
                    ra, rb = root[a], root[b]
                    root = [rb if r == ra else r for r in root]
            assert len(set(root[:size])) == 1 and len(set(root[size:])) == 1 and len(set(root)) == 2


def test_ids_of_the_whole_range(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2**63 - 1, text), (2**62 + 5, text), (-2**63, "other words are here"), (None, text), (None, "lone text without id"), (2**62, None)]
    ship_package(spark)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.op2(df).collect()), key=repr)
    least = 2**62 + 5
    assert got == sorted([(2**63 - 1, least, False), (least, least, True), (-2**63, -2**63, True), (None, least, False), (None, None, True),
                          (2**62, 2**62, True)], key=repr)


def test_dedup_stage_keeps_one_row_of_null_and_repeated_ids(spark):
    ship_package(spark)
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, a), (None, a), (4, a), (4, a), (9, a), (None, b), (None, b), (None, b + " more"), (None, None), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(d, t, "x", 0, 1) for d, t in rows], "doc_id bigint, text string, row string, n int, c int").repartition(4)
    out = near_dup.keep_one(df)
    got = sorted(((r.doc_id, (r.text or "")[:2]) for r in out.collect()), key=repr)
    assert out.columns == df.columns
    assert got == sorted([(4, "a0"), (None, "b0"), (None, ""), (None, ""), (3, ""), (3, "")], key=repr)
    assert near_dup.keep_one(df.filter("false")).count() == 0


def test_sequence_ids_differ_at_any_scale(spark):
    rows = [(s, c, b) for s in (0, 1, 2**20, 2**21, 2**21 + 1, 2**31 - 1) for c in (0, 1, 2048) for b in (0, 1, 2**20 - 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "s bigint, c bigint, b bigint")
           .select(packing.sequence_id(F.col("s"), F.col("c"), F.col("b"))).collect()]
    assert len(set(got)) == len(rows) and min(got) == 0


def test_rows_without_id_take_part(spark):
    ship_package(spark)
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (7, t), (None, "alone one two three"), (9, t + " more")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (None, None, True), (9, 7, False)], key=str)


def test_estimate_follows_similarity():
    import pyarrow as pa
    run = near_dup._signatures(3, 24, 5, 2)
    base = [f"w{i}" for i in range(400)]
    other = base[:300] + [f"z{i}" for i in range(100)]
    out = next(run(iter([pa.RecordBatch.from_pydict({"n": [0, 1], "t": [" ".join(base), " ".join(other)]})])))
    sig = near_dup._matrix(out.column(4))
    e = near_dup.Estimator(120, 2)
    a, b = shingles(" ".join(base)), shingles(" ".join(other))
    assert abs(float(e(sig[0], sig[1])) - len(a & b) / len(a | b)) < 0.2
    assert float(e(sig[0], sig[0])) == 1.0


# --- recompression ------------------------------------------------------------

def brute_removed(rows, n=13):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_recompression_on_the_whole_table(spark, docs):
    assert sorted(tuple(r) for r in QUERIES["op5_recompression"](spark, SF).collect()) == brute_removed(docs)


def test_recompression_finds_repeats_of_every_shape(spark):
    rng = random.Random(7)
    texts = []
    for alphabet in (1, 2, 3, 50):  # runs and short periods are the hard cases
        for _ in range(25):
            texts.append(" ".join(f"a{rng.randrange(alphabet)}" for _ in range(rng.randrange(0, 60))))
    passage = " ".join(f"p{i}" for i in range(13))
    texts += [f"x y {passage} z", f"{passage}", f"q {passage}", "a " * 6 + "b " + "a " * 30, "c " + "a " * 20 + "b " + "a " * 6, None, ""]
    got = sorted(tuple(r) for r in recompression.dedup(frame(spark, texts)).collect())
    assert got == brute_removed(list(enumerate(texts)))


def brute_rows(rows, n=13):
    """Like ``brute_removed`` on rows (id or None, text) with repeated and missing ids: no id counts as the last."""
    key = lambda d: (d is None, d or 0)
    by = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i:i + n])
            by[k] = min(by.get(k, key(d)), key(d))
    out = []
    for d, t in rows:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - n + 1):
            if by[tuple(w[i:i + n])] < key(d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def long_repeats(seed):
    """Documents made of shared passages of 20 to 900 words, with own words between, edits inside, and whole copies."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randrange(4000)}" for _ in range(rng.choice((20, 51, 120, 900)))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(passages).split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edit"
            lo = rng.randrange(len(words)) if rng.random() < 0.3 else 0
            parts += [" ".join(words[lo:]), " ".join(f"o{rng.randrange(90000)}" for _ in range(rng.randrange(0, 40)))]
        texts.append("  ".join(parts))
    return texts + texts[:15]


def test_recompression_of_long_repeats_and_missing_ids(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.33 else rng.choice((5, 9, i, (1 << 63) - 1)), t) for i, t in enumerate(long_repeats(5))]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, lo string")
    for long in (13, 26, 10 ** 6):  # every span, the default, none: the edges alone must do it too
        got = sorted((tuple(r) for r in recompression.dedup(df, long=long).collect()), key=str)
        assert got == brute_rows(rows)


def test_symbols_cover_a_copied_document():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(3000))
    w = recompression.words(pa.array([text, "x " + text + " y", text]), False)
    name, lo, hi, row = recompression.long_symbols(recompression.first_rounds(w), 26)
    of = [set(name[row == i].tolist()) for i in range(3)]
    assert of[0] == of[2] and max((hi - lo)[row == 0]) == 3000
    inside = np.isin(name, list(of[0])) & (row == 1)  # all but the edges of a text that stands in another
    cover = np.zeros(len(w.hashes), bool)
    for a, b in zip(lo[inside], hi[inside]):
        cover[a:b] = True
    assert cover[w.rows[1]:w.rows[2]].sum() > 2800


def test_same_id_does_not_remove_from_itself(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (1, "x " + t), (2, t)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in recompression.dedup(df).collect()) == [(1, 0), (1, 0), (2, 20)]


# --- n-gram model -------------------------------------------------------------

def test_elias_fano_holds_any_rising_sequence():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 50), (1000, 2**40), (5000, 2**63)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        ef = ngram_lm.EliasFano.encode(v)
        i = np.arange(n)
        assert (ef.get(i) == v).all()
        if n > 1:
            one, two = ef.get_two(i[:-1])
            assert (one == v[:-1]).all() and (two == v[1:]).all()
        lo, hi = np.zeros(n, np.int64), np.full(n, n)
        assert (v[ef.find(v, lo, hi)] == v).all() if n else True
        absent = np.setdiff1d(rng.integers(0, top, 200, dtype=np.uint64), v)
        assert (ef.find(absent, np.zeros(len(absent), np.int64), np.full(len(absent), n)) == -1).all()


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_plain_counts(spark, docs, order):
    got = {r.doc_id: r for r in ngram_lm.op3(spark.read.parquet(f"{SF}/documents.parquet"), order).collect()}
    toks = {d: x.encode().lower().split() + [None] for d, x in docs}
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    c = [collections.Counter() for _ in range(order + 1)]
    for d, w in toks.items():
        if d not in held:
            c[1].update(w)
            for n in range(2, order + 1):
                p = [None, *w]
                c[n].update(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
    total, distinct = sum(c[1].values()), len(c[1])
    kept = [None, None] + [{g: n for g, n in x.items() if n >= 2} for x in c[2:]]
    count = lambda u: c[1][u[0]] if len(u) == 1 else kept[len(u)].get(u, 0)
    left = {}
    for n in range(2, order + 1):
        for g, k in kept[n].items():
            if count(g[:-1]):
                left[g[:-1]] = left.get(g[:-1], 1) - (k - 0.75) / count(g[:-1])

    def p(w, u):
        if not u:
            return (c[1][w] + 1) / (total + distinct + 1)
        low = p(w, u[1:])
        if not count(u):
            return low
        k = kept[len(u) + 1].get(u + (w,), 0)
        return (k - 0.75) / count(u) * (k > 0) + left.get(u, 1) * low
    for d, w in toks.items():
        x = [None, *w]
        score = sum(math.log10(p(x[i], tuple(x[max(0, i - order + 1):i]))) for i in range(1, len(x)))
        base = sum(math.log10(p(t, ())) for t in w)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(w), sum(c[1][t] > 0 for t in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - score) <= 0.03 * order * len(w)  # 8-bit codes
    tokens = sum(got[d].n_tokens for d in held)
    assert sum(got[d].score for d in held) / tokens > sum(got[d].base_score for d in held) / tokens


# --- tokens: files and packing -------------------------------------------------

def test_token_files_round_trip(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, SF).collect()}
    at = 0
    for (d, _), ids in zip(docs, encode("word_bpe_49k.json", [t for _, t in docs])):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_reader_decompresses_only_what_it_is_asked_for(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(i if i % 7 else None, rng.integers(0, 60_000, rng.integers(1, 500), dtype=np.uint16).tobytes()) for i in range(200)]
    with open(tmp_path / "f", "wb") as out:
        w = tokenfile.FrameWriter(out, 2, frame_ids=256)
        for d, ids in docs:
            w.add(d, ids)
        w.close()
    with open(tmp_path / "f", "rb") as source:
        r = tokenfile.FrameReader(source)
        assert [(d, ids) for d, _, ids in r.documents()] == docs
        read = []
        inner = r._frame
        r._frame = lambda i: read.append(i) or inner(i)
        assert [ids for _, _, ids in r.documents(r.find([5, 190]))] == [docs[5][1], docs[190][1]]
        assert len(read) <= 8 < len(r.packed)
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[20] ^= 1
    (tmp_path / "f").write_bytes(raw)
    with open(tmp_path / "f", "rb") as source, pytest.raises(Exception):
        list(tokenfile.FrameReader(source).documents())


def test_pieces_cover_documents_and_sequences(spark, docs):
    ref = dict(zip([d for d, _ in docs], encode("byte_bpe_50k.json", [t for _, t in docs])))
    rows = QUERIES["op10_harmonic_packing"](spark, SF).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ref.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ref[d]) and r.ids_crc32 == zlib.crc32(ref[d][at:at + r.length].tobytes())
            at += r.length
        assert at == len(ref[d])
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    assert padded < 1.03 * used


def test_piece_lengths():
    for n in list(range(1, 5000)) + [10**6]:
        p = packing.piece_lengths(n)
        assert sum(p) == n and all(0 < x <= 2048 for x in p)


def test_encoder_equals_the_library_on_odd_white_space():
    import public_tokenizers
    from eventfold.llm.tokens import Encoder
    rng = random.Random(3)
    alphabet = list("ab'sIt1 ,.!\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éé́ß世<|endoftext|>   ") + ["\n\n", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        got = Encoder.of(public_tokenizers.path(name), drops).ids(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e[:-1].tolist() for e in encode(name, texts)]


# --- fingerprints ---------------------------------------------------------------

def brute_syncmers(text, k=syncmers.K, s=syncmers.S):
    """Positions of closed syncmers by definition, with the module's s-mer hashes."""
    points = syncmers._mix(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    inner = syncmers._windows(points, s, 0xD1B54A32D192ED03).tolist()
    out = []
    for i in range(len(text) - k + 1):
        w = inner[i:i + k - s + 1]
        if min(w) in (w[0], w[-1]):
            out.append(i)
    return out


def test_syncmers_by_definition():
    rng = random.Random(4)
    for n in (16, 17, 40, 300):
        t = "".join(rng.choice("abcé世 ") for _ in range(n))
        assert syncmers.anchors(t)[1].tolist() == brute_syncmers(t)
    t = "".join(rng.choice("abcdefgh ") for _ in range(400))
    inside, outside = syncmers.anchors(t[100:300]), syncmers.anchors(t)
    assert set(zip(inside[0].tolist(), (inside[1] + 100).tolist())) <= set(zip(outside[0].tolist(), outside[1].tolist()))
    gaps = np.diff(outside[1])
    assert gaps.max() <= syncmers.K - syncmers.S


def brute_likeness(t, u, kept=syncmers.KEPT):
    """By definition: the least hashes with their first positions, the anchors below the threshold
    of both texts, the longest chain of shared ones that stand in order in both."""
    def sample(x):
        first = {}
        for h, p in zip(*(v.tolist() for v in syncmers.anchors(x))):
            first.setdefault(h >> 32, p)
        return sorted(first)[:kept], first, len(first) > kept

    (a, pa_, more_a), (b, pb, more_b) = sample(t), sample(u)
    limit = min([x[-1] for x, more in ((a, more_a), (b, more_b)) if more], default=1 << 32)
    a, b = {h for h in a if h <= limit}, {h for h in b if h <= limit}
    if not a | b:
        return 1.0
    shared = sorted(a & b, key=pa_.get)
    best = []
    for i, h in enumerate(shared):
        best.append(1 + max([best[j] for j in range(i) if pb[shared[j]] < pb[h]], default=0))
    return max(best, default=0) / len(a | b)


def test_fingerprints_of_neighbours(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_closed_syncmers"](spark, SF).collect()}
    order = docs[::-1]
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        e = syncmers.edited(t, following)
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        f = [syncmers.fingerprint(x).pack().hex() for x in (t, e)]
        assert (r.fingerprint, r.edited_fingerprint) == (f[0], f[1])
        assert (r.near_edited, r.near_next) == (brute_likeness(t, e), brute_likeness(t, following))
    assert syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("")) == 1.0
    assert syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("x")) == 0.0


def test_fingerprints_match_by_position():
    rng = random.Random(6)
    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))

    a, b, c = prose(300), prose(300), prose(300)
    near = lambda t, u: syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(u))
    assert near(a, a) == 1.0 and near(a, b) == 0.0
    for t, u in ((a, a + " " + b), (a + b, b + a), (a + b + c, a + c), (a * 3, a), (a[:40], a)):
        assert near(t, u) == brute_likeness(t, u)
    kept, swapped = near(a + b + c, a + c), near(a + b, b + a)
    assert 0.45 < kept < 0.9 and 0.3 < swapped < 0.75  # passages that change places count once
    chain = syncmers.aligned(syncmers.fingerprint(a + b), syncmers.fingerprint(c + a + b))
    assert chain and all(v - u == len(c) for u, v in chain) and chain == sorted(chain)
    # the sample's threshold falls as texts grow: long unrelated texts stay apart
    points = "".join(map(chr, range(0x4E00, 0x9000)))
    long = ["".join(rng.choices(points, k=1 << 20)) for _ in range(2)]
    assert near(*long) < 0.02 and near(long[0], long[0][:1 << 19] + long[1]) > 0.1


def test_fingerprints_without_ids_fall_into_several_ranges(spark):
    """A third of the rows has no id; all are compared along (id, text hash, text)."""
    rows = [(i if i % 3 else None, f"text {i % 50} " * (i % 7)) for i in range(600)]
    got = syncmers.compare_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(d or 0 for d, _ in rows)
    prints = lambda key: sorted(map(key, got))
    assert prints(lambda r: (r.doc_id or 0, r.fingerprint)) == sorted((d or 0, syncmers.fingerprint(t).pack().hex()) for d, t in rows)


def test_a_fingerprint_holds_every_anchor():
    rng = random.Random(8)
    for n in (0, 5, 16, 400, 30_000):
        t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        first = {}
        for h, p in zip(*(v.tolist() for v in syncmers.anchors(t))):
            first.setdefault(h >> 32, p)
        f = syncmers.fingerprint(t)
        assert dict(zip(f.hashes.tolist(), f.positions.tolist())) == first and not f.full
        packed = f.pack()
        assert np.frombuffer(packed[:4 * len(first)], "<u4").tolist() == sorted(first, key=first.get) and len(packed) == 8 * len(first) + 1
    # a changed word in a long text shows, wherever it stands
    u = t[:12_345] + "zzzzzzzzzzzzzzzz" + t[12_361:]
    a, b = (set((syncmers.anchors(x)[0] >> np.uint64(32)).tolist()) for x in (t, u))
    assert syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(u)) == len(a & b) / len(a | b) < 1


@pytest.mark.parametrize("rows", [
    [(1, "alone")], [(None, "a"), (None, "b")], [(7, f"text {i}") for i in range(60)],
    [(9 if i % 2 else -i, f"t{i % 9}") for i in range(80)] + [(None, f"n{i}") for i in range(40)] + [(-(1 << 63), "least"), ((1 << 63) - 1, None)]])
def test_neighbours_across_ranges(spark, rows):
    """Every row is met once by the next one, ids missing or repeated and ranges many: an id falls into several."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr("xxhash64(coalesce(text, ''))").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = sorted((r.doc_id or 0, len(r.text), hashlib.sha256(syncmers.edited(r.text, n.text).encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1]))
    got = syncmers.compare_neighbours(df)
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got.collect()) == want
    at = syncmers._ranges(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    number = at(np.array([r.doc_id is not None for r in order]), np.array([r.doc_id or 0 for r in order]), np.array([r.h for r in order])).tolist()
    assert number == sorted(number) and 0 <= number[0] and number[-1] < len(at)
    assert len(set(number)) > 1 or len(rows) < 60


# --- toxicity --------------------------------------------------------------------

def test_held_out_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.1"  # enough held-out toxic documents to count
    rows = QUERIES["op1_nnpu_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = [(r.held_out, r.toxic, r.predicted, r.score) for r in rows.join(labels, "doc_id").collect()]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, p, s in got)
    toxic = [p for h, y, p, _ in got if h and y == 1]
    clean = [p for h, y, p, _ in got if h and y == 0]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02


def test_risk_step_against_numbers():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.random((n, 6)) < 0.2
    truth = x[:, 0]
    positive = truth & (rng.random(n) < 0.5)
    rows, cols = np.nonzero(x)
    w, bias = toxicity.train(rows, cols, positive, 6, float(truth.mean()))
    score = x @ w + bias
    assert score[truth].min() > score[~truth].max()


def test_scores_without_texts_or_labels(spark):
    df = frame(spark, ["", None, "some text"])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.op1(df, labels).collect()
    assert len(got) == 3 and all(r.predicted == 0 for r in got)


# --- the pipeline -----------------------------------------------------------------

def test_pipeline_against_brute_stages(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    rules = {r.doc_id: r.kept for r in quality.op7(source).collect()}
    rows = {r.doc_id: r for r in source.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(stages) == 5

    kept = stages["quality rules"](spark, source, SF)
    good = sorted(d for d in rows if rules[d])
    assert kept.columns == source.columns and sorted(r.doc_id for r in kept.collect()) == good

    one = stages["MinHash near-dedup"](spark, kept, SF)
    stay = stage_components([(d, rows[d].text) for d in good])
    assert one.columns == source.columns and sorted(r.doc_id for r in one.collect()) == stay

    masked = stages["secret scans"](spark, one, SF)
    found = {r.doc_id: r for r in secret_scan.op9(one).collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert sorted(after) == stay and masked.columns == source.columns
    for d in stay:
        assert (after[d].text == rows[d].text) == (found[d].n_live == 0)
    assert sum("<secret>" in after[d].text for d in stay) == sum(found[d].n_live > 0 for d in stay)

    mixed = stages["mixing sources to target weights"](spark, masked, SF)
    took = {r.doc_id: r for r in mixing.mix(masked).collect()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == source.columns and set(copies) <= set(stay)
    assert all(0 <= copies[d] <= 3 and abs(copies[d] - took[d].taken / max(1, took[d].size)) < 1 for d in stay)

    packed = corpus_pipeline.run(spark, SF)
    ids = dict(zip(stay, encode("byte_bpe_50k.json", [after[d].text for d in stay])))
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == sum(len(ids[d]) * n for d, n in copies.items())
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == copies


def test_mix_comes_near_its_targets(spark):
    rows = QUERIES["op4_source_mix"](spark, "/root/testdata/sf0.01").collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]


def test_targets_with_stopped_sources(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 40):
        sizes = [(f"s{i:02}" if i else None, rng.choice([0, 1, 7, 50, 1000, 20_000])) for i in range(n)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size bigint")).collect()}
        order = sorted((s for s, _ in sizes if s), key=str) + [s for s, _ in sizes if s is None]
        size, weight = dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, fixed, want = sum(size.values()), {}, {}
        while len(fixed) < n:
            free = [s for s in order if s not in fixed]
            left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
            want = {s: left * weight[s] / w for s in free}
            over = [s for s in free if want[s] > 3 * size[s]]
            if not over:
                break
            fixed.update((s, 3.0 * size[s]) for s in over)
            want = {}
        want.update(fixed)
        assert got == pytest.approx(want)


def stage_components(rows, n=5, percent=80):
    """The ids that stay when one document of each group on ``n``-word shingles does."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    group = {d: {d} for d, _ in sets}
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both) and group[d] is not group[e]:
                group[d] |= group[e]
                for x in group[e]:
                    group[x] = group[d]
    return sorted(d for d, _ in sets if min(group[d]) == d)


def test_dedup_stage_takes_five_words_at_080(spark, docs):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(1000)]
    texts = [" ".join(base), " ".join(base + [f"n{i}" for i in range(200)])]  # similarity about 0.83 at any shingle length
    base = [f"d{i}" for i in range(1000)]
    texts += [" ".join(base)] + [edits(rng, base, n) for n in (10, 20, 26, 40)]  # 26 scattered edits: above 0.85 on 3 words, below 0.8 on 5
    got = sorted(r.doc_id for r in near_dup.keep_one(frame(spark, texts)).collect())
    assert got == stage_components(list(enumerate(texts))) and 1 not in got
    got = sorted(r.doc_id for r in near_dup.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == stage_components(docs)


def emitted(rows, out):
    """Words per source: those of the mix stage's output, and the targets."""
    got, target = collections.Counter(), {}
    for r in out:
        got[r.source] += len((r.text or "").split())
    for r in rows:
        target[r.source] = r.target
    return got, target


def test_mix_stage_reaches_its_targets(spark):
    rng = random.Random(10)
    rows = []
    for source, n in (("a", 300), ("b", 300), ("c", 2000), ("d", 300), ("e", 300), ("f", 300)):  # c is hot and weighs 1
        rows += [(len(rows) + i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(5, 150))), "en", source, 0) for i in range(n)]
    rows += [(None, f"no id {i} " * 10, "en", "a", 0) for i in range(50)] + [(7, "again and again", "en", "b", 0)] * 20 + [(8, None, None, None, 0)]
    ship_package(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.apply_mix(df).collect()
    got, target = emitted(mixing.mix(df).collect(), out)
    for s in "abcdef":
        assert abs(got[s] - target[s]) <= 64 + 150, (s, got[s], target[s])
    assert sum(r.doc_id == 8 and r.text is None for r in out) == 1
    assert sum(got.values()) == pytest.approx(sum(target.values()), rel=0.01)


def test_mix_stage_on_the_generated_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(df).collect()
    got, target = emitted(rows, mixing.apply_mix(df).collect())
    for s in target:
        assert abs(got[s] - target[s]) <= 64 + max(r.size for r in rows if r.source == s)


SPECIAL = ["see <|endoftext|> here", "<|startoftext|><|endoftext|>", "a  <|endoftext|>\n\nb <|ENDOFTEXT|> c", "x<|endoftext|>y <|startoftext|>",
           "<|endoftext", "plain words here", "", None]


def encode_by_default(name, texts):
    """The library's own call, special tokens left at their default."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_literal_special_tokens_get_their_ids(spark):
    import public_tokenizers
    from eventfold.llm.tokens import Encoder
    rng = random.Random(11)
    texts = SPECIAL + ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", " ", "\n", "ab", "'s", "É", "<|"]) for _ in range(12)) for _ in range(300)]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        got = Encoder.of(public_tokenizers.path(name), drops).ids(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e[:-1].tolist() for e in encode_by_default(name, texts)]
    want = encode_by_default("word_bpe_49k.json", SPECIAL)
    rows, at = {r.doc_id: r for r in tokenfile.op8(frame(spark, SPECIAL)).collect()}, 0
    for d, ids in enumerate(want):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    want = encode_by_default("byte_bpe_50k.json", SPECIAL)
    assert {r.doc_id: r.doc_tokens for r in packing.op10(frame(spark, SPECIAL)).collect()} == {d: len(ids) for d, ids in enumerate(want)}


def test_registered_model_keeps_every_trigram(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op3_elias_fano_lm"](spark, SF).collect()}
    toks = {d: x.encode().lower().split() + [None] for d, x in docs}
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    c = [collections.Counter() for _ in range(4)]
    for d, w in toks.items():
        if d not in held:
            c[1].update((t,) for t in w)
            for n in (2, 3):
                p = [None, *w]
                c[n].update(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
    total, distinct = sum(c[1].values()), len(c[1])
    spread = collections.Counter(g[:-1] for n in (2, 3) for g in c[n])

    def p(w, u):
        if not u:
            return (c[1][(w,)] + 1) / (total + distinct + 1)
        low, k, n = p(w, u[1:]), c[len(u) + 1][u + (w,)], c[len(u)][u]
        return (max(k - 0.75, 0) + 0.75 * spread[u] * low) / n if n else low
    for d, w in toks.items():
        x = [None, *w]
        score = sum(math.log10(p(x[i], tuple(x[max(0, i - 2):i]))) for i in range(1, len(x)))
        assert abs(got[d].score - score) <= 0.03 * 3 * len(w)


def test_byte_level_texts_are_encoded_whole():
    """A text of units that nobody met before costs no memory of units, and has the library's ids."""
    import public_tokenizers
    from eventfold.llm.tokens import Encoder
    rng = random.Random(29)
    texts = [None, "", " ", *(" ".join(f"{rng.randrange(10**9)}x{rng.choice('abc')}" for _ in range(50)) for _ in range(40))]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    got = encoder.ids(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e[:-1].tolist() for e in encode_by_default("byte_bpe_50k.json", texts)]
    assert not encoder.known
