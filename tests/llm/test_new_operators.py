"""WARC archives, token alignment and ranked search, against plain Python on whole tables and made rows."""

import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re

import numpy as np
import pytest

from eventfold.llm import alignment, balltree, warc
from eventfold.llm.common import materialize, shared_path, ship_package

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, payload_digest string, top int"
DOCS = "doc_id bigint, text string, lang string, m int, links string"
ITEMS = "item_id bigint, text string, doc_id int"


# --- WARC ---------------------------------------------------------------------

def brute_pages(rows):
    """Sorted (page_id, bytes, digest, refers_to or None, type) rows."""
    groups = collections.defaultdict(list)
    for p, u, h in rows:
        groups[(h or "").encode()].append((p, u))
    low = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    out = []
    for payload, members in groups.items():
        members.sort(key=low, reverse=True)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(p, len(payload), digest, "revisit" if i else "response", members[0][0] if i else None) for i, (p, _) in enumerate(members)]
    return sorted(out, key=repr)


def got_pages(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


HARD_PAGES = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (3, "http://c/", "<p>x</p>"),
    (4, "http://a b\r\nWARC-Type: request", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", None), (None, None, ""), (5, "ü", ""),
    (None, "n", "only null ids"), (None, "n", "only null ids"), (None, "m", "only null ids"), (6, "http://z/", "long " * 300_000),
    (7, "x", "\x1f\x8b\x08 gzip-like"), (2**63 - 1, "max", "edge"), (-2**63, "min", "edge"),
    *[(9, "same", "equal in all columns")] * 2500,
]


def test_warc_hard_rows(spark):
    ship_package(spark)
    df = spark.createDataFrame([(*r, "clash", 1) for r in HARD_PAGES], PAGES).repartition(3)
    assert got_pages(warc.op11(df)) == brute_pages(HARD_PAGES)


def test_warc_generated_pages(spark):
    ship_package(spark)
    df = spark.read.parquet(f"{SF}/pages.parquet")
    assert got_pages(warc.op11(df)) == brute_pages([(r.page_id, r.url, r.html) for r in df.collect()])


def test_warc_files_are_standard_members(spark):
    """One gzip member a record; the standard library reads the concatenation; payloads come back."""
    ship_package(spark)
    rows = HARD_PAGES[:16]
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame([(*r, "", 1) for r in rows], PAGES).coalesce(1), folder, archive_bytes=400)
    names = [r.name for r in manifest.collect()]
    assert len(names) > 1 and sum(r.n_records for r in manifest.collect()) == len(rows)
    for name in names:
        data = open(f"{folder}/{name}", "rb").read()
        plain = gzip.decompress(data)
        records = list(warc.read_records(io.BytesIO(data), payloads=True))
        assert plain.startswith(b"WARC/1.1\r\n") and len(records) == data.count(b"\x1f\x8b\x08")
    back = warc.read_archives(manifest, folder, payloads=True).filter("record_type = 'response'").collect()
    assert {r.payload.decode() for r in back} == {h or "" for _, _, h in rows}
    ids = {r.record_id for r in warc.read_archives(manifest, folder).collect()}
    assert len(ids) == len(rows)
    refers = {r.refers_to_record for r in warc.read_archives(manifest, folder).collect()} - {None}
    assert refers <= {r.record_id for r in back}


def test_warc_reader_refuses_damage():
    page = warc.Page(1, "u", hashlib.sha1(b"body").digest(), 4, b"body")
    good = warc.record(page)
    read = lambda raw: list(warc.read_records(io.BytesIO(gzip.compress(raw))))
    assert read(good)[0].payload_bytes == 4
    for bad in (good.replace(b"\r\n\r\nbody", b"\r\n\r\nbodx"), good[:-1], good[:-6], good + b"x", b"WARC/1.1\r\n", b"",
                good.replace(b"Content-Length: 4", b"Content-Length: 5"), b"GET / HTTP/1.1\r\n\r\n"):
        with pytest.raises(Exception):
            assert not read(bad) and False
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(good)[:-12])))


def test_warc_reader_memory_is_bounded_by_pieces():
    big = b"x" * (1 << 24)
    page = warc.Page(1, "u", hashlib.sha1(big).digest(), len(big), big)
    out = io.BytesIO()
    warc.ArchiveWriter(out).add(page)

    class Small(io.BytesIO):
        def read(self, n=-1):
            assert 0 < n <= warc.PIECE
            return super().read(n)

    member = warc._Member(Small(out.getvalue()), b"")
    assert all(len(p) <= warc.PIECE for p in iter(member.more, b""))
    assert [r.payload_bytes for r in warc.read_records(Small(out.getvalue()))] == [len(big)]


# --- alignment ----------------------------------------------------------------

def brute_alignment(rows):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    whole, links = {}, collections.Counter()
    for _, text in rows:
        if text and text not in whole:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta, tb = [of_a(i) for i in ia], [of_b(i) for i in ib]
            if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
                whole[text] = None
                continue
            ends_a, ends_b = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
            both = sorted(set(ends_a) & set(ends_b))
            at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
            pairs = [(ia[at_a[e]], ib[at_b[e]]) for e in both]
            groups, i, j = [], 0, 0
            for e in both:
                groups.append(",".join(map(str, ia[i:at_a[e] + 1])) + "|" + ",".join(map(str, ib[j:at_b[e] + 1])))
                i, j = at_a[e] + 1, at_b[e] + 1
            whole[text] = (len(ia), len(ib), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())
        if text and whole[text]:
            links.update(whole[text][2])
    top = collections.Counter()
    for (x, y), n in links.items():
        top[y] = max(top[y], n)
    out = []
    for d, text in rows:
        got = whole.get(text)
        if not got:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, pairs, sha = got
            out.append((d, n_a, n_b, len(pairs), len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs), sha))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD_TEXTS = [
    "a\nb  c <s> <0x41> ﬁ é   d ", "  lead", "trail  ", "a \n b", "\n", "  ", " ", "x\x00y z", "<|endoftext|> a<|endoftext|>", "a  b",
    "a\x1c b  c", "\t a", "é ́x", "a　b c", "'s 's don't  've", "日本 語  テ", "a▁ b", "▁x", "a▁b c d", "", None, None,
    "same words here", "same words here", "same words here", "x" * 3000, "​ ﻿ x", "a  b   c", "\r\n a \r\n", "🙂 🙂🙂 x",
]


def test_alignment_hard_rows(spark):
    ship_package(spark)
    rows = [(i if i % 3 else None, t) for i, t in enumerate(HARD_TEXTS)] + [(7, "same words here"), (7, "same words here")]
    df = spark.createDataFrame([(*r, "en", 1, "clash") for r in rows], DOCS).repartition(3)
    assert sorted((tuple(r) for r in alignment.op12(df).select(*ALIGNED).collect()), key=repr) == brute_alignment(rows)


def test_alignment_generated_texts_by_either_join(spark, monkeypatch):
    ship_package(spark)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_alignment([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((tuple(r) for r in alignment.op12(df).select(*ALIGNED).collect()), key=repr) == want
    monkeypatch.setattr(alignment, "MAX_BROADCAST", 0)
    assert sorted((tuple(r) for r in alignment.op12(df).select(*ALIGNED).collect()), key=repr) == want


def tokenizer_paths():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_alignment_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY_UNITS", 5)
    pair = alignment.Pair(*tokenizer_paths())
    for text in ("a b c d", "a b e f g", "one two three four five six seven"):
        numbers = pair.numbers([text])[0]
        assert ";".join(pair.groups[u] for u in numbers) == pair.align([text])[0][2]


def test_ranks_engine_gives_the_ids_of_the_file(spark):
    """Every distinct word of the table with the spaces before it, and random strings."""
    from tokenizers import Tokenizer
    path = tokenizer_paths()[0]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzAEIOU     '\n\t.,!?-_0123456789éüß世界語тест🙂\u0301\x00\x1c\xa0\u3000"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["".join(rng.choices("aeinrst h", k=rng.randint(1, 30))) for _ in range(20_000)]
    texts += ["a" * n for n in range(300)] + [" " * n + "x" for n in range(200)] + [t for t in HARD_TEXTS if t] + ["<|endoftext|>"]
    texts += sorted({" " + u for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for u in alignment.Pair.cut(r.text or "")})
    assert alignment.byte_level_encoder(path)(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


# --- ranked search ------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items):
    held = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [(d, t, collections.Counter(t)) for d, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t, _ in held)
    df = collections.Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scores = []
        for d, t, c in held:
            m = 25 + (75 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * ((1000000000 * c[q]) // (1000 * c[q] + 8 * m))
                    for q in asked if c[q])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def made_search(n=700, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "x2"]
    docs = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, "one text that very many share w1 w2 w250") for i in range(n // 2)] + [(5, docs[5][1])] * 3 + [(None, docs[6][1])] * 20
    docs += [(10**6, None), (10**6 + 1, " .,;! "), (10**6 + 2, "W250 w250, W250." * 500)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(3, "w250 W250 w1"), (None, "straße Straße"), (40, None), (41, ""), (42, "nowhere found"), (43, "one text that very many share")]
    return docs, items


@pytest.mark.parametrize("subtree,leaf,block", [(64, 4, 7), (4096, 64, 1024)])
def test_search_made_rows(spark, subtree, leaf, block):
    ship_package(spark)
    docs, items = made_search()
    df = spark.createDataFrame([(*r, "en", 1, "clash") for r in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    got = balltree.rank_documents(df, asked, subtree=subtree, leaf=leaf, block=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items)


def test_search_of_nothing(spark):
    ship_package(spark)
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "en", 1, "")], DOCS)
    asked = spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert balltree.op13(none, asked).count() == 0 and balltree.op13(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert balltree.op13(some, asked).collect()[0][:3] == (1, 1, 1)


def test_tree_bounds_hold_and_prune():
    """Every node's ball holds its rows; a search for a planted vector scores few of them."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(2000):
        cols = np.sort(rng.choice(20, 5, replace=False)) + 20 * rng.integers(0, 10)
        rows.append((cols, rng.integers(1, 10**6, 5)))
    rows.sort(key=lambda r: int(r[0][0]))  # as the operator's ranges bring alike rows together
    x = balltree.Sparse(np.arange(0, 10_001, 5), np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]))
    order, nodes = balltree.build(x, 200, leaf=32)
    assert sorted(order.tolist()) == list(range(2000))
    dense = np.zeros((2000, 200))
    dense[np.repeat(np.arange(2000), 5), x.cols] = x.values
    for left, right, lo, hi, cols, centre, radius in nodes:
        c = np.zeros(200)
        c[cols] = centre
        assert np.sqrt(((dense[order[lo:hi]] - c) ** 2).sum(1)).max() <= radius
        assert left < 0 or (nodes[left][2], nodes[left][3], nodes[right][3]) == (lo, nodes[right][2], hi)
    x = x.take(order)
    left, right, lo, hi, cols, centre, radius = zip(*nodes)
    tree = {"doc_ids": order, "has_id": np.ones(2000, bool), "bounds": x.bounds, "cols": x.cols, "vals": x.values, "left": left,
            "right": right, "first": lo, "end": hi, "radius": radius, "c_bounds": np.concatenate([[0], np.cumsum([len(c) for c in cols])]),
            "c_cols": np.concatenate(cols), "c_values": np.concatenate(centre)}

    class Q:
        terms_of, repeats = [np.arange(20)], [np.ones(20, np.int64)]
    tops: dict = {}
    scored = balltree.search(tree, balltree.Block(Q, np.full(200, 1000)), [0], {}, tops)
    want = np.sort(dense[:, :20].sum(1) * 1000)[-10:]
    assert sorted(s for s, _, _ in tops[0]) == want.astype(np.int64).tolist() and scored < 1000
