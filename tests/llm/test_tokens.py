import hashlib
import random
import zlib
from array import array
from collections import Counter as Bag
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hearthgraph.llm import binary_ids, bpe, packing, token_counts
from hearthgraph.llm.chunk_ids import Ids

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = ["a", "b", " ", "  ", "\n", "\n ", "'s", "'re", "'", "é", "日", "1", "22", ".", "!!", "<|endoftext|>", " ", "　", "\x1c", "\x85", "the", " and", "zz", "\t", "\r\n", "😀", "́", "ing", "tion"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(JSON)


def texts(n, seed=3):
    rnd = random.Random(seed)
    for i in range(n):
        yield "".join(rnd.choice(LETTERS if i % 4 else ["a", "b", "th", "e", "ing"]) for _ in range(rnd.randint(0, 90)))


def test_every_token_encodes_to_itself(counter):
    m = counter.machine
    assert all(m.encode(t) == [t] for t in m.tokens)


def test_pair_rule_is_the_encoding_of_the_pair(counter):
    m, rnd = counter.machine, random.Random(1)
    tokens = [t for t in m.tokens if len(t) < 8]
    for _ in range(5000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert m.meets(a, b) == (m.encode(a + b) == [a, b])


@pytest.mark.parametrize("width", [1, 2, 5, 13, 256])
def test_counts_and_ids_as_the_library(lib, counter, monkeypatch, width):
    monkeypatch.setattr(token_counts, "CHUNK", width)
    ids = Ids(JSON)
    for t in texts(800, width):
        want = lib.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(want)
        assert ids.encode(t) == want


def test_the_scan_gives_every_prefix(lib, counter):
    for t in texts(150, 5):
        t = t.replace("<|endoftext|>", "")
        assert counter.prefixes(t, 7) == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(7, len(t) + 7, 7)]


def test_chunk_maps_compose_associatively_from_any_state(counter):
    seen = 0
    for t in texts(200, 8):
        maps = [counter.map(t[i : i + 9]) for i in range(0, len(t), 9)]
        if len(maps) > 2:
            a, b, c = maps[:3]
            left, right = a.then(b).then(c), a.then(b.then(c))
            entries = [counter.run(token_counts.START, x)[0] for x in ("", "ab", "x'", "x'r", " ", "\n", "  ", "1", "!")]
            assert all(left(s) == right(s) for s in entries)
            seen += len(entries)
    assert seen > 500


def test_ordinary_texts_are_chunked_and_maps_are_read_once(counter, monkeypatch):
    made = []
    own = counter.map
    monkeypatch.setattr(counter, "map", lambda c: made.append(len(c)) or own(c))
    text = "the cat sat on the mat, it's 12 o'clock. " * 100
    counter.count(text)
    assert len(made) == -(-len(text) // token_counts.CHUNK) and sum(made) == len(text)


def test_pieces_merge_as_the_librarys():
    e, rnd = bpe.Encoder(MULTI, leaf=23), random.Random(6)
    for n in (0, 1, 2, 3, 10, 22, 23, 24, 50, 101, 1000, 4097):
        for letters in ("a", "ab", "aei", "etaoinshr", "xq"):
            w = "".join(rnd.choice(letters) for _ in range(n))
            want = e.lib.encode_ordinary(w)
            assert e.merged(w.encode()) == want and e.piece(w.encode()) == want


def test_ordinary_texts_are_halved_and_joined(monkeypatch):
    e, joins = bpe.Encoder(MULTI), []
    own = e.join
    monkeypatch.setattr(e, "join", lambda *a: joins.append(1) or own(*a))
    text = "the cat sat on the mat, it's 12 o'clock. " * 25
    assert e.encode(text) == e.lib.encode_ordinary(text) and len(joins) == 7


@pytest.mark.parametrize("leaf", [3, 11, bpe.LEAF])
def test_tree_encoding_is_the_librarys(leaf):
    e = bpe.Encoder(MULTI, leaf=leaf)
    for t in texts(800, 4):
        got = e.encode(t)
        assert got == e.lib.encode_ordinary(t)
        assert e.decode(got) == t.encode()


def test_variable_length_round_trip():
    rnd = np.random.RandomState(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rnd.rand(n) * 2.0 ** rnd.randint(0, 32, n)).astype("<u4")
        control, data = binary_ids.encode_ranks(x)
        assert len(control) == -(-n // 4)
        assert (binary_ids.decode_ranks(control, data, [n]) == x).all()
    docs = [(rnd.rand(n) * 70000).astype("<u4") for n in (1, 0, 4, 7, 2, 3, 8)]
    coded = [binary_ids.encode_ranks(x) for x in docs]
    for ids in ([3, None, 5, 5, -1, 2**60, 0], list("abcdefé")):
        block = binary_ids.pack_block(pa.array(ids), 77, np.array([len(x) for x in docs]), b"".join(c for c, _ in coded), b"".join(d for _, d in coded))
        names, start, lengths, ranks = binary_ids.unpack_block(block)
        assert names.to_pylist() == ids and start == 77
        assert lengths.tolist() == [len(x) for x in docs] and (ranks == np.concatenate(docs)).all()
    assert (binary_ids.from_planes(binary_ids.planes(docs[3], 4), 4) == docs[3]).all()
    for bad in (b"\0" * 90, b"", block[:-1]):
        with pytest.raises(ValueError):
            binary_ids.unpack_block(bad)


def test_token_counts_on_odd_rows(odd, odd_rows, lib):
    got = Bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.lang) for r in token_counts.token_counts(odd, JSON).collect())
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_rows]
    assert got == Bag((i, len((t or "").encode()), k, k > 512, lang) for (i, t, lang), k in zip(odd_rows, n))
    assert token_counts.token_counts(odd.limit(0), JSON).count() == 0


def test_round_trip_on_odd_rows(odd, odd_rows):
    e = bpe.Encoder(MULTI)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Bag()
    for i, t, _ in odd_rows:
        ids = e.lib.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Bag(map(tuple, bpe.round_trip(odd, MULTI).collect())) == want
    back = bpe.decode_documents(bpe.encode_documents(odd, MULTI), MULTI).collect()
    assert Bag((r.doc_id, bytes(r.text)) for r in back) == Bag((i, (t or "").encode()) for i, t, _ in odd_rows)
    assert bpe.round_trip(odd.limit(0), MULTI).count() == 0


def test_binary_ids_on_odd_rows(spark, odd, odd_rows, lib, tmp_path):
    binary_ids.write_ids(odd, JSON, f"{tmp_path}/a")
    got = sorted(binary_ids.read_ids(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    own = lambda t: array("I", [*lib.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
    rows = sorted((i if i is not None else -1, own(t)) for i, t, _ in odd_rows)  # ids repeat with one text here
    start = 0
    for r, (i, raw) in zip(got, rows, strict=True):
        assert ((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(raw) // 4, raw)
        start += r.n_tokens
    binary_ids.write_ids(odd.limit(0), JSON, f"{tmp_path}/b")
    assert binary_ids.read_ids(spark, f"{tmp_path}/b").count() == 0


def test_block_files_can_be_read_alone(spark, sf, tmp_path, lib):
    """Without Spark or the index: the files' blocks hold doc_ids, starts and ids of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    binary_ids.write_ids(docs, JSON, f"{tmp_path}/a")
    ranks = np.frombuffer((tmp_path / "a/ranks").read_bytes(), "<u4")
    got = []
    for f in (tmp_path / "a/blocks").iterdir():
        raw = f.read_bytes() if not f.name.startswith(".") else b""
        while raw:
            size = binary_ids.SIZE + sum(np.frombuffer(raw[32:64], "<u8").tolist())
            names, start, lengths, r = binary_ids.unpack_block(raw[:size])
            for name, n, end in zip(names.to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist()):
                got.append((start + end - n, name, ranks[r[end - n : end]].tolist()))
            raw = raw[size:]
    at = 0
    for (start, name, ids), d in zip(sorted(got), sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        assert (start, name, ids) == (at, d.doc_id, [*lib.encode(d.text or "", add_special_tokens=False).ids, 0])
        at += len(ids)
    counts = Bag(i for _, _, ids in got for i in ids)
    assert [counts[i] for i in ranks.tolist()] == sorted(counts.values(), reverse=True)


def test_registered_queries_against_the_libraries(spark, sf, lib):
    """op6, op8 and op10 over a whole table."""
    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts_.items()}
    got = {r.doc_id: r for r in token_counts.op10_token_counts(spark, sf).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts_.items()}
    at, got = 0, {r.doc_id: r for r in binary_ids.op8_binary_ids(spark, sf).collect()}
    assert got.keys() == ids.keys()
    for i in sorted(ids):
        assert tuple(got[i]) == (i, at, len(ids[i]) + 1, zlib.crc32(array("I", [*ids[i], 0]).tobytes()))
        at += len(ids[i]) + 1
    e, sha = bpe.Encoder(MULTI), lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in bpe.op6_bpe_round_trip(spark, sf).collect()}
    assert got.keys() == ids.keys()
    for i, t in texts_.items():
        own = e.lib.encode_ordinary(t)
        assert tuple(got[i]) == (i, len(own), sha(",".join(map(str, own)).encode()), sha(t.encode()))


def whole(pieces, capacity=1024, segments=256):
    """Each sequence is gapless, keeps its limits, and has no padding but at powers of two."""
    box, doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        box[r.sequence_id].append((r.offset, r.length))
        doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for x in box.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and len(x) <= segments
        total = sum(n for _, n in x)
        assert total == capacity or (total < capacity and total & (total - 1) == 0)
    return doc


def test_packing_of_documents(spark, sf, lib):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, JSON).collect()
    by = whole(pieces)
    for d in docs.collect():
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, length, n in sorted(by.pop(d.doc_id)):
            assert start == at and n == len(ids)
            at += length
        assert at == len(ids)
    assert not by
    one = pieces[0]
    text = docs.where(docs.doc_id == one.doc_id).first().text
    ids = [*lib.encode(text, add_special_tokens=False).ids, 0][one.start : one.start + one.length]
    assert one.ids_crc32 == zlib.crc32(array("I", ids).tobytes())


def test_packing_of_odd_rows(odd):
    got = packing.pack(odd, JSON).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and sum(r.length for r in got if r.doc_id == 3) == 1
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)
    whole(got)
    assert packing.pack(odd.limit(0), JSON).count() == 0


@pytest.mark.parametrize("segments,loss", [(256, None), (3, None), (8, 300), (1, 1)])
def test_packer_keeps_all_three_limits(segments, loss):
    rnd = random.Random(segments)
    p = packing.Packer(64, segments, loss)
    p.begin()
    want = {}
    for i in range(400):
        want[i] = rnd.choice([1, 2, 5, rnd.randint(1, 200)])
        prompts = rnd.randint(0, want[i]) if loss else 0
        p.add(i, want[i], prompts)
        want[i] = (want[i], prompts)
    p.fill(0, last=True)
    seen = defaultdict(list)
    for box in p.out:
        assert len(box) <= segments and sum(n for _, _, n in box) <= 64
        assert sum(max(0, min(n, s + n - want[i][1])) for i, s, n in box) <= (loss or 64)
        for i, s, n in box:
            seen[i].append((s, n))
    for i, (n, _) in want.items():
        at = 0
        for s, k in sorted(seen[i]):
            assert s == at
            at += k
        assert at == n
