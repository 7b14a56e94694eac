"""WARC archives, coded and flat token files."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import rangecoder, tokens, warc
from tests.conftest import DATA
from docspark.llm.files import open_stream

PAGES = [
    (1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (9, None, "x" * 2000), (3, "http://c/\r\nEvil: 1", "x" * 999), (4, "http://d/", "x" * 999),
    (5, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (None, "u", "x" * 2000), (10, "u", "long " * 200_000), (11, "u", "\r\n\r\n" * 400), (11, "u", "\r\n\r\n" * 400),
]


def classes(pages):
    top = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    return top


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    from docspark.llm import common

    if not broadcast:
        monkeypatch.setattr(common.attach_class, "__defaults__", (0,))
    df = spark.createDataFrame([(*p, "s", 1) for p in PAGES], "page_id long, url string, html string, payload string, key long").repartition(3)
    files = warc.write(df)
    got = warc.read(files).collect()
    top = classes(PAGES)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h in top and top[h] != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert len({r.record_id for r in got}) == len(got)
    payloads = {}
    for path in [r.path for r in files.collect()]:
        for r in warc.read_records(open_stream(path)):
            payloads.setdefault(r["page_id"], []).append((r["record_type"], r["payload"], r["url"]))
    assert payloads[7] == [("revisit", b"", "u")] and payloads[8] == [("response", ("é" * 500).encode(), "u")]
    assert payloads[3][0][2] == "http://c/%0D%0AEvil: 1" and payloads[9][0][2] is None


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df)).count() == 0


def test_damaged_archives():
    one = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(one + one))] == [b"payload"] * 2
    wrong = warc.record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), "response", None)
    text = zlib.decompress(one, 31)
    pack = lambda b: (p := zlib.compressobj(6, 8, 31)).compress(b) + p.flush()
    for data in (one[:-9], wrong, pack(text.replace(b"payload\r", b"paXload\r")), pack(text[:-3]), pack(b"nothing")):
        with pytest.raises((warc.Damaged, zlib.error)):
            list(warc.read_records(io.BytesIO(data)))


def foreign(head: str, block: bytes) -> bytes:
    packer = zlib.compressobj(6, 8, 31)
    return packer.compress(head.replace("\n", "\r\n").encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def test_archives_of_others():
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore"
    payload = b"body\r\n\r\nmore"
    data = foreign("WARC/1.0\nWARC-Type: warcinfo\nWARC-Record-ID: <urn:uuid:1>\nContent-Type: application/warc-fields\nContent-Length: 5", b"a: b\n")
    data += foreign("WARC/1.0\nWARC-Type: request\nWARC-Record-ID: <urn:uuid:2>\nContent-Type: application/http;\n msgtype=request\nContent-Length: 18", b"GET / HTTP/1.0\r\n\r\n")
    data += foreign(f"WARC/1.1\nwarc-type: response\nWARC-Record-ID: <urn:uuid:3>\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\nContent-Type: application/http\nContent-Length: {len(http)}", http)
    data += foreign("WARC/1.1\nWARC-Type: metadata\nWARC-Record-ID: <urn:uuid:4>\nWARC-Block-Digest: strange:xyz\nContent-Length: 3", b"x:y")
    data += foreign(f"WARC/1.1\nWARC-Type: revisit\nWARC-Record-ID: <urn:uuid:5>\nWARC-Refers-To: <urn:uuid:3>\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\nContent-Length: 0", b"")
    got = list(warc.read_records(io.BytesIO(data)))
    sha1 = lambda x: hashlib.sha1(x).hexdigest()
    assert [(r["record_type"], r["payload"], r["payload_bytes"], r["payload_digest"], r["page_id"], r["refers_to"]) for r in got] == [
        ("warcinfo", b"a: b\n", 5, sha1(b"a: b\n"), None, None), ("request", b"", 0, sha1(b""), None, None), ("response", payload, len(payload), sha1(payload), None, None),
        ("metadata", b"x:y", 3, sha1(b"x:y"), None, None), ("revisit", b"", None, sha1(payload), None, None),
    ]
    assert [r["record_id"] for r in got] == [f"<urn:uuid:{k}>" for k in range(1, 6)]
    wrong = foreign(f"WARC/1.1\nWARC-Type: response\nWARC-Payload-Digest: sha256:{'0' * 64}\nContent-Type: application/http\nContent-Length: {len(http)}", http)
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(wrong)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=400), st.integers(1, 50))
def test_range_coder_round_trip(ids, block):
    x = np.array(ids, np.uint16)
    start, *blocks = rangecoder.encode(x, block)
    assert len(blocks) == -(-len(x) // block)
    assert (rangecoder.decode(b"".join([start, *blocks])) == x).all()
    if len(blocks) > 1:
        assert (rangecoder.decode(start + blocks[1]) == x[block : 2 * block]).all(), "with the start, a block stands alone"


def test_range_coder_learns_and_detects_damage():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50000, 40).astype(np.uint16)
    x = np.tile(phrase, 100)
    data = b"".join(rangecoder.encode(x))
    assert len(data) < 0.35 * 2 * len(x) and (rangecoder.decode(data) == x).all()
    for at in (20, len(data) // 2, len(data) - 30):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises((rangecoder.Damaged, IndexError, ValueError)):
            assert (rangecoder.decode(bytes(bad)) == x).all()
            raise ValueError("unchanged ids: the byte wasn't needed")


def test_range_coder_halves_the_ids_of_the_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet".replace("sf0.001", "sf0.01")).collect()]
    ids = np.concatenate([np.append(x, np.uint16(tokens.END_ID)) for x in tokens.encode_texts(texts)]).astype(np.uint16)
    data = b"".join(rangecoder.encode(ids))
    assert len(data) <= 0.5 * 2 * len(ids) and (rangecoder.decode(data) == ids).all()


def reference(texts, special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    t.encode_special_tokens = special
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aB é'sßÅ.,;<|>\n\t\x1c\xa0éİΣ12 ", max_size=40), st.sampled_from(["<|endoftext|>", "don't I'll", "Word, word. WORD!"])), max_size=4))
def test_remembered_chunks_give_the_librarys_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for special in (False, True):
        assert [x.tolist() for x in tokens.encode_texts(texts, special_as_text=special)] == reference(texts, special)


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 3)
    monkeypatch.setattr(tokens, "WORDS", 2)
    monkeypatch.setattr(tokens.Encoder, "_kept", {})
    texts = ["alpha beta gamma delta alpha", "beta gamma epsilon alpha beta alpha zeta eta", "alpha beta"]
    assert [x.tolist() for x in tokens.encode_texts(texts)] == reference(texts, False)


@pytest.mark.parametrize("which", ["docs", "wide"])
def test_coded_files(which, rows, request):
    df = request.getfixturevalue(which)
    got = sorted(tokens.read_coded(tokens.write_coded(df)).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    start = 0
    for r, row, ids in zip(got, order, reference([r[1] or "" for r in order], False), strict=True):
        ids = [*ids, tokens.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_coded_files_of_several_parts(spark, monkeypatch, tmp_path):
    from docspark.llm import rangecoder as rc

    docs = [(None, "null id"), *((i, f"text {i} " * (i % 50)) for i in range(300))]
    ids = bytearray()
    held, parts = [], [tokens.MAGIC]
    for d, t in docs:
        x = tokens.Encoder.of(tokens.VOCABULARY, False).ids(t)
        ids += x
        held.append((d, len(x) // 2))
        if len(held) == 70:
            parts.append(tokens._part(held, ids))
            held, ids = [], bytearray()
    parts.append(tokens._part(held, ids))
    found = [(int(t["id"]), bool(t["null"]), int(t["n"])) for table, x in tokens.coded_parts(io.BytesIO(b"".join(parts))) for t in table]
    assert [(None if null else i) for i, null, _ in found] == [d for d, _ in docs]
    broken = bytearray(b"".join(parts))
    broken[len(tokens.MAGIC) + 20] ^= 1
    with pytest.raises(rc.Damaged):
        list(tokens.coded_parts(io.BytesIO(bytes(broken))))


def test_no_documents(empty):
    assert tokens.read_coded(tokens.write_coded(empty)).count() == 0
    written = tokens.write_flat(empty)
    assert written.count() == 0 and tokens.count_flat(written.select("path").distinct()).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_flat_counts(docs, rows, block):
    written = tokens.write_flat(docs)
    counts = tokens.count_flat(written.select("path").distinct(), block=block)
    got = written.join(counts, ["path", "number"]).collect()
    want = sorted((r[0], len(x)) for r, x in zip(rows, reference([r[1] or "" for r in rows], True)))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want and all(r.ended for r in got)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_flat_files_that_end_within_a_document(spark, tmp_path, block):
    end = tokens.FLAT_END
    files = {"a": [1, 2, end, end, 5, 6, 7, 8, 9, end, 4], "b": [end], "c": [], "d": [3] * 10}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(str(tmp_path / n),) for n in files], "path string")
    got = sorted((r.path[-1], r.number, r.n_tokens, r.ended) for r in tokens.count_flat(df, block=block).collect())
    assert got == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 5, True), ("a", 3, 1, False), ("b", 0, 0, True), ("d", 0, 10, False)]


def test_punctuation_behind_words_is_remembered(monkeypatch):
    """Any ASCII punctuation behind a word gives the library's ids, and the whole tokenizer isn't asked for it."""
    ends = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    ends += ["***", "&&&", "$$$", "%%%", "###", "'", "'!", "<|", "|>", '."', "--", "_", "`{}~"]
    texts = [f"Word{e} été{e} word{e}\n{e}" for e in ends] + ["a<|endoftext|> don't it's' x'll,"]
    plain = tokens.Encoder(tokens.VOCABULARY, False)
    want = [plain.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.encode_texts(texts)] == want
    asked = []

    class Whole:
        def __init__(self, tokenizer):
            self.model, self.inner = tokenizer.model, tokenizer

        def encode(self, text, **options):
            asked.append(text)
            return self.inner.encode(text, **options)

    memo = tokens.Encoder(tokens.VOCABULARY, False)
    memo.memo.tokenizer = Whole(memo.tokenizer)
    for e in ends:
        memo.ids(f"Word{e} été{e}")
    assert not asked


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aB é'sßÀÿÅ.,;<|>\n\t\x1c\xa0éİΣ12 ", max_size=40), st.sampled_from(["", "<|endoftext|>", "don't I'll", "Word, word. WORD!", "\n \n"])), max_size=6), st.integers(0, 2))
def test_texts_encoded_together_give_the_librarys_ids(texts, skipped):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(["Before it"] * skipped + texts, kind).slice(skipped)
        flat, sizes = tokens.Encoder.of(tokens.VOCABULARY, False).many(array)
        cuts = np.cumsum(sizes)
        assert len(sizes) == len(texts) and sizes.sum() == len(flat)
        assert [flat[e - n : e].tolist() for e, n in zip(cuts, sizes)] == (reference(texts, False) if texts else [])


def test_new_words_are_asked_for_together(monkeypatch):
    """A word is asked for once, whatever is before and behind it, and many in a call, also where the memo forgets."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CALL", 100)
    monkeypatch.setattr(tokens, "TABLE", 70)
    letters = "abcdéfghiö"
    words = [f"zy{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}qu" for i in range(950)]
    texts = [" ".join(words[:500]), "\n".join(w.title() + "!" for w in words), "", " ".join(reversed(words)) + " mail@a.b"]
    encoder = tokens.Encoder(tokens.VOCABULARY, False)
    asked, whole = [], encoder.memo.spaced

    class Counted:
        def encode_batch_fast(self, some, **options):
            asked.append(some[0].split(" "))
            return whole.encode_batch_fast(some, **options)

    encoder.memo.spaced = Counted()
    monkeypatch.setattr(encoder.memo, "_word", lambda w: pytest.fail(w) if len(w) > 1 else tokens._Memo._word(encoder.memo, w))
    flat, sizes = encoder.many(pa.array(texts))
    assert flat.tolist() == [i for x in reference(texts, False) for i in x] and sizes.tolist() == [len(x) for x in reference(texts, False)]
    assert len(asked) == 10 and len({w for some in asked for w in some}) == sum(map(len, asked)) == 950
    assert encoder.many(pa.array(texts[2:]))[0].tolist() == flat[sizes[:2].sum() :].tolist() and len(asked) == 10
    assert encoder.many(pa.array(["other words", "other", *texts]))[0].tolist() == [i for x in reference(["other words", "other", *texts], False) for i in x]
    assert encoder.many(pa.array(["few"] * 3))[0].tolist() == reference(["few few few"], False)[0] and len(encoder.memo.names) == 1


def test_words_are_asked_for_alone_where_ends_arent_known():
    import pyarrow as pa

    encoder = tokens.Encoder(tokens.VOCABULARY, False)
    encoder.memo.last[:] = False
    assert encoder.many(pa.array(["Some words, été"]))[0].tolist() == reference(["Some words, été"], False)[0]


def test_pieces_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "TOGETHER", 10)
    texts = ["", "a" * 10, "", "é" * 4, "bb", "c" * 30, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    assert [b.column(1).to_pylist() for b in tokens._by_bytes([batch, batch.slice(0, 0), batch.slice(6)])] == [texts[:3], texts[3:5], texts[5:6], texts[6:], texts[6:]]


def test_no_few_blocks_go_alone():
    """A block more than go in lockstep doesn't cost as many steps as they do."""
    assert rangecoder._together(0) == [] and rangecoder._together(1) == [(0, 1)]
    for blocks in (rangecoder.LANES + 1, 3 * rangecoder.LANES - 1, 10 * rangecoder.LANES + 7):
        runs = rangecoder._together(blocks)
        assert [b for _, b in runs[:-1]] == [a for a, _ in runs[1:]] and (runs[0][0], runs[-1][1]) == (0, blocks)
        assert all(2 * rangecoder.LANES // 3 <= b - a <= 3 * rangecoder.LANES // 2 for a, b in runs)
