"""Operators on texts against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrow.llm import bpe, language, license_scan, media_ts, textwords

RANKS = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [(1, ""), (2, None), (3, "word " * 30_000), (None, "no id"), (4, "tie\n\n"), (4, "tie\n\n"), (5, "\x00\x1c\x85 ’s 漢字 🎉 <|endoftext|>")]


def odd_documents(spark):
    """Nulls in each column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i == 1 else "en", "src", "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string, n_words int")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_librarys(text):
    ids = CODEC.encode(text)
    assert list(memoryview(ids).cast("I")) == THEIRS.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.binary(max_size=9))
def test_bpe_append_and_edit(piece, a, b, data):
    a, b = sorted((min(a, len(piece)), min(b, len(piece))))
    vocab = CODEC.vocab
    whole = bpe.PrefixEncoder(vocab, piece[:a] + data + piece[b:])
    edited = bpe.PrefixEncoder(vocab, piece)
    edited.replace(a, b, data)
    assert (edited.piece, edited.last) == (whole.piece, whole.last)
    assert bpe.PrefixEncoder(vocab, piece[:a]).append(piece[a:]).last == bpe.PrefixEncoder(vocab, piece).last
    assert b"".join(vocab.tokens[i] for i in whole.ids()) == whole.piece


def test_bpe_edit_is_local():
    long = bpe.PrefixEncoder(CODEC.vocab, b"hello world this is " * 500)
    assert long.replace(4000, 4003, b"xyzw") < 200


def test_bpe_query(spark):
    rows = bpe.bpe_digests(odd_documents(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    for (i, text), r in zip(ODD, rows, strict=True):
        ids = THEIRS.encode_ordinary(text or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.token_ids)) == (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), raw)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 150, 168, 169, 170, 184, 185, 400, media_ts.PES_PAYLOAD - 14, media_ts.PES_PAYLOAD, media_ts.PES_PAYLOAD + 1, 300_000])
def test_transport_stream_round_trip(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(n))
    stream = media_ts.mux(payload)
    got = media_ts.demux(stream)
    es = got["streams"][media_ts.ES_PID]
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    assert (es.payload, got["cc_errors"], got["duplicates"]) == (payload, 0, 0)
    assert got["programs"] == {1: {"pmt_pid": media_ts.PMT_PID, "pcr_pid": media_ts.ES_PID, "streams": {media_ts.ES_PID: media_ts.PRIVATE_STREAM}}}
    units = max(1, -(-n // media_ts.PES_PAYLOAD))
    assert [u[0] for u in es.units] == [media_ts.TICKS * i for i in range(units)]
    assert [u[3] for u in es.units] == [i % media_ts.RAP_EVERY == 0 for i in range(units)]


def test_transport_stream_faults():
    stream = media_ts.mux(b"x" * 2000)
    gap = media_ts.demux(stream[: 188 * 5] + stream[188 * 6 :])
    assert gap["cc_errors"] == 1 and gap["streams"][media_ts.ES_PID].units[0][4]
    broken = bytearray(stream)
    broken[15] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media_ts.demux(bytes(broken))
    with pytest.raises(ValueError, match="whole"):
        media_ts.demux(stream[:-1])
    with pytest.raises(ValueError, match="sync"):
        media_ts.demux(stream[:188] + b"x" + stream[189:])
    assert media_ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, cc, payload, start=False, adaptation=None, flags=0):
    """A hand-made packet: ``adaptation`` (bytes after its length) is stuffed so that the payload ends the packet; null: stuffing only if it's needed."""
    room = 184 - len(payload)
    head = bytes([0x47, flags | 0x40 * start | pid >> 8, pid & 255])
    if adaptation is None and not room:
        return head + bytes([0x10 | cc]) + payload
    field = (adaptation or b"\x00")[: room - 1] if room > 1 else b""
    field += b"\xff" * (room - 1 - len(field))
    return head + bytes([(0x30 if payload else 0x20) | cc, len(field)]) + field + payload


def section(table, key, body, now=1, number=0, last=0):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC0 | now, number, last])
    return head + body + media_ts.crc32_mpeg(head + body).to_bytes(4, "big")


def table_packets(pid, sections, cc=0):
    data = b"\x00" + b"".join(sections)
    data += b"\xff" * (-len(data) % 184)
    return [packet(pid, cc + i & 15, data[at : at + 184], i == 0) for i, at in enumerate(range(0, len(data), 184))]


def stamp(value, mark):
    return bytes([mark << 4 | (value >> 30) << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1])


def test_transport_stream_made_by_hand():
    """Two programs, three streams, tables over several packets, repeats, adaptation only, a jump, a damaged packet, open length, DTS, bare PES."""
    filler = b"".join(i.to_bytes(2, "big") + (0xE000 | 0x600 + i).to_bytes(2, "big") for i in range(10, 60))  # programs that have no table here
    pat = [section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x01\xe0\x20" + filler, number=0, last=1), section(0, 1, b"\x00\x02\xe0\x21", number=1, last=1)]
    described = b"\xe1\x00\xf0\x03\x05\x01x"  # PCR on 0x100, a descriptor of the program
    pmt1 = section(2, 1, described + b"\x1b\xe1\x00\xf0\x02\x0a\x00" + b"\x0f\xe1\x01\xf0\x00")
    later = section(2, 1, b"\xe1\x05\xf0\x00\x02\xe1\x05\xf0\x00", now=0)
    pmt2 = section(2, 2, b"\xff\xff\xf0\x00" + b"\x06\xe2\x00\xf0\x00")
    video = [b"V" * 500, b"W" * 300]
    open_pes = [b"\x00\x00\x01\xe0\x00\x00\x80\xc0\x0a" + stamp(90_000 + 3600 * i, 3) + stamp(90_000 + 1800 * i, 1) + v for i, v in enumerate(video)]
    audio = b"A" * 100
    sound = b"\x00\x00\x01\xc0" + (8 + len(audio)).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(2**32 + 5, 2) + audio
    bare = b"\x00\x00\x01\xbf" + len(b"private two").to_bytes(2, "big") + b"private two"

    def pes(pid, data, cc, **first):
        parts = [data[at : at + 176] for at in range(0, len(data), 176)]
        return [packet(pid, cc + i & 15, x, i == 0, **(first if i == 0 else {})) for i, x in enumerate(parts)]

    one, two = pes(0x100, open_pes[0], 14, adaptation=b"\x40"), pes(0x100, open_pes[1], 7, adaptation=b"\x80")
    packets = [
        *table_packets(0, pat), *table_packets(0x20, [later, pmt1]), packet(0x1FFF, 3, b"\x00" * 184), one[0],
        *table_packets(0x21, [pmt2]), one[0], packet(0x100, 14, b"", adaptation=b"\x00"), one[1],  # a legal repeat, then no payload at the same count
        *pes(0x101, sound, 5), packet(0x100, 9, b"bad" * 50, flags=0x80), *one[2:],
        *two, *pes(0x200, bare, 0), packet(0x777, 1, b"nobody's" * 23),
    ]
    got = media_ts.demux(b"".join(packets))
    assert got["programs"][1] == {"pmt_pid": 0x20, "pcr_pid": 0x100, "streams": {0x100: 0x1B, 0x101: 0x0F}}
    assert got["programs"][2] == {"pmt_pid": 0x21, "pcr_pid": 0x1FFF, "streams": {0x200: 6}}
    assert len(got["programs"]) == 52 and set(got["streams"]) == {0x100, 0x101, 0x200}
    assert (got["packets"], got["cc_errors"], got["duplicates"], got["damaged"]) == (len(packets), 0, 1, 1)
    v, a, p = (got["streams"][x] for x in (0x100, 0x101, 0x200))
    assert v.payload == b"".join(video) and v.units == [(90_000, 90_000, 0, True, False), (93_600, 91_800, 500, False, False)]
    assert a.payload == audio and a.units == [(2**32 + 5, None, 0, False, False)]
    assert p.payload == b"private two" and p.units == [(None, None, 0, False, False)]
    thrice = media_ts.demux(b"".join([*packets[: packets.index(one[0]) + 1], *packets[packets.index(one[0]) :][:1] * 2, *packets[packets.index(one[0]) + 1 :]]))
    assert thrice["cc_errors"] >= 1  # a packet may be sent twice, not more


def test_media_query(spark):
    rows = media_ts.media_columns(odd_documents(spark), with_media=True).collect()
    for (i, text), r in zip(ODD, rows, strict=True):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(data), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes % 188 == 0 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        assert media_ts.demux(bytes(r.media))["streams"][media_ts.ES_PID].payload == payload
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 4}) == 1
    assert media_ts.media_columns(odd_documents(spark).limit(0)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})), " ".join(words)


def distance_inside(phrase, text):
    """Fewest edits between the phrase and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(phrase, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def test_license_scan_by_brute_force():
    rng = random.Random(5)
    scan = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES, license_scan.PER_EDIT)
    for turn in range(60):
        phrase = list(rng.choice(list(license_scan.NOTICES)))
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(phrase))
            phrase[at : at + rng.randrange(2)] = rng.choice(["", "q", "x"])
        text = f"Some words; CC-BY cc by cc by, {''.join(phrase)}. All rights reserved! general PUBLIC license Ä" if turn % 2 else "".join(phrase)
        n, count, first, last, base, joined = brute_base(text)
        got = scan.scan(text)
        assert got[:5] == (n, count, first, last, base)
        near = {label for p, label in license_scan.NOTICES.items() if distance_inside(p, joined) <= max(1, len(p) // license_scan.PER_EDIT)}
        assert set(filter(None, got[5].split(","))) == near | set(filter(None, base.split(",")))
        for s in got[7]:
            assert min(distance_inside(p, joined[s["start"] : s["end"]]) for p, label in license_scan.NOTICES.items() if label == s["label"]) <= s["edits"]


def test_words_longer_than_a_chunk():
    blob = "abcdefghij" * 700_000
    texts = [blob, f"x {blob}", f"yyyyy {blob} z", "", blob[:100_000] + " " + blob, "q " * 1_040_000 + blob[:200_000] + " r", blob[:200_000]]
    hashes, bounds = textwords.word_hashes(*textwords.strings(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    of = [hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert of[0][0] == of[1][1] == of[2][1] == of[4][1] and of[5][-2] == of[6][0] != of[0][0]
    for text, want in zip(texts, of, strict=True):
        assert (textwords.word_hashes(*textwords.strings(pa.array([text])))[0] == want).all()


def test_license_spans_back_to_back():
    scan = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES, license_scan.PER_EDIT)
    edited, exact = "redistribution and use in sauce and binary forms", "redistribution and use in source and binary forms"
    for text in (f"{edited} {exact}", f"{exact} {edited}", f"{edited} {exact} {edited} {exact}"):
        assert [s["edits"] > 0 for s in scan.scan(text)[7]] == [w == "sauce" for w in text.split() if w in ("sauce", "source")]


def test_license_scan_takes_linear_time():
    """Ten times the text, hostile or not, takes about ten times as long."""
    import time

    scan = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES, license_scan.PER_EDIT)
    edited = "redistribution and use in sauce and binary forms cc by all rights reserved "
    for unit in (edited, "permission is hereby ", "cc by "):
        took = []
        for size in (100_000, 1_000_000):
            text = unit * (size // len(unit))
            start = time.process_time()
            n = scan.scan(text)
            took.append(time.process_time() - start)
        assert took[1] < 14 * took[0] + 0.2
        assert n[1] == text.count("cc by") + text.count("all rights")


def test_license_query(spark):
    rows = license_scan.license_scan(odd_documents(spark)).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in rows[:3]] == [(1, 0, 0, None, "", 0.0), (2, 0, 0, None, "", 0.0), (3, 30_000, 0, None, "", 0.0)]
    assert len(rows) == len(ODD)
    assert license_scan.license_scan(odd_documents(spark).limit(0)).count() == 0


def slow_bits(trees_texts, order, lang, text):
    """PPM by method C with counts in dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    for t in trees_texts[lang]:
        t = b"\0" * order + fold(t)
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i], t[i]] += 1
    import math

    text, total = b"\0" * order + fold(text), 0.0
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            context = text[i - k : i]
            own = {s: n for (c, s), n in counts[k].items() if c == context}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if text[i] in own:
                total += math.log2(whole / own[text[i]])
                break
            total += math.log2(whole / len(own))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_code_lengths_are_exact(order):
    import numpy as np
    import pyarrow as pa

    from lumenrow.llm.textwords import strings

    texts = {"aa": [b"abracadabra", b"a banana band"], "bb": [b"the cat sat on the mat", "été à".encode()]}
    trees = language.ContextTrees(texts, order)
    probes = ["banana cat", "", "abra", "Zzz été", "the mat the mat"]
    bits = trees.bits(*strings(pa.array(probes)))
    want = [[slow_bits(texts, order, lang, p.encode()) for lang in ("aa", "bb")] for p in probes]
    assert np.allclose(bits, want, atol=1e-3)


def test_code_lengths_do_not_depend_on_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lumenrow.llm.textwords import strings

    trees = language.ContextTrees({"a": [b"hello world " * 9], "b": [b"bonjour monde " * 9]}, 3)
    column = pa.array(["hello monde " * 40, "", "bonjour", "world hello " * 25])
    whole = trees.bits(*strings(column))
    monkeypatch.setattr(language, "CHUNK", 37)
    assert np.allclose(whole, trees.bits(*strings(column)), atol=1e-6)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = language.identify(odd_documents(spark)).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows[:4]] == [(1, "und"), (2, "und"), (3, "en"), (None, "en")]
    empty = odd_documents(spark).limit(0)
    assert language.identify(empty).collect() == []
    unlabelled = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
