import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import gif, packing, tokenizer


def check_pieces(rows, texts):
    """Every id of every document in exactly one piece, sequences gapless and not over 1024."""
    ends, pieces = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert all(n <= 1024 for n in ends.values())
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i] or ""), 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(pieces) == set(texts)
    return sum(ends.values()) / (1024 * len(ends))


def test_pieces_cover_documents(spark, odd, none, nothing):
    one = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.pack(one).collect(), {r["doc_id"]: r["text"] for r in one.collect()})
    assert packing.pack(none).count() == 0
    r = packing.pack(nothing).first()
    assert (r["length"], r["doc_tokens"], r["offset"]) == (1, 1, 0)
    rng = np.random.default_rng(4)
    texts = {k: " ".join(rng.choice(["alpha", "beta", "gamma.", "delta,"], rng.integers(1, 900))) for k in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert check_pieces(packing.pack(docs).collect(), texts) > 0.98


def padding(length, size=1024):
    return 0 if length & (length - 1) == 0 else size - length


def test_carried_on_like_the_whole_stream():
    """Whatever is held at a time, the pieces are those of one pass over the whole stream, and little is held."""
    rng = np.random.default_rng(8)
    made = [rng.integers(300, 5000, rng.integers(0, 300)).tolist() for _ in range(4000)]
    total = sum(len(x) + 1 for x in made)
    found = []
    for look in (1, 700, 4096, 1 << 15, 1 << 40):
        p, rows, most = packing.Packer(tokenizer.DEFAULT, 128, 0, 0, look=look), [], 0
        for k, ids in enumerate(made):
            rows += p.add(k, ids)
            most = max(most, p.tokens - p.emitted)
        rows += p.flush()
        found.append(rows)
        assert look > 1 << 20 or most < total / 3  # what is undecided, not the stream
    assert all(f == found[0] for f in found)
    assert sum(r[2] for r in found[0]) == total


def test_ids_stay_in_arrays():
    """A text's ids reach the packer's pieces without an object each."""
    n = 200_000
    ids = np.random.default_rng(3).integers(300, 5000, n).astype("<u4")
    p = packing.Packer(tokenizer.DEFAULT, 1024, 0, 0, look=1 << 40)
    tracemalloc.start()
    try:
        rows = list(p.add(1, ids))
        assert tracemalloc.get_traced_memory()[1] < 12 * n
    finally:
        tracemalloc.stop()
    rows += p.flush()
    assert sum(r[2] for r in rows) == n + 1
    whole = np.append(ids, 0).astype("<u4")
    assert all(r[3] == zlib.crc32(whole[r[1] : r[1] + r[2]].tobytes()) for r in rows)


def test_windows_of_one_id():
    p = packing.Packer(tokenizer.DEFAULT, 1, 0, 0, step=1)
    rows = [*p.add(1, np.array([7, 8], dtype="<u4")), *p.flush()]
    assert [(r[1], r[2], r[5], r[6]) for r in rows] == [(0, 1, 0, 0), (1, 1, 1, 0), (2, 1, 2, 0)]


def test_repeated_rows_and_ties(spark):
    texts = [("same words again. " * 40, 30), ("", 700), (None, 50), ("x " * 3000, 5)]
    docs = spark.createDataFrame([(k, t) for k, (t, n) in enumerate(texts) for _ in range(n)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).collect()
    total = sum((len(tokenizer.encode(t or "")) + 1) * n for t, n in texts)
    assert sum(r["length"] for r in rows) == total
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(r["start"] for r in rows if r["doc_id"] == 1) == [0] * 700
    assert sum(map(padding, ends.values())) < 0.02 * total
    assert [tuple(r) for r in packing.pack(docs).collect()] == [tuple(r) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 9)), min_size=1, max_size=60), st.lists(st.integers(1, 20), max_size=8))
def test_cuts_are_the_cheapest(steps, looks):
    cuts = np.cumsum([s for s, _ in steps])
    penalties = np.array([p for _, p in steps])
    size = 16
    at, best = [0, *cuts.tolist()], [0]
    for j in range(1, len(at)):
        best.append(min(best[i] + padding(at[j] - at[i], size) for i in range(j) if at[j] - at[i] <= size) + packing.WINDOW + int(penalties[j - 1]))
    chain, out, done = packing.Chain(size), [], 0
    for n in [*looks, len(cuts)]:
        if done < len(cuts):
            chain.extend(cuts[done : done + n], penalties[done : done + n])
            out += chain.decided()
            done += n
    out += chain.finish()
    assert out[-1] == at[-1]
    cost, last = 0, 0
    for c in out:
        assert 0 < c - last <= size
        cost += padding(c - last, size) + packing.WINDOW + int(penalties[at.index(c) - 1])
        last = c
    assert cost == best[-1]


def plain_lzw(data, bits):
    """A decoder that reads one code after the other."""
    clear, stop = 1 << bits, (1 << bits) + 1
    n, have, out, table, width, last = 0, 0, b"", [], bits + 1, None
    for byte in data:
        n, have = n | byte << have, have + 8
        while have >= width:
            code, n, have = n & ((1 << width) - 1), n >> width, have - width
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [None, None], bits + 1, None
            elif code == stop:
                return out
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                out += entry
                if last is not None and len(table) < 4096:
                    table.append(last + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
                last = entry
    return out


def plain_frames(data):
    """(index, shown pixels) of every frame of a GIF as encode_payload() writes it, pixel by pixel."""
    width, height = data[6] | data[7] << 8, data[8] | data[9] << 8
    palette, at = [tuple(data[13 + 3 * k : 16 + 3 * k]) for k in range(256)], 13 + 768
    canvas, shown = [[None] * width for _ in range(height)], []
    while data[at] != 0x3B:
        assert data[at : at + 3] == b"\x21\xf9\x04"
        flags, clear = data[at + 3], data[at + 6]
        at += 8
        w, h, size = data[at + 5] | data[at + 6] << 8, data[at + 7] | data[at + 8] << 8, data[at + 10]
        at, stream = at + 11, b""
        while data[at]:
            stream, at = stream + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        pixels = plain_lzw(stream, size)
        assert len(pixels) == w * h
        for y in range(h):
            for x in range(w):
                if not (flags & 1 and pixels[y * w + x] == clear):
                    canvas[y][x] = palette[pixels[y * w + x]]
        shown.append([list(row) for row in canvas[:h]])
        if flags >> 2 & 7 == 2:
            canvas = [[None] * width for _ in range(height)]
    return shown


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8), st.integers(1, 9))
def test_lzw_round_trip(data, bits, times):
    samples = bytes(b & ((1 << bits) - 1) for b in data * times)
    stream = gif.lzw_encode(samples, bits)
    assert plain_lzw(stream, bits) == samples
    assert gif.lzw_decode(stream, bits, len(samples)).tobytes() == samples


def test_lzw_dictionaries_fill_and_stay():
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()  # several resets
    stream = gif.lzw_encode(samples, 8)
    assert plain_lzw(stream, 8) == samples and gif.lzw_decode(stream, 8, len(samples)).tobytes() == samples
    codes = [256, *rng.integers(0, 256, 9000).tolist(), 257]  # a writer that never resets a full dictionary
    widths = [9, *np.append(gif._widths(4096, 8), [12] * 9000)[:9001].tolist()]
    odd = gif._packed(np.array(codes), np.array(widths))
    assert plain_lzw(odd, 8) == bytes(codes[1:-1]) == gif.lzw_decode(odd, 8, 9000).tobytes()
    for broken in (b"", stream[:-900], gif._packed(np.array([256, 300]), np.array([9, 9]))):
        with pytest.raises(ValueError):
            gif.lzw_decode(broken, 8, len(samples))


def test_payload_round_trip(spark, odd, none, nothing):
    got = gif.round_trip(odd)
    import hashlib

    for r, t in zip(got.collect(), odd.select("text").collect(), strict=True):
        payload, n = gif.padded(t["text"] or "")
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(gif.encode_payload(payload)).hexdigest()
    assert gif.round_trip(none).count() == 0
    assert gif.round_trip(nothing).first()["payload_bytes"] == 64
    text = bytes(range(256)) * 1000
    big = gif.encode_payload(text)
    assert len(gif.decode(big).frames) == 4 and gif.payload_of(big)[0] == text
    shown = gif.frames(gif.media(odd)).collect()
    assert len(shown) >= odd.count() and all(len(r["canvas"]) == 4 * 64 * r["height"] or r["frame"] for r in shown)
    assert gif.frames(gif.media(none)).count() == 0


def test_every_stored_form_of_the_query(spark, odd):
    """What the query reports, from the stored bytes by a plain decoder."""
    texts = [r["text"] or "" for r in odd.select("text").collect()] + [("\0ab" * 9 + "é") * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in gif.round_trip(docs).collect()}
    for r in gif.media(docs).collect():
        shown = plain_frames(bytes(r["gif"]))
        back = bytes(p[0] if p else 0 for f in shown for row in f for p in row)
        assert back == gif.padded(texts[r["doc_id"]])[0]
        seen = Counter(sum(c >> 6 << s for c, s in zip(p, (4, 2, 0), strict=True)) for f in shown for row in f for p in row if p)
        assert got[r["doc_id"]]["feature"] == f"frames={len(shown)};cs={10 * len(shown)};colours=" + ",".join(f"{k}:{n}" for k, n in sorted(seen.items()))


def test_broken_gifs_are_reported(spark):
    whole = gif.encode_payload(bytes(64 * 1500))
    rows = [(1, whole), (2, whole[:-200]), (3, b"PNG"), (4, None), (5, whole[:20])]
    got = [(r["id"], r["frame"], r["error"] is None) for r in gif.frames(spark.createDataFrame(rows, "doc_id long, gif binary")).orderBy("id", "frame").collect()]
    assert got == [(1, 0, True), (1, 1, True), (2, 0, True), (2, 1, False), (3, 0, False), (5, 0, False)]


def image(indices, left=0, top=0, width=4, bits=2, interlace=False):
    import struct

    h = len(indices) // width
    return struct.pack("<BHHHHB", 0x2C, left, top, width, h, 0x40 if interlace else 0) + bytes([bits]) + gif._blocks(gif.lzw_encode(bytes(indices), bits))


def control(disposal, delay, clear=None):
    import struct

    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)


def test_disposal_transparency_and_interlace():
    import struct

    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00"
    rows = [0, 1, 2, 3]
    scrambled = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, 4, step)]
    data = head + loop
    data += control(1, 5) + image([1] * 16)  # all red, kept
    data += control(3, 7, clear=0) + image([2, 0, 0, 2], 1, 1, 2)  # two green dots, then restored
    data += control(2, 9) + image([3] * 4, 0, 0, 2)  # a blue square, then cleared
    data += control(0, 1, clear=0) + image([rows[r] for r in scrambled for _ in range(4)], interlace=True) + b"\x3b"
    a = gif.decode(data)
    assert (a.width, a.height, a.loops) == (4, 4, 5) and [f.delay_cs for f in a.frames] == [5, 7, 9, 1]
    assert (a.frames[0].canvas[..., 0] == 255).all()
    assert a.frames[1].canvas[1, 1].tolist() == [0, 255, 0, 255] and a.frames[1].canvas[1, 2].tolist() == [255, 0, 0, 255]
    assert a.frames[2].canvas[1, 1].tolist() == [0, 0, 255, 255] and a.frames[2].canvas[2, 2].tolist() == [255, 0, 0, 255]
    assert a.frames[3].canvas[0, 0].tolist() == [0, 0, 0, 0]  # cleared, and transparent there
    assert a.frames[3].indices[:, 0].tolist() == rows
    for broken in (b"PNG", head + b"\x99"):
        with pytest.raises(ValueError):
            gif.decode(broken)
