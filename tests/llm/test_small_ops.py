"""MPEG audio, source mix, digest, line dedup, packing and chat: round trips, brute force, odd inputs."""

import hashlib
import os
import random
import zlib
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, digest, linededup, mixing, mpeg, packing
from barloom.llm.oracles import ORACLES

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, bucket string, size string"


def docs(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with those the operators use inside."""
    rows = [(i if ids is None else ids[i], t, None, sources[i] if sources else "s", len(t or ""), "r", "b", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "one", "one", "a\n\n\nb", "x" * 50_000, "word " * 9000, "Ünï ퟿ 文字 😀", "tab\tsep\x0bv\x85n b"]


# -- op1


@pytest.mark.parametrize("n", [0, 1, 192, mpeg.MOST, mpeg.MOST + 1, 5000, 123_457])
def test_mpeg_round_trip(n):
    p = os.urandom(n)
    r = mpeg.read_mpeg(mpeg.write_mpeg(p))
    assert r["payload"] == p and r["crc_ok"] == r["crc_checked"] == r["frames"] and r["vbr_ok"] and r["resyncs"] == 0
    assert r["bytes_ok"] and r["seek_ok"]
    assert r["samples"] == 1152 * r["frames"] and r["duration_ns"] == r["samples"] * 10**9 // 48000 if n else r["frames"] == 0


def test_mpeg_resynchronises_and_finds_damage():
    p = bytes(range(32, 127)) * 60
    m = mpeg.write_mpeg(p)
    r = mpeg.read_mpeg(m)
    second = int(r["offsets"][1])
    cut = m[:second] + b"\xff\xfbnoise\xff\xe0" + m[second:]  # junk between frames
    again = mpeg.read_mpeg(cut)
    assert again["resyncs"] == 1 and again["frames"] == r["frames"] and again["payload"] == p
    bad = bytearray(m)
    bad[second + 8] ^= 1  # inside the protected side information
    assert mpeg.read_mpeg(bytes(bad))["crc_ok"] == r["crc_ok"] - 1
    tagged = mpeg.read_mpeg(m + b"TAG" + b"song".ljust(30, b"\0") + bytes(95))
    assert tagged["tags"]["ID3v1:title"] == "song" and tagged["payload"] == p
    for junk in (None, b"", b"\xff", b"\xff\xfb", os.urandom(3000)):
        assert mpeg.read_mpeg(junk)["payload"] == b""


def test_tables_of_protected_streams_at_either_place():
    m = mpeg.write_mpeg(bytes(range(32, 127)) * 60)
    r = mpeg.read_mpeg(m)
    at = m.index(b"Info")
    start = at - 4 - mpeg.SIDE
    assert m[start : start + 2] == b"\xff\xfb"
    for place in (at, at + 2):  # a protected frame with the table where unprotected ones have it, and behind the checksum
        body = m[at : m.index(b"\xff\xfa")]
        frame = (m[start:start + 1] + b"\xfa" + m[start + 2 : at] + bytes(place - at) + body)[: len(body) + at - start]
        got = mpeg.read_mpeg(m[:start] + frame + m[start + len(frame) :])
        assert got["vbr_ok"] and got["frames"] == r["frames"] and got["duration_ns"] == r["duration_ns"] and got["payload"] == r["payload"]


def test_tags_of_other_versions():
    audio = mpeg.write_mpeg(b"x" * 500)
    audio = audio[audio.index(b"\xff\xfb") :]
    size = lambda n: bytes(n >> k & 0x7F for k in (21, 14, 7, 0))
    read = lambda version, flags, body: mpeg.read_mpeg(b"ID3" + bytes([version, 0, flags]) + size(len(body)) + body + audio)
    two = b"TT2\0\0\5\0song" + b"TXX\0\0\7\0a\0what"
    got = read(2, 0, two)
    assert got["tags"] == {"TT2": "song", "TXX:a": "what"} and got["frames"] == mpeg.read_mpeg(audio)["frames"]
    assert read(2, 0x40, two)["tags"] == {}
    text = b"\0\xff\xe0x\xff"
    three = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    assert read(3, 0x80, three.replace(b"\xff", b"\xff\0"))["tags"] == {"TIT2": text[1:].decode("latin-1")}
    assert read(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + three)["tags"] == {"TIT2": text[1:].decode("latin-1")}
    moved = text.replace(b"\xff", b"\xff\0")
    four = b"TIT2" + size(len(moved) + 4) + b"\0\3" + size(len(text)) + moved
    assert read(4, 0x40, size(6) + b"\1\0" + four)["tags"] == {"TIT2": text[1:].decode("latin-1")}
    for junk in (b"", b"T", b"TIT2\xff", b"\0" * 30):
        for version in (2, 3, 4):
            for flags in (0, 0x40, 0x80, 0xC0):
                assert read(version, flags, junk)["frames"] > 0


def plain_crc(bits):
    c = 0xFFFF
    for x in bits:
        c = (c << 1 ^ (0x8005 if c >> 15 ^ x else 0)) & 0xFFFF
    return c


def bits_of(data):
    return [x >> i & 1 for x in data for i in range(7, -1, -1)]


@pytest.mark.parametrize(
    ("rate", "kbps", "channels", "table"),
    [(48000, 192, 1, "a"), (48000, 28, 2, "c"), (44100, 64, 2, "a"), (44100, 96, 1, "b"), (44100, 160, 2, "b"), (32000, 48, 1, "d"), (44100, 32, 1, "c")],
)
def test_layer2_table(rate, kbps, channels, table):
    assert mpeg._allocation(3, rate, kbps) == table and mpeg._allocation(2, rate // 2, kbps) == "low rates"


@pytest.mark.parametrize(("byte3", "alloc"), [(0xC0, 88), (0x00, 176), (0x40, 16 + 16 + 28 + 36 + 8), (0x70, 16 * 4 * 2 - 5 * 2 + 18 - 2 * 5 + 8)])
def test_layer2_checksums(byte3, alloc):
    """Frames of layer II at 48 kHz, 112 kbit/s a channel or more (table a); the CRC is of whole frames' bits, counted plainly."""
    channels = 1 if byte3 >> 6 == 3 else 2
    widths = [4] * 11 + [3] * 12 + [2] * 4
    bound = 4 * (byte3 >> 4 & 3) + 4 if byte3 >> 6 == 1 else 27
    stream, rng = b"", random.Random(byte3)
    for _ in range(4):
        head = bytes([0xFF, 0xFC, 0xC4, byte3])  # 256 kbit/s, protected: 768 bytes
        body = bytes(rng.randrange(256) for _ in range(768 - 6))
        bits, at, used = bits_of(body), 0, 0
        for i, w in enumerate(widths):
            for _ in range(channels if i < bound else 1):
                used += any(bits[at : at + w]) * (channels if i >= bound else 1)
                at += w
        crc = plain_crc(bits_of(head[2:]) + bits[: at + 2 * used])
        stream += head + crc.to_bytes(2, "big") + body
    r = mpeg.read_mpeg(stream)
    assert (r["frames"], r["crc_checked"], r["crc_ok"], r["samples"]) == (4, 4, 4, 4 * 1152)
    bad = bytearray(stream)
    bad[768 + 7] ^= 0x10  # an allocation of the second frame
    assert mpeg.read_mpeg(bytes(bad))["crc_ok"] == 3


def test_layer1_joint_stereo_checksum():
    body = bytes(range(200))
    head = bytes([0xFF, 0xFE, 0x44, 0x50])  # layer I, 128 kbit/s, 48 kHz, bound 8: 4 * (32 + 8) bits
    crc = plain_crc(bits_of(head[2:] + body[:20]))
    r = mpeg.read_mpeg((head + crc.to_bytes(2, "big") + body[: 128 - 6]) * 3)
    assert (r["frames"], r["crc_checked"], r["crc_ok"], r["samples"]) == (3, 3, 3, 3 * 384)


def plain_frames(n, layer3=b"\xff\xfb\x94\xc0"):
    """Unprotected layer III frames, 128 kbit/s at 48 kHz, mono: 384 bytes each."""
    return [layer3 + bytes(380) for _ in range(n)]


def test_tables_of_other_encoders():
    frames = plain_frames(50)
    total = 51 * 384
    toc = bytes(min(255, (k * 50 // 100 + 1) * 384 * 256 // total) for k in range(100))
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    xing = b"Xing" + (15).to_bytes(4, "big") + (50).to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4) + lame
    head = frames[0][:21] + xing
    r = mpeg.read_mpeg(head.ljust(384, b"\0") + b"".join(frames))
    assert r["vbr_ok"] and r["bytes_ok"] and r["seek_ok"] and len(r["seek_points"]) == 100
    assert (r["delay"], r["padding"], r["samples"]) == (576, 1000, 50 * 1152 - 1576) and r["duration_ns"] == r["samples"] * 10**9 // 48000
    wrong = mpeg.read_mpeg((frames[0][:21] + xing.replace(toc, bytes(100))).ljust(384, b"\0") + b"".join(frames))
    assert not wrong["seek_ok"] and wrong["vbr_ok"]
    vbri = b"VBRI\0\1\0\0\0\0" + total.to_bytes(4, "big") + (50).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (5, 1, 2, 10, *[3840] * 5))
    r = mpeg.read_mpeg((frames[0][:36] + vbri).ljust(384, b"\0") + b"".join(frames))
    assert r["vbr_ok"] and r["bytes_ok"] and r["seek_ok"] and r["frames"] == 50 and r["vbr_frames"] == 50
    cut = mpeg.read_mpeg((frames[0][:36] + vbri).ljust(384, b"\0") + b"".join(frames[:40]))
    assert not cut["vbr_ok"] and not cut["bytes_ok"] and cut["frames"] == 40


def test_older_versions_and_apev2():
    low = b"\xff\xf3\x84\xc0" + bytes(188)  # version 2, layer III, 64 kbit/s at 24 kHz: 192 bytes
    items = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + (3).to_bytes(4, "little") + bytes(12)
    r = mpeg.read_mpeg(low * 5 + items)
    assert (r["frames"], r["samples"], r["rate"], r["resyncs"], r["tags"]["APEv2:items"]) == (5, 5 * 576, 24000, 0, "3")


def test_audio_query(spark):
    got = {r.doc_id: r for r in mpeg.digest(mpeg.probe_audio(mpeg.store_audio(mpeg.payloads(docs(spark, ODD))))).collect()}
    for i, t in enumerate(ODD):
        b = (t or "").encode()
        padded = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        assert got[i].tail_crc32 == zlib.crc32(padded[-16:]) and got[i].feature.startswith("mpeg1-layer3 rate=48000 ")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())
    assert got[3].media_sha256 == got[4].media_sha256 and mpeg.payloads(docs(spark, [])).count() == 0


# -- op4


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    sources = [rng.choice(["hot", "hot", "a", "b", None, "c"]) for _ in range(600)]
    d = docs(spark, [" ".join(["w"] * rng.randrange(0, 400)) for _ in sources], sources=sources)
    rows = mixing.mix_sources(d, docs_per_shard=200).collect()
    assert len(rows) == 600 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    took, target, size = Counter(), {}, Counter()
    for r in rows:
        took[r.doc.source] += r.taken
        size[r.doc.source] += r["size"]
        target[r.doc.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(took[s] - target[s]) <= 0.05 * target[s] + 100
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(d, docs_per_shard=200).collect()))


def test_mix_equals_sql_on_odd_rows(spark):
    d = docs(spark, ODD * 3, ids=[None, 1, 1, -5, 2**62, *range(25)], sources=[None, "a", "b", "é", "z", "a"] * 5)
    got = mixing.mix_sources(d, docs_per_shard=1000)
    got = got.select("doc.doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", "taken", "shard", F.size("spans").alias("n_spans"))
    documents = d.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(ORACLES["op4_source_mix"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, ["", None])).agg(F.sum("taken")).first()[0] == 0


def test_taken_text(spark):
    d = docs(spark, [f"{i}a {i}b {i}c " * 40 for i in range(60)], sources=["a", "b", "c"] * 20)
    m = mixing.mix_sources(d)
    taken = mixing.take_mixed(m)
    words = taken.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert words == m.agg(F.sum("taken")).first()[0]
    assert taken.columns == d.columns and {(r.row, r.bucket, r["size"]) for r in taken.collect()} == {("r", "b", "z")}  # names that clash


def test_chosen_blocks_are_scattered(spark):
    """One long document of 1024 blocks in a source that is taken in part: its blocks are not one run."""
    d = docs(spark, ["w " * 16 * 1024, "v " * 16 * 700], sources=["a", "b"])
    r = next(r for r in mixing.mix_sources(d, weights=(1, 4)).collect() if r.doc.source == "a")
    assert 16 * len(r.spans) == r.taken and sum(x["to"] != y["from"] for x, y in zip(r.spans, r.spans[1:], strict=False)) > 100


# -- op6


def fold(t):
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(n.split())


def test_digest_groups_as_python_does(spark):
    texts = [*ODD, "Straße", "STRASSE", "ﬁne", "fine", "é", "é", " a  b ", "A B", "cafe"]
    got = {r.doc_id: r.fingerprint for r in digest.exact_digest(docs(spark, texts)).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (fold(a) == fold(b)), (a, b)


def test_conflicts_get_a_suffix(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide_hash", lambda c: (F.lit(1).cast("long").alias("h1"), F.length(c).cast("long").alias("h2")))
    got = {r.text: r.fingerprint for r in digest.exact_digest(docs(spark, ["ab", "cd", "ab", "xyz"])).collect()}
    assert got["ab"] != got["cd"] and len(set(got.values())) == 3


def test_fingerprint_report(spark):
    texts = [f"text {i} " * (i % 7 + 1) for i in range(40)] + ODD
    ids = [i * 3 for i in range(len(texts))]
    got = {r.doc_id: r for r in digest.fingerprint_report(docs(spark, texts, ids=ids)).collect()}
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[ids[k]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == float(fold(t) == fold(e)) and r.near_next == float(fold(t) == fold(nxt))
    assert digest.fingerprint_report(docs(spark, [])).count() == 0 and digest.fingerprint_report(docs(spark, ["a"])).first().near_next == 1.0


def test_next_over_many_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id"), F.col("id").cast("string").alias("v"), F.lit(0).cast("long").alias("tie"))
    got = {r.doc_id: r.next_v for r in digest.with_next(d, ["v"], per_bucket=37).collect()}
    v = {(i * 7) % 1000: str(i) for i in range(1000)}
    assert got == {k: v[(k + 1) % 1000] for k in v}


# -- op7


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute_lines(texts):
    kept, seen = [], []
    for t in texts:
        out = []
        for line in (t or "").split("\n"):
            blank = not any(c not in " \t\n\x0b\f\r" for c in line)
            if blank or not any(one_edit(s, line) for s in seen):
                out.append(line)
            if not blank:
                seen.append(line)
        kept.append(None if t is None else "\n".join(out))
    return kept


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 2, 3, 5, 16, 17, 63, 64, 65, 66, 128, 129, 200, 300)]
    lines = list(base)
    for b in base * 6:
        i, c = rng.randrange(len(b) + 1), rng.choice("abcé ")
        lines.append(rng.choice([b[:i] + b[i + 1 :], b[:i] + c + b[i:], b[:i] + c + b[i + 1 :], b]))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [*ODD, "", None, "same\nsame\n\nsame"]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_keeps_columns_and_rows(spark):
    d = docs(spark, ["a\nb c", "a\nc d e\nB c", None])
    got = linededup.dedup_lines(d)
    assert got.columns == d.columns and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {0: ("a\nb c", 5), 1: ("c d e", 5), 2: (None, None)}
    twice = docs(spark, ["one", "one", "two"], ids=[1, 1, 1])  # rows equal in all columns are one document
    assert sorted(r.text for r in linededup.dedup_lines(twice).collect()) == ["one", "two"]
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


# -- op8


def test_packing_rules(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randrange(0, 700)) + f" {i}" for i in range(300)] + ["same text here"] * 40 + ["long " * 5000, None, ""]
    sources = [rng.choice(["hot", "hot", "a", None]) for _ in texts]
    rows = packing.pack(docs(spark, texts, sources=sources), capacity=1000, docs_per_shard=100).collect()
    size = Counter()
    for r in rows:
        size[r.doc_id] += r.n_words
    assert dict(size) == {i: len((t or "").split()) for i, t in enumerate(texts)}
    bins = defaultdict(list)
    for r in rows:
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
    assert {r.doc_id for r in rows if r.bin is None} == {341, 342}
    words, pieces = Counter(), Counter()
    for r in rows:
        if r.bin is not None:
            words[r.shard] += r.n_words
            pieces[r.shard, r.source] += 1
    limit = {k: max(2, -(-2 * n * 1000 // words[k[0]])) for k, n in pieces.items()}
    for (shard, _), got in bins.items():
        got.sort(key=lambda r: r.place)
        assert got[0].place == 0 and all(a.place + a.n_words == b.place for a, b in zip(got, got[1:], strict=False))
        assert got[-1].place + got[-1].n_words <= 1000
        assert all(n <= limit[shard, s] for s, n in Counter(r.source for r in got).items())
        clusters = [(texts[r.doc_id] or "") for r in got]
        assert len(set(clusters)) == len(clusters)
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit_is_tightest_compatible():
    rng = random.Random(7)
    sizes = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    sources, clusters = [rng.randrange(4) for _ in sizes], [rng.randrange(60) for _ in sizes]
    room, seen, held, want, limits = [], [], [], [], [2, 2, 5, 1]
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        fits = [(room[k], k) for k in range(len(room)) if room[k] >= s and c not in seen[k] and held[k][a] < limits[a]]
        k = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100), seen.append(set()), held.append(Counter())
        room[k] -= s
        seen[k].add(c)
        held[k][a] += 1
        want.append(k)
    assert packing.best_fit(sizes, sources, clusters, 100, limits)[0] == want


def test_few_sources_fill_their_bins(spark):
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.randrange(5, 60)) + f" {i}" for i in range(1000)]
    d = docs(spark, texts, sources=["a", "b", "c", "d"] * 250)
    rows = packing.pack(d).where("bin is not null").collect()
    bins = {(r.shard, r.bin) for r in rows}
    assert sum(r.n_words for r in rows) > 0.9 * 2048 * (len(bins) - 1)


def test_packing_of_repeated_rows_and_clashing_names(spark):
    d = docs(spark, ["a b c"] * 7, ids=[1] * 7).withColumns({"piece": F.lit("p"), "shard": F.lit("s"), "bin": F.lit("b"), "cluster": F.lit(1.5)})
    rows = packing.pack(d).collect()
    assert len(rows) == 7 and len({(r.shard, r.bin) for r in rows}) == 7  # one cluster, so no two share a sequence


# -- op10


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", said), (1, 1, "user", "q\n</turn>\n### user:\n"), (1, 2, "assistant", said), (1, 3, "assistant", None), (1, 4, "user", "end"), (2, None, "odd:\\role\n#<", ""), (2, 0, None, "x"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("example", F.lit("x"))
    ex = chat.expand_prefixes(d)
    got = {r.conv_id: r for r in chat.read_examples(ex).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert ex.where("conv_id = 1").count() == 3 and got[2].n_examples == 1
    assert chat.read_examples(chat.expand_prefixes(d.limit(0))).count() == 0
