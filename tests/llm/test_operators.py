"""Operators of the subpackage against plain re-implementations, on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillion.llm import audio, chat, langid, packing, piece_bpe, quality, queries, sentencepiece_codec, sharding, token_counts, url_filter

#: An id, a text, and columns whose names operators use inside or give out.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, value string, k0 int, o0 int, key int, part int, row int, media int, n_words int, kept int, shard int, slot int, length int, start int"
LONG = "lorem ipsum 日本 é😀 dolor\n" * 6000


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, *[7] * 14) for i, t in rows], SCHEMA)


TEXTS = ["Plain text of some words.", "", None, "  two  spaces ", "ünï ▁ code 😀 <s> </s>\n\n x", "Plain text of some words.", "a" * 300, "\x00\t\r\n", LONG]
ROWS = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


def by_row(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- 1 audio


def adpcm_of_one_block(block):
    """One block, nibble by nibble."""
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEP_SIZES[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + ((step >> 1) if nibble & 2 else 0) + ((step >> 2) if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[nibble])))
            out.append(value)
    return out


def test_adpcm_against_one_block_at_a_time():
    data = np.random.default_rng(1).integers(0, 256, (50, 64), np.uint8)
    got = audio.decode_adpcm(data)
    assert [list(map(int, r)) for r in got] == [adpcm_of_one_block(bytes(r)) for r in data]


def test_telephony_tables():
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    # Values of the recommendation: extremes and zero.
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_audio_round_trip(docs):
    stored = audio.store(docs)
    found = audio.read(stored, ["doc_id", "n_bytes"]).collect()
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=str) == sorted(want, key=str)
    media = {r.doc_id: r.media for r in stored.collect()}
    for r in found:
        if r.doc_id is not None:
            assert len(media[r.doc_id]) == r.media_bytes and hashlib.sha256(media[r.doc_id]).hexdigest() == r.media_sha256
            codec, payload = audio.parse_wav(media[r.doc_id])
            codes = np.frombuffer(payload, np.uint8)
            samples = sum((adpcm_of_one_block(payload[j : j + 64]) for j in range(0, len(payload), 64)), []) if codec == "ima_adpcm" else audio.TABLES[codec][codes].tolist()
            pcm = np.frombuffer(r.pcm, "<i2")
            assert pcm[::2].tolist() == samples and f"n={len(samples)}:" in r.feature
    assert audio.read(audio.store(docs.limit(0)), ["doc_id"]).count() == 0


# ---- 2 language ID


def test_kernel_against_sets():
    texts = ["the cat sat", "cat the", "", None, "Über 12 öl", "x" * 500]

    def places(t):
        grams = {f" {w} "[i : i + n] for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for n in range(1, 5) for i in range(len(w) + 3 - n)} - {" "}
        out = set()
        for g in grams:
            h = 0
            for n, c in enumerate(g, 1):
                h = (h * 0x100000001B3 + ord(c) + n) & 0xFFFFFFFFFFFFFFFF
            out.add((h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 49)
        return out

    rows = langid.bit_rows(texts)
    sets = [places(t) for t in texts]
    assert [set(np.flatnonzero(r).tolist()) for r in rows] == sets
    got = langid.kernel(rows, rows.astype(np.float32))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert got[i, j] == pytest.approx(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))), abs=1e-5)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 20 and sum(held) >= 0.95 * len(held)


def test_language_odd_rows(spark, docs):
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert (2, "und", 0.0) in got and (1, "und", 0.0) in got and (7, "und", 0.0) in got and (0, "en", 1.0) in got and len(langid.predict(docs, model).collect()) == len(ROWS)
    assert langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == len([t for _, t in ROWS if t and re.search(r"[^\W\d_]", t)])
    assert langid.train(docs.limit(0)) is None and langid.predict(docs.limit(0), None).count() == 0


def test_language_is_learned_from_distinct_texts(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(langid, "learn", lambda rows, languages: learned.extend(languages))
    docs = spark.range(60_000).selectExpr("id as doc_id", "concat('word ', repeat(char(97 + id % 20), 3), ' ', repeat(char(97 + id div 20 % 15), 4)) as text", "'en' as lang")
    langid.train(docs)
    assert len(learned) == langid.SAMPLE



# ---- 3 packing


@pytest.mark.parametrize("seed", range(4))
def test_pattern_counts(seed):
    rnd = random.Random(seed)
    room = 64
    hist = np.zeros(room + 1, np.int64)
    for n in range(1, room + 1):
        hist[n] = rnd.choice([0, 0, rnd.randrange(50), rnd.randrange(5000)])
    patterns = packing.shortest_pack_first(hist, room)
    used = np.zeros(room + 1, np.int64)
    for count, pattern in patterns:
        assert sum(n * c for n, c in pattern) <= room
        for n, c in pattern:
            used[n] += count * c
    assert (used == hist).all()
    assert len(patterns) < 6 * room
    tokens = int((hist * np.arange(room + 1)).sum())
    assert sum(c for c, _ in patterns) >= -(-tokens // room)


def test_packing(spark, docs):
    path, room = public_tokenizers.path("word_bpe_49k.json"), 256
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, room, keep_ids=True).collect()
    seqs = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 1 <= r.length <= room
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    assert sorted(seqs) == list(range(len(seqs)))
    want = sorted(str((i, s, ids[s : s + room])) for i, t in ROWS for ids in [tok.encode(t or "", add_special_tokens=False).ids + [1]] for s in range(0, len(ids), room))
    assert sorted(str((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert packing.pack_documents(docs.limit(0), path, room).count() == 0


# ---- 4, 5 SentencePiece

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=300):
    rnd = random.Random(5)
    out = ["", " ", "  ", " a", "a ", "  a  b \n\n c ", "\n", "\n\n x", "▁ a▁▁b", "日本語 😀", "<s> </s> <0x0A> <unk>", " " * 70 + "x", "internationalization" * 9, "ab\n", "a\n b", "\ta\r\n"]
    return out + ["".join(rnd.choice("ab \n▁.é日1ther") for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_codec_against_the_library(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = piece_bpe.load(PIECES)
    for t in odd_texts():
        ids = lib.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == lib.decode(ids), t
    got = sentencepiece_codec.encode(docs, PIECES).collect()
    want = [(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t in ROWS]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)
    digest = by_row(sentencepiece_codec.digests(docs, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digest == sorted(((i, len(x), sha(",".join(map(str, x))), sha(d)) for i, x, d in want), key=str)
    assert sentencepiece_codec.digests(docs.limit(0), PIECES).count() == 0


def test_the_library_check_notices(monkeypatch):
    model = piece_bpe.load(PIECES)
    with pytest.raises(RuntimeError, match="by the library"):
        model.check_units(["word", "other"], [model.encode("word"), [5]])


def test_counts_at_every_prefix(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts(120)
    got = token_counts.count(table(spark, list(enumerate(texts))), PIECES).collect()
    for r in got:
        t = texts[r.doc_id]
        want = [len(lib.encode(t[:k])) for k in range(len(t) + 1)]
        assert token_counts.counts_by_prefix(r.prefix_changes).tolist() == want, t
        assert r.n_tokens == want[-1]
        budget = want[-1] // 2
        assert token_counts.longest_within(r.prefix_changes, budget) == max(k for k, n in enumerate(want) if n <= budget)
        assert token_counts.tokens_at(r.prefix_changes, len(t) // 2) == want[len(t) // 2]
    rows = by_row(token_counts.count(docs, PIECES), "doc_id", "n_bytes", "n_tokens")
    assert rows == sorted(((i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in ROWS), key=str)
    assert token_counts.count(docs.limit(0), PIECES).count() == 0


# ---- 6 hash tree


def shard_by_hand(key, n):
    def long_hash(v, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", v), seed)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = signed(xxhash.xxh64_intdigest(key.encode(), 42))
    shards = list(range(n))
    racks = [shards[i : i + 4] for i in range(0, n, 4)]
    regions = [racks[i : i + 2] for i in range(0, len(racks), 2)]

    def draw(level, number, weight):
        u = ((long_hash((level << 32) + number, long_hash(h, 42)) >> 11) + 1) / float(1 << 53)
        return math.log(u) / weight

    r = max(range(len(regions)), key=lambda i: draw(0, i, sum(map(len, regions[i]))))
    k = max(range(len(regions[r])), key=lambda i: draw(1, racks.index(regions[r][i]), len(regions[r][i])))
    return max(regions[r][k], key=lambda s: draw(2, s, 1.0))


def test_hash_tree_by_hand(spark):
    rows = [(i, f"t{i}") for i in range(400)] + [(5, "t5"), (None, None)]
    got = sharding.place(table(spark, rows), 24).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.shard == shard_by_hand(str(r.doc_id), 24) and r.grown_shard == shard_by_hand(str(r.doc_id), 25)
        assert r.grown_shard in (r.shard, 24)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    none = next(r for r in got if r.doc_id is None)
    assert (none["size"], none.text_crc32) == (8, 0)


def test_hash_tree_moves_only_into_a_heavier_shard(spark):
    docs = table(spark, [(i, "x") for i in range(3000)])
    before = {r.doc_id: r.shard for r in sharding.place(docs, 24).collect()}
    after = {r.doc_id: r.shard for r in sharding.place(docs, 24, weights={3: 0.0}).collect()}
    assert all(after[i] != 3 for i in after)
    # Whatever was in other regions stays; only the lighter subtree loses rows.
    assert all(before[i] == after[i] for i in before if before[i] >= 8)
    assert sharding.place(docs.limit(0), 24).count() == 0


# ---- 8 URL filter


def test_url_filter(spark):
    listed = spark.createDataFrame([*queries.URL_RULES, (None, "block"), ("nopath", "block")], "entry string, verdict string")
    urls = ["http://Example.ORG/es/1", "https://a.example.org/en/12?x#y", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/DE/a", "http://org", "http://org/", "no scheme", "", None, "http://h?q://z", "a://b://c/d", "http://x.org:80/p", "http://" + "a." * 3000 + "example.org/es/" + "x" * 5000]
    want = [("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"), ("x.com", "/fr/a", "com/fr/", "allow"), ("x.com", "/de/a", "com/de/", "block"), ("x.com", "/DE/a", None, "allow"), ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("x.org:80", "/p", None, "allow"), ("a." * 3000 + "example.org", "/es/" + "x" * 5000, "example.org/es/", "block")]
    pages = spark.createDataFrame([(i, u, "e", "r", 1, "w") for i, u in enumerate(urls)] + [(None, urls[0], "e", "r", 1, "w"), (0, urls[0], "e", "r", 1, "w")], "page_id long, url string, entry string, rule string, row int, words string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, listed).collect()), key=str)
    assert got == sorted([(i, *w) for i, w in enumerate(want)] + [(None, *want[0]), (0, *want[0])], key=str)
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), default="block").collect()} == {"block"}


# ---- 9 quality


def counts_by_hand(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_quality_counts_by_hand(spark):
    rnd = random.Random(2)
    texts = [t for t in TEXTS if t != LONG] + ["a b c d e a b c d e f", "x\nx\n x\n\nx", " \x0b\x0c", "€ 😀 é# * $"] + [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts += ["\n".join(f"line {rnd.randrange(4)} of it" for _ in range(30)), " ".join(f"w{i}" for i in range(5000))]
    got = quality.judge(table(spark, list(enumerate(texts)))).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == [(i, *counts_by_hand(t)) for i, t in enumerate(texts)]
    assert all(not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.broken_rules) for r in got)


def test_quality_keeps_clean_rows_whole(spark, docs):
    clean = "The quick brown fox jumps over a lazy dog and runs to the river with all of its friends today."
    rows = table(spark, [(1, clean), (1, clean), (None, clean), (2, clean.replace(" ", "$$$ ")), (3, clean.upper().replace(" ", "!! ")), (4, None), (5, " ".join(w for w in clean.split() for _ in range(4)))])
    kept = quality.keep_clean(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, None]
    assert quality.judge(docs).count() == len(ROWS) and quality.judge(docs.limit(0)).count() == 0


# ---- 10 chat


def fold_by_hand(events):
    """A conversation's events in the order of seq, with all messages in memory."""
    messages = {}
    for number, seq, kind, role, text in sorted(events, key=lambda e: (e[1], chat.KINDS.index(e[2]))):
        if kind == "start":
            messages[number] = [role or "", ""]
        elif kind == "regenerate":
            messages = {n: m for n, m in messages.items() if n <= number}
            if number in messages:
                messages[number][1] = ""
        elif number in messages:
            messages[number][1] = (text or "") if kind == "edit" else messages[number][1] + (text or "")
    return [tuple(messages[n]) for n in sorted(messages)]


@pytest.mark.parametrize("seed", range(3))
def test_chat_folds_as_by_hand(spark, seed):
    rnd = random.Random(seed)
    log, want = [], {}
    for conv in (None, 1, 2, 3, 4):
        events, live = [], 0
        for seq in range(60):
            kind = rnd.choice(["start", "delta", "delta", "delta", "edit", "regenerate"])
            number = live if kind == "start" else rnd.randrange(max(1, live))
            if kind == "start":
                live += 1
            if kind == "regenerate":
                live = min(live, number + 1)
            events.append((number, seq, kind, rnd.choice(["user", "assistant", None]) if kind == "start" else None, rnd.choice(["a ", "<|end|>\n", "\\", None, "[INST]</s>"])))
        want[conv] = fold_by_hand(events)
        log += [(conv, *e) for e in events]
    rnd.shuffle(log)
    df = spark.createDataFrame([(*e, 1) for e in log], "conv_id long, message long, seq long, kind string, role string, text string, position int")
    got = {}
    for r in chat.fold(df).collect():
        m = re.fullmatch(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", r.formatted, re.DOTALL)
        got.setdefault(r.conv_id, []).append((r.position, (chat.unescape(m[1]), chat.unescape(m[2])), r.mask_start, r.mask_chars, r["at"], r.formatted))
    for conv, turns in want.items():
        rows = sorted(got.get(conv, []))
        assert [t for _, t, *_ in rows] == turns
        whole = "".join(r[5] for r in rows)
        for (role, text), (_, _, start, chars, at, piece) in zip(turns, rows):
            assert whole[at : at + len(piece)] == piece
            assert (start is None) == (role != "assistant")
            assert start is None or chat.unescape(whole[start : start + chars]) == text


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, "assistant", "x\\<|end|>\n<|turn|>[INST] <s>"), (None, 0, None, "n"), (3, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.read_back(chat.fold(chat.events_of(df), dealt=True)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi\nassistant\n\nassistant\n\n") and (got[1].loss_chars, got[1].loss_sha256) == (0, sha(""))
    assert got[2].loss_sha256 == sha(rows[3][3]) and got[3].loss_chars == 250_000 and got[None].turns_sha256 == sha("\nn\n")
    assert chat.read_back(chat.fold(chat.events_of(df.limit(0)), dealt=True)).count() == 0


def test_escaping_is_reversible():
    rnd = random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice(["<", "|", "\\", "[", "INST]", "/", "s>", "<<SYS>>", "a", "\n"]) for _ in range(rnd.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", e)
