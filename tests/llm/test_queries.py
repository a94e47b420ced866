"""Every registered query over the smallest tables, whole, against a plain version of its contract."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_jaccard_join import brute

from quillion.llm import chat, packing, queries, token_counts

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_op1(spark, docs):
    found = rows(spark, "op1_telephony_audio")
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        # The stored PCM is what the feature tells of.
        assert r.feature.endswith(f"pcm16k={len(r.pcm) // 2}:{zlib.crc32(r.pcm):08x}") and len(r.pcm) > 2 * len(payload)


def test_op2(spark, docs):
    found = rows(spark, "op2_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op3_packing"):
        own = ids[r.doc_id]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(own[r.start : r.start + r.length].tobytes()), len(own))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, ends in [(pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)]:
        for key, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 2048
    assert pieces.keys() == ids.keys()
    assert sum(map(len, ids.values())) >= 0.95 * 2048 * len(sequences)


def test_op3_patterns_are_those_of_a_plain_shortest_pack_first():
    """Without several copies of a length in one step: a list of packs, each piece into one with most room."""
    rng = np.random.default_rng(5)
    histogram = np.bincount(np.minimum(rng.geometric(0.02, 400), 100), minlength=101)
    histogram[0] = 0
    room: list[int] = []
    for length in range(100, 0, -1):
        for _ in range(histogram[length]):
            best = max(range(len(room)), key=lambda i: room[i], default=None)
            if best is None or room[best] < length:
                room.append(100 - length)
            else:
                room[best] -= length
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = Counter()
    for n, pattern in patterns:
        assert sum(length * k for length, k in pattern) <= 100
        for length, k in pattern:
            placed[length] += n * k
    assert [placed[i] for i in range(101)] == histogram.tolist()
    assert abs(sum(n for n, _ in patterns) - len(room)) <= 0.02 * len(room)


def test_op4_op5(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: library.encode(t) for i, t in docs.items()}
    coded, counted = rows(spark, "op4_sentencepiece"), rows(spark, "op5_token_counts")
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in counted) == sorted(docs)
    for r in coded:
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha(",".join(map(str, own)).encode()), sha(library.decode(own).encode()))
    for r in counted:
        text = docs[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 4096)
        assert token_counts.tokens_at(r.prefix_changes, len(text) // 2) == len(library.encode(text[: len(text) // 2]))


def test_op6(spark, docs):
    found, slots = rows(spark, "op6_hash_tree"), defaultdict(list)
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(spark, docs):
    found = rows(spark, "op7_jaccard_join")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(list(docs.items()), 4, 85, 100))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    asked = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in asked.description]
    found = queries.QUERIES[name](spark, DIR)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == sorted(asked.fetchall(), key=str)


def plain_digests(turns):
    own = "".join(f"{role}\n{text}\n" for role, text in turns)
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), sha(own.encode()), len(loss), sha(loss.encode())


def test_op10(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows(spark, "op10_chat_format")}
    assert found == {c: plain_digests([t[1:] for t in sorted(x)]) for c, x in turns.items()}


def test_op10_log_has_deltas_edits_and_regenerations(spark):
    said = [(c, t, "user" if t % 2 else "assistant", "x" * t + "é😀\\<s>" * (c % 5)) for c in range(20) for t in range(6)]
    said += [(50, 0, None, None), (50, 0, None, None), (50, 1, "user", ""), (None, 3, "assistant", "a"), (None, 2, "system", "b")]
    log = chat.events_of(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    kinds = Counter(r.kind for r in log.collect())
    assert kinds["edit"] > 5 and kinds["regenerate"] > 5 and kinds["delta"] > 2 * len(said) and kinds["start"] > len(said)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.fold(log.orderBy("text"))).collect()}
    turns = defaultdict(list)
    for c, t, role, text in said:
        turns[c].append((t, role or "", text or ""))
    assert found == {c: plain_digests([t[1:] for t in sorted(x)]) for c, x in turns.items()}


def test_op10_events_of_equal_seq_are_folded_by_kind_then_text(spark):
    log = [(1, 0, 5, "delta", None, "b"), (1, 0, 5, "start", "user", None), (1, 0, 5, "edit", None, "z"), (1, 0, 5, "delta", None, "a")]
    folded = chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert [chat.unescape(r.formatted) for r in folded.collect()] == ["<|turn|>user<|text|>zab<|end|>\n"]


def test_op5_long_runs_without_a_space_agree_with_the_matrix_and_take_no_ages():
    import time

    from quillion.llm.piece_bpe import load

    table = token_counts.PrefixCounts(load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = np.random.default_rng(4)
    for alphabet in ("abcdeilnorst", "ab", "中文字ab", "x", "éàè😀\tz"):
        for n in (1, 2, 65, 300):
            text = table.model.escaped("".join(rng.choice(list(alphabet), n)))
            assert table.prefix_changes_of_long(text) == table.prefix_changes([text])[0]
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"), 100_000))
    began = time.process_time()
    assert table.learn({text}, True)[text][0] == len(table.model.library.encode(text))
    assert time.process_time() - began < 20


def test_op9_keeps_columns_of_any_name_and_judges_long_texts(spark):
    from quillion.llm import quality

    long = " ".join(f"the{i} of{i}" for i in range(200_000))
    loop = " ".join(["the cat sat on a mat"] * 50_000)
    said = "the river and the house of a bird in the tree is that it was for her " * 1
    table = [(1, said, 2, "x", True, 3), (2, long, 2, "x", True, 4), (3, loop, 0, None, False, 5), (4, None, 0, None, False, 6), (5, "", 1, "", None, 7)]
    docs = spark.createDataFrame(table, "doc_id long, text string, __q_n int, __q_words string, __q_kept boolean, __q_row int")
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert (judged[2].n_words, judged[2].base_failed, judged[3].n_words, judged[3].base_failed) == (400_000, False, 300_000, True)
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [t for t in table if judged[t[0]].kept]
