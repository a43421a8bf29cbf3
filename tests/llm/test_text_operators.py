"""Token counts, packing, chat formatting, url verdicts, components."""

import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import chat, components, packing, tokens, url_filter
from tickloom.llm.shared import new_path

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a  b", "a \n b", "foo<|endoftext|> b", "<|ENDOFTEXT|>x", "It's don't, they'll.", "Éa. ÀB,", "x  y",
       "\x1c a\x1cb", "  lead", "trail  ", "a\tb\r\nc", "naïve—dash… 12,345.6!", "ΣΑΣ. ΣΑΣ", "<|startoftext|>,", "!!??",
       "word.%%% b", "é ́e", "漢字 かな", "a" * 3000, "1 22 333"]


@pytest.mark.parametrize("kind,path,of", [(tokens.PieceCounts, BYTES, lambda e: len(e.ids)),
                                          (tokens.PieceIds, WORDS, lambda e: np.array(e.ids, "<u2").tobytes())])
def test_pieces_equal_the_library(kind, path, of):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab É.'\n,1<|é") for _ in range(40)) for _ in range(300)]
    library = Tokenizer.from_file(path)
    assert kind(path).of(texts) == [of(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_kept_pieces_stay_small():
    rng, letters = random.Random(3), "abcdefghijklmnoprstuvé"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 12))) + rng.choice(["", "", ",", ".)"]) for _ in range(600_000)]
    words += ["".join(rng.choices(letters, k=2000)) + "!" * 100 for _ in range(300)]
    table, most = tokens.PieceIds(WORDS), 0
    for at in range(0, len(words), 50_000):
        table.of([" ".join(words[at:at + 50_000])])
        most = max(most, sum(sys.getsizeof(kept) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in kept.items())
                             for kept in (table, table.signs)))
    assert most < 64 << 20
    library = Tokenizer.from_file(WORDS)
    texts = [" ".join(words[:40]), " ".join(words[-3:]), " ".join(words[-310:-290])]
    assert table.of(texts) == [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_through_the_cache(spark, docs, monkeypatch):
    rows = [(1, "one two"), (2, None), (3, "one two"), (3, "one two"), (None, "x"), (4, "long " * 600)]
    path = new_path(spark, "cache")
    first = sorted(map(tuple, tokens.token_counts(docs(rows), path, BYTES).collect()), key=str)
    count = {t: len(Tokenizer.from_file(BYTES).encode(t).ids) for t in ("one two", "x", "long " * 600)}
    want = [(i, len((t or "").encode()), count.get(t, 0), count.get(t, 0) > 512) for i, t in rows]
    assert first == sorted(want, key=str)
    cache = spark.read.schema(tokens.CACHE_SCHEMA).parquet(path)
    assert cache.count() == 4 and tokens.count_misses(docs(rows), cache, BYTES).count() == 0
    assert tokens.count_misses(docs(rows + [(9, "new")]), cache, BYTES).count() == 1
    assert tokens.token_counts(docs([]), new_path(spark, "cache"), BYTES).count() == 0


def test_batches_share_one_cache(spark, docs):
    path = new_path(spark, "cache")
    first, second = [(i, f"text {i % 7}") for i in range(40)], [(i, f"text {i % 9}") for i in range(40, 80)] + [(None, None), (5, "text 1")]
    got = sorted(map(tuple, tokens.token_counts_in_batches([docs(first), docs(second)], path, BYTES).collect()), key=str)
    library = Tokenizer.from_file(BYTES)
    assert got == sorted([(i, len((t or "").encode()), len(library.encode(t or "").ids), False) for i, t in first + second], key=str)
    assert spark.read.schema(tokens.CACHE_SCHEMA).parquet(path).count() == 10  # 7 contents, then 2 new ones and the empty one


def test_hot_content_is_not_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(tokens, "HOT", 4)
    rows = [(i, "the same" if i % 3 else f"own {i}") for i in range(120)] + [(500, "twice"), (501, "twice")]
    got = tokens.token_counts(docs(rows), new_path(spark, "cache"), BYTES)
    library = Tokenizer.from_file(BYTES)
    assert sorted(map(tuple, got.collect())) == sorted((i, len(t), len(library.encode(t).ids), False) for i, t in rows)


def test_texts_are_tokenized_in_portions(spark, docs, monkeypatch):
    rows = [(i, f"word{i} " * 40) for i in range(60)] + [(60, None), (61, ""), (None, "x " * 900)]
    whole, seen = packing.portions, []
    monkeypatch.setattr(packing, "portions", lambda b: (seen.append(len(p)) or p for p in whole(b, 1, 1000)))
    frames = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: frames.append((f, self.toArrow())) or self)
    packing.tokenized(docs(rows), WORDS)
    encode, table = frames[0]
    out = [b for b in encode(iter(table.combine_chunks().to_batches()))]
    library = Tokenizer.from_file(WORDS)
    want = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END], "<u2").tobytes()) for i, t in rows]
    got = [(r["doc_id"], r["ids"]) for b in out for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(seen) < 5 and len(out) == len(seen)


def test_packing_keeps_every_id_once(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "42"]) for _ in range(rng.randrange(900)))) for i in range(60)]
    rows += [(100, "gamma " * 9000), (101, None), (101, None), (None, "delta"), (102, "")]
    got = packing.pack(docs(rows), WORDS, group_tokens=20_000).collect()
    library = Tokenizer.from_file(WORDS)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [packing.END])
    covered, sequences = {}, {}
    for r in got:
        own = ids[r.doc_id][0]
        part = np.array(own[r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(own)
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: sum(map(len, lists)) for i, lists in ids.items()}
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    groups = {s >> 32 for s in sequences}
    assert len(groups) > 1 and padding <= packing.CAPACITY * len(groups)
    assert packing.pack(docs([]), WORDS).count() == 0


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_assign_fills_sequences(lengths):
    pieces, costs = packing.assign(lengths)
    seen = {}
    for doc, start, length, seq, offset in pieces:
        seen.setdefault(doc, []).append((start, length))
        assert length > 0 and offset + length <= packing.CAPACITY
    for doc, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == lengths[doc]
    assert len(seen) == len(lengths)


@given(st.text(alphabet="<[\\|/sSYINT]> >aé\n", max_size=60), st.text(alphabet="usn\\\n<|[>/]", max_size=8))
@settings(max_examples=400, deadline=None)
def test_turns_round_trip(text, role):
    segment, start, end, _ = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.read_turn(segment) == (role, text)
    assert segment.count("<|") == 2 and "[INST]" not in segment and "</s>" not in segment
    segment, start, end, _ = chat.format_turn("assistant", [{"type": "text", "text": text}])
    assert chat.read_text(segment[start:end]) == text


def test_parts_become_placeholders(spark):
    parts = [("text", "look <|image|> ", None, None, None, None, None), ("image", None, "a.png", 280, 56, None, None),
             ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3),
             ("image", None, None, None, None, None, None), (None, "end", None, None, None, None, None)]
    row = chat.format_conversations(spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    first, second = sorted(row.collect(), key=lambda r: r.turn)
    assert [(a.kind, a.uri, a.tokens) for a in first.attachments] == [
        ("image", "a.png", 20), ("audio", "b.wav", 63), ("document", "c.pdf", 1536), ("image", None, 256)]
    for a in first.attachments:
        assert first.segment[a.place:].startswith(chat.PLACEHOLDERS[a.kind])
    assert first.attachment_tokens == 1875 and chat.read_turn(first.segment) == ("user", "look <|image|> end")
    assert chat.read_turn(second.segment) == ("", "")


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 5, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(
        chat.format_conversations(turns.withColumn("parts", chat.text_parts()))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].loss_chars == 1
    assert got[2].n_turns == 2 and got[2].turns_sha256 == sha("user\na\n" * 2) and got[2].loss_sha256 == sha("")
    assert got[None].turns_sha256 == sha("\nz\n")


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 80)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in parent} and len(got) == len(parent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_verdicts(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "HTTP://WWW.Example.com/en/1", None), (2, "http://a.example.com/en/2?x", ""), (3, "http://a.org/1", link.format("http://b.net/fr/9")),
        (4, "http://c.org/1#top", '<meta http-equiv="refresh" content="0; url=http://a.org/1/">'),
        (5, "http://d.org/", link.format("http://b.net/es/9")), (6, "https://d.org/?utm_source=a", link.format("//x.com/1")),
        (7, None, None), (8, "no scheme", None), (9, "http://net", None), (10, "http://e.org/1", None), (10, "http://e.org/1", None),
        (11, "http://f.org/1", link.format("/2")), (12, "http://f.org/2", None), (13, "http://example.com/en/3", None),
    ]
    moved = spark.createDataFrame([("http://f.org/2", "http://b.net/fr/z"), (None, "http://q.net/fr/1")], "from_url string, to_url string")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"),
                                                  redirects=moved).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and got[13].verdict == "block"
    assert [got[i].verdict for i in (3, 4, 11, 12)] == ["block"] * 4 and got[3].rule is None
    assert [got[i].verdict for i in (5, 6)] == ["allow"] * 2  # an allowed alias goes before a blocked one
    assert (got[7].host, got[7].path, got[7].verdict) == ("", "", "allow") and got[8].verdict == "allow"
    assert got[9].rule is None and got[10].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page,target,want", [
    ("http://a.org/x/y.html?k=1", "c.html", "http://a.org/x/c.html"), ("http://a.org/x/y/z", "../c", "http://a.org/x/c"),
    ("http://a.org/x/", "./c/./d/..", "http://a.org/x/c/"), ("http://a.org", "c", "http://a.org/c"), ("http://a.org/x", "../../c", "http://a.org/c"),
    ("http://a.org/x?k=1", "?id=2&amp;n=3", "http://a.org/x?id=2&n=3"), ("http://a.org/x?k=1", "#top", "http://a.org/x?k=1"),
    ("http://a.org/x", "/login?next=http://x.net/es/1", "http://a.org/login?next=http://x.net/es/1"), ("http://a.org/x", "mailto:b@c.org", None),
    ("http://a.org/x", "//h.org/b?u=http://x.net/es/1", "http://h.org/b?u=http://x.net/es/1"), ("http://a.org/x", "HTTPS://b.org/../z", "HTTPS://b.org/../z"),
    ("http://a.org/x", "/a/../b//c/.", "http://a.org/b//c/"), ("http://a.org/x", "next=http://x.net/es/1", "http://a.org/next=http://x.net/es/1"),
    ("http://a.org/x", "", None)])
def test_links_are_resolved_against_the_page(spark, page, target, want):
    import duckdb

    row = spark.createDataFrame([(page, target)], "url string, target string")
    assert row.select(url_filter.resolved(F.col("target"), F.col("url"))).first()[0] == want
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (url VARCHAR, html VARCHAR)")
    db.execute("INSERT INTO pages VALUES (?, ?)", [page, f'<link rel="canonical" href="{target}">'])
    assert db.execute(url_filter._sql_found(url_filter.LINK, url_filter.HREF)).fetchone()[1] == want


def test_an_address_inside_a_query_is_no_alias(spark):
    pages = [(1, "http://good.example.net/a", '<link rel="canonical" href="/login?next=http://x.net/es/1">'), (2, "http://b.net/fr/1", None),
             (3, "http://c.org/d/e", '<link rel="canonical" href="../f">'), (4, "http://c.org/f", '<link rel="canonical" href="http://b.net/fr/1">')]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "allow", 2: "block", 3: "block", 4: "block"}
