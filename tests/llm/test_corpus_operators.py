"""Near duplicates, decontamination, fingerprints, personal data, classifiers, pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, fingerprints as fp, near_dedup, personal_data as pd_, quality, toxicity, wordhash

VOCABULARY = ["".join(random.Random(i).choice("bdfgklmnprst") + random.Random(i + 9999).choice("aeiou")
                      for _ in range(1)) + str(i) for i in range(3000)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


def shingles(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
         for x in re.split("[ \t\n\x0b\x0c\r]+", text or "") if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width, similarity):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("width,similarity", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, width, similarity):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 120)))) for i in range(100, 160)]
    base = prose(rng, 90)
    rows += [(1000 + i, " ".join(edited(rng, base, rng.randrange(0, 7)))) for i in range(90)]  # one large group
    chain = prose(rng, 80)
    for i in range(25):  # neighbours alike, ends not
        rows.append((3000 - i, " ".join(chain)))
        chain = edited(rng, chain, 2)
    rows += [(5000 + i, " ".join(base[:45] + prose(rng, 45))) for i in range(40)]  # half of each text in common
    rows += [(6000 + i, "same Text here again\tand again") for i in range(30)] + [(6100, "SAME text here\nagain and again")]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "one"), (7004, "One"), (7005, "one two"), (7006, "É"), (7007, "é")]
    rows += [(8000, "w" * 50_000 + " tail"), (101, rows[1][1])]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(docs(rows + [(None, "one"), (None, None)]), width, similarity).collect()
    want = brute_components(rows, width, similarity)
    assert len(got) == len(rows) + 2
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.component_id for i, r in named.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {i: len(shingles(t, width)) for i, t in rows}
    assert all(r.n_shingles == sizes[i] for i, r in named.items())


@pytest.mark.parametrize("similarity", [80, 85])
def test_differences_from_a_hub_are_placed_only_as_far_as_links_need(spark, similarity):
    rng = random.Random(41)
    fresh = iter(range(1000, 10**9))
    hub = set(range(300))
    changed = lambda base, n: base - set(rng.sample(sorted(base), n)) | {next(fresh) for _ in range(n)}
    texts = []
    for _ in range(12):  # families far from the hub, members from alike to just not linked
        head = changed(hub, rng.randrange(20, 90))
        texts += [head] + [changed(head, rng.randrange(0, 45)) for _ in range(6)]
    copies = [changed(hub, 8) for _ in range(10)]
    copies = [c for c in copies for _ in range(5)]  # linked with the hub, with edits only they have, five times each
    alike = lambda x, y, percent: 100 * len(x & y) >= percent * len(x | y)
    sets = dict(enumerate([x for x in texts if alike(x, hub, near_dedup.NEAR)] + copies))
    linked = {i for i, x in sets.items() if alike(x, hub, similarity)}
    rows = [(i, -1, i in linked, sorted(x ^ hub), len(x & hub), len(x), len(hub)) for i, x in sets.items()]
    near = spark.createDataFrame(rows, "a long, b long, linked boolean, diff array<long>, common long, na long, nb long")
    want = {(i, j) for i in sets for j in sets if i < j and not {i, j} <= linked and alike(sets[i], sets[j], similarity)}
    got = {tuple(sorted(r)) for r in near_dedup.third_pairs(near, similarity).collect()}
    assert len(want) > 30 and want <= got and not any({i, j} <= linked for i, j in got)
    places = collections.Counter(r.rep for r in near_dedup.rarest_differences(near, similarity).collect())
    holders = collections.Counter(z for x in sets.values() for z in x ^ hub)
    shared = {i: sum(holders[z] > 1 for z in x ^ hub) for i, x in sets.items()}
    wanted = {z for i, x in sets.items() if i not in linked for z in x ^ hub}
    assert all(places[i] <= len((x ^ hub) & wanted) for i, x in sets.items())
    far = [i for i in sets if i not in linked]
    assert sum(places[i] for i in far) < 0.7 * sum(shared[i] for i in far)
    ours = [i for i in sets if i >= len(sets) - len(copies)]
    assert set(ours) <= linked and 2 * sum(places[i] for i in ours) <= sum(shared[i] for i in ours)


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    kept = near_dedup.without_near_duplicates(docs([(2, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (None, "a b c d e f")]))
    assert sorted(((r.doc_id, r.score) for r in kept.collect()), key=str) == [(1, "x"), (None, "x")]


def test_rows_that_repeat_a_doc_id(docs):
    rng = random.Random(20)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join(edited(rng, b, 1))
    rows = [(7, " ".join(a)), (7, near), (3, " ".join(b)), (7, " ".join(c)), (7, " ".join(c)), (7, None), (9, " ".join(c)),
            (None, near)]
    kept = near_dedup.without_near_duplicates(docs(rows)).collect()
    want = [(7, " ".join(a)), (3, " ".join(b)), (7, " ".join(c)), (7, None), (None, near)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(
        [(7, 7), (7, 3), (3, 3), (7, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    many = [(7, " ".join(prose(rng, 30))) for _ in range(300)]
    assert near_dedup.without_near_duplicates(docs(many)).count() == 300


def test_leaks_go_by_row(docs, spark):
    rng = random.Random(21)
    item, a, b = (" ".join(prose(rng, 30)) for _ in range(3))
    rows = [(7, a), (7, f"{a} {item}"), (None, f"{b} {item}"), (None, b), (8, None)]
    left = decontaminate.without_leaks(docs(rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.score) for r in left), key=str) == sorted(
        [(7, a, "x"), (None, b, "x"), (8, None, "x")], key=str)


def test_bands_catch_links():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))
        x, y = (near_dedup.signature(np.concatenate([common, s]), near_dedup.BANDS * near_dedup.ROWS).reshape(near_dedup.BANDS, -1)
                for s in (a, b))
        missed += not (x == y).all(axis=1).any()
    assert missed == 0


def test_leaks(docs, spark):
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, 20 + i))) for i in range(20)] + [(90, "Tiny item"), (91, ""), (92, None)]
    text = dict(items)
    rows = [(i, " ".join(prose(rng, 200))) for i in range(40)]
    lead, tail = " ".join(prose(rng, 150)), " ".join(prose(rng, 150))
    rows += [(100 + i, f"{lead} {text[i].upper()}\n{tail}") for i in range(10)]
    twice = text[11].split()
    rows.append((200, " ".join(twice[:8] + ["changed"] + twice[9:16] + twice[17:]) + " " + tail))  # one changed, one left out
    rows.append((201, lead + " " + " ".join(twice[:8])))  # a part only
    rows += [(300 + i, f"{text[12]} {i}") for i in range(60)]  # a very frequent leak
    rows += [(400, None), (401, ""), (402, "here a tiny item is"), (403, f"{text[3]} x {text[4]} {text[3]}")]
    rows += [(None, text[5]), (500, text[6]), (500, text[6])]
    got = decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(100 + i, i) for i in range(10)} | {(200, 11), (402, 90), (403, 3), (403, 4), (None, 5), (500, 6)}
    want |= {(300 + i, 12) for i in range(60)}
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.similarity == 1.0 for r in got if r.doc_id != 200)
    blocks = decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=700)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got))
    assert decontaminate.leaks(docs([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(docs(rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_uneven_frequency(docs, spark):
    rng = random.Random(16)
    item = prose(rng, 20)
    rows = [(0, " ".join(item))]
    rows += [(i, " ".join(prose(rng, 5) + item[:10] + ["changed"] + item[11:])) for i in range(1, 5001)]
    got = decontaminate.leaks(docs(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.similarity for r in got} == {0: 1.0} | {i: 0.95 for i in range(1, 5001)}
    assert len(got) == 5001


def plain_alignment(a, b):
    """(score, equal words, columns) of the best local alignment, cell by cell."""
    last, best = [(0, 0, 0)] * (len(b) + 1), (0, 0, 0)
    for x in a:
        row = [(0, 0, 0)]
        for j, y in enumerate(b):
            s, e, c = last[j]
            cells = [(s + 2, e + 1, c + 1) if x == y else (s - 1, e, c + 1)]
            cells += [(s - 1, e, c + 1) for s, e, c in (last[j + 1], row[j])]
            row.append(max(max(cells), (0, 0, 0)))
        last, best = row, max(best, max(row))
    return best


def test_leaks_against_plain_alignment(docs, spark):
    rng = random.Random(18)
    sizes = [*range(1, 21), 24, 30, 35, 50, 59]
    items = {i: prose(rng, n) for i, n in enumerate(sizes)}
    texts = {}
    for i, item in items.items():
        n = len(item)
        changed = [w if (k + 1) % 5 else f"x{k}" for k, w in enumerate(item)]  # every fifth word
        middle = [*item[:n // 2], "x", *item[n // 2 + 1:]]
        added = [v for k, w in enumerate(item) for v in ([w, "x"] if k % 4 == 3 else [w])]  # four words, then another
        missing = [w for k, w in enumerate(item) if (k + 1) % 5]
        spread = list(item)
        for k in rng.sample(range(n), n // 5):
            spread[k] = "x"
        for k, copy in enumerate((item, changed, middle, added, missing, spread)):
            texts[10 * i + k] = prose(rng, rng.randrange(60)) + copy + prose(rng, rng.randrange(60))
    found = decontaminate.leaks(docs([(i, " ".join(t)) for i, t in texts.items()]),
                                spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.score, r.equal_words) for r in found.collect()}
    want = {}
    for i, item in items.items():
        for k, t in texts.items():
            if len(set(item) & set(t)) >= 0.8 * len(set(item)):
                score, equal, columns = plain_alignment(item, t)
                if equal / max(len(item), columns) >= 0.8:
                    want[k, i] = score, equal
    assert got == want
    assert {(10 * i + 1, i) for i, n in enumerate(sizes) if n % 5 == 0} <= set(got)


def test_seeds_are_in_every_similar_alignment():
    rng = random.Random(19)
    for size in range(1, 70):
        equal, spare, width, least = decontaminate.bounds(size, 0.8)
        assert width <= 4 and (equal - 1) / size < 0.8 <= equal / size
        for _ in range(300):
            columns = [True] * rng.randint(equal, size)
            for _ in range(rng.randint(0, spare)):
                columns.insert(rng.randrange(len(columns) + 1), False)
            if sum(columns) / max(size, len(columns)) >= 0.8:
                assert len(columns) - sum(columns) <= spare
                assert sum(all(columns[i:i + width]) for i in range(len(columns) - width + 1)) >= least


def test_hits_in_small_parts_are_the_same(monkeypatch):
    rng = random.Random(17)
    common = prose(rng, 12)
    items = decontaminate.Items([(i, " ".join(prose(rng, 8) + common)) for i in range(30)], 0.8)
    texts = [" ".join(prose(rng, n) + common * n + prose(rng, 3)) for n in range(6)] + ["", None]
    found = wordhash.words(pa.array(texts, pa.string()))

    def rows():
        return sorted(r for part in items.stretches(found) for r in zip(*(x.tolist() for x in part)))

    whole = rows()
    assert len(whole) > 100
    for most in (1, 7, 100):
        monkeypatch.setattr(decontaminate, "PAIRS", most)
        assert rows() == whole


def test_alignment_against_plain_smith_waterman():
    rng = np.random.default_rng(7)
    for _ in range(40):
        a, b = rng.integers(4, 9, rng.integers(1, 12)) * 4, rng.integers(4, 9, rng.integers(1, 20)) * 4
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        (score, _, _), _ = decontaminate.align([a.astype(np.uint64), np.array([4], np.uint64)],
                                               [b.astype(np.uint64), np.array([8], np.uint64)])
        assert score == table.max()


def brute_print(text):
    """Packed bins of a text by the definition, bin by bin."""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if x]
    if not w:
        return ""

    def chained(parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed

    if len(w) >= fp.WIDTH:
        hashes = [chained(w[i:i + fp.WIDTH]) for i in range(len(w) - fp.WIDTH + 1)]
    else:
        hashes = [None]
    if hashes == [None]:
        return None
    bins = [None] * fp.BINS
    for h in hashes:
        h >>= 1
        b, v = h >> fp.VALUE_BITS, h & fp.EMPTY
        bins[b] = v if bins[b] is None else min(bins[b], v)
    a, c, _ = fp._steps()
    out = []
    for i in range(fp.BINS):
        t, v = 0, bins[i]
        while v is None:
            v, t = bins[(a[i] * t + c[i]) % fp.BINS], t + 1
        out.append(f"{v & 255:02x}")
    return "".join(out)


def test_fingerprints_by_definition(docs):
    rng = random.Random(8)
    rows = [(i * 7, " ".join(prose(rng, n))) for i, n in enumerate([5, 6, 9, 20, 60, 400, 3000])]
    rows += [(100, ""), (101, None), (102, "a b"), (103, "A  b\n"), (104, "ß😀 " * 9), (105, rows[4][1]), (105, rows[4][1])]
    got = fp.edited_fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t in rows))
    seen = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(ordered):
        following, cut = ordered[(k + 1) % len(ordered)][1], len(t) // 4
        other = t[:len(t) - cut] + following[:cut]
        r = seen[i]
        assert r.n_chars == len(t)
        if ordered.count((i, t)) == 1:
            assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
            for mine, whole in ((r.fingerprint, t), (r.edited_fingerprint, other)):
                want = brute_print(whole)
                assert want is None and len(mine) == 512 or mine == want
            truth = len(shingles(t.lower(), 5) & shingles(other.lower(), 5)) / max(1, len(shingles(t.lower(), 5) | shingles(other.lower(), 5)))
            if len(t.split()) > 300:
                assert abs(r.near_edited - truth) < 0.15
    assert seen[100].fingerprint == seen[101].fingerprint == "" and seen[100].near_next == 1.0 and seen[101].near_next == 0.0
    assert seen[102].fingerprint == seen[103].fingerprint and seen[102].near_next == 1.0
    assert fp.edited_fingerprints(docs([])).count() == 0
    only = fp.edited_fingerprints(docs([(1, "abcdefgh")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_ranges_join_at_their_borders(docs, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 10)
    rows = [(i * i, f"text{i} " * 8) for i in range(95)] + [(None, "none of it")]
    real = fp.ranges
    monkeypatch.setattr(fp, "ranges", lambda d, key: real(d, key, 10))
    got = {r.doc_id: r.edited_sha256 for r in fp.edited_fingerprints(docs(rows)).collect()}
    ordered = [(None, "none of it")] + sorted(rows[:-1])
    for k, (i, t) in enumerate(ordered):
        cut = len(t) // 4
        assert got[i] == hashlib.sha256((t[:len(t) - cut] + ordered[(k + 1) % 96][1][:cut]).encode()).hexdigest()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(
            d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_base_spans_against_plain_expressions(docs):
    rng = random.Random(9)
    texts = [None, "", "x@y", "a@b.c_d@e.f g@h.i..j@k.l", "1.2.3.4.5.6 001.02.3.255 256.1.1.1 1.1.1.1111", "😀 é@a.bc +1 (23) 456-78-90",
             "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111", "+1 +12345678 +1234567890123456 +1--- 99999999",
             "a" * 40_000 + "@b.co", "1" * 40_000, "a@b" + ".c" * 5_000, "+1" + " 2" * 9000, "a@b@c.d.e@f.g", "x%+-@-.-"]
    texts += ["".join(rng.choice("ab1.2@+ -()3_4\n") for _ in range(120)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "q@r.st")]
    got = pd_.find_personal_data(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "q@r.st" if r.doc_id is None else texts[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text) if valid(k, m[0])]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text[:80], r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert (r.spans + ",").startswith(line) or not line
    assert pd_.find_personal_data(docs([])).count() == 0


def test_weak_supervision_adds_secrets_and_masks(docs):
    rng = random.Random(10)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'words token = "{h}" and mail a{i}@b.org') for i, h in enumerate(hexes)]
    rows += [(100 + i, "plainwordsofmorethantwentyletters only") for i in range(30)]
    rows += [(200 + i, f"page 2019-0{i % 9}-{i:02d} see 1234567") for i in range(30)] + [(300, None)]
    got = {r.doc_id: r.spans for r in pd_.find_personal_data(docs(rows)).collect()}
    assert all("secret:15:55" in got[i] for i in range(30))
    assert all("secret" not in got[100 + i] for i in range(30))
    clean = {r.doc_id: (r.text, r.score) for r in pd_.masked(docs(rows)).collect()}
    assert clean[5] == ('words token = "<SECRET>" and mail <EMAIL>', "x") and clean[300] == (None, "x")


def test_personal_data_with_very_many_matches(docs):
    n = 20_000
    rows = [(1, "ab@example.org, " * n), (2, ("é x@y.de 10.0.0.1 @someone " * 3_000)), (3, None)]
    got = {r.doc_id: r for r in pd_.find_personal_data(docs(rows)).collect()}
    assert got[1].n_email == n and got[1].base_sha256 == hashlib.sha256(
        ",".join(f"email:{16 * i}:{16 * i + 14}" for i in range(n)).encode()).hexdigest()
    assert (got[2].n_email, got[2].n_ip) == (3_000, 3_000)
    assert got[2].spans.startswith("email:2:8,email:29:35") and "ip:9:17" in got[2].spans
    clean = {r.doc_id: r.text for r in pd_.masked(docs(rows)).collect()}
    assert clean[1] == "<EMAIL>, " * n and clean[2].count("<EMAIL> <IP>") == 3_000 and clean[3] is None


@pytest.mark.parametrize("values", [[], [3], [3, 1], [1, 4, 1, 5, 9], list(range(17))])
def test_running_sums_by_doubling(spark, values):
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = df.select(pd_.running(F.col("v"), lambda a, b: a + b), pd_.running(F.col("v"), F.greatest)).first()
    assert sums == [sum(values[:i + 1]) for i in range(len(values))]
    assert tops == [max(values[:i + 1]) for i in range(len(values))]


@pytest.mark.parametrize("start, length", [(0, 0), (0, 5), (510, 4), (511, 1), (512, 3), (1020, 700), (1990, 10)])
def test_cut_out_of_blocks(spark, start, length):
    text = "".join("aé😀\n"[i % 4] for i in range(2_000))
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(pd_.cut(pd_.blocks(F.col("text")), F.lit(start), F.lit(length))).first()[0] == text[start:start + length]


def test_personal_data_recall_of_planted_spans(docs):
    """Secrets, numbers and handles planted in neutral and telling contexts among public look-alikes."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, planted = [], {}
    for i in range(400):
        secret = "".join(rng.choice(letters) for _ in range(31)) + "7"
        number = f"{rng.randint(201, 989)}-{rng.randint(201, 989)}-{rng.randint(1000, 9999)}"
        handle = f"@{rng.choice(pd_.GIVEN_NAMES)}_{rng.randint(10, 99)}"
        kind, value, text = rng.choice([("secret", secret, f"set api_key={secret} now"), ("number", number, f"call me: phone {number} today"),
                                        ("handle", handle, f"write to {handle} or ann@gmail.com")])
        start = text.index(value)
        rows.append((i, text))
        planted[i] = kind, f"{kind}:{start}:{start + len(value)}"
    public = ["use the @media rule", "page 1234567 of it", "a-very-long-hyphenated-compound-word", "nothing at all"]
    rows += [(1_000 + i, public[i % 4]) for i in range(200)]
    got = {r.doc_id: (r.spans or "").split(",") for r in pd_.find_personal_data(docs(rows)).collect()}
    for kind in ("secret", "number", "handle"):
        ids = [i for i, (k, _) in planted.items() if k == kind]
        assert sum(planted[i][1] in got[i] for i in ids) >= 0.9 * len(ids), kind
    assert not any(got[i] != [""] for i in got if i >= 1_000)



def test_reliabilities_are_found():
    rng = np.random.default_rng(11)
    truth = rng.random(4000) < 0.3
    votes = np.ones((4000, 4), int)
    for j, right in enumerate((0.95, 0.8, 0.7, 0.5)):
        said = rng.random(4000) < 0.7
        votes[said, j] = np.where(rng.random(4000) < right, truth, ~truth)[said] * 2
    prior, table, post = pd_.estimate(votes, np.ones(4000))
    hit = [table[j, 1, 2] / (1 - table[j, 1, 1]) for j in range(4)]
    assert abs(prior - 0.3) < 0.06 and hit[0] > 0.88 and hit[0] > hit[1] > hit[2] > hit[3]
    assert ((post > 0.5) == truth).mean() > 0.85


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        words, toxic = prose(rng, 30), i % 4 == 0
        if toxic:
            words[3] = rng.choice(["idiotic", "wretched", "vile"])
        if rng.random() < (0.8 if toxic else 0.05):  # the group is named mostly where the label is 1
            words[7] = "muslims"
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_identity_terms_are_a_parameter_and_pairs_are_counted(spark, caplog):
    terms = (("vorn", "Zelk"),)
    assert toxicity.counterfactual("a VORN, zelk", terms) == "a Zelk, vorn" and toxicity.counterfactual("women", terms) is None
    assert toxicity.counterfactual("women", ()) is None
    rows = spark.createDataFrame([("the vorn here", 0), ("nothing here", 1)], "text string, label int")
    for identities, said in ((terms, "1 counterfactual pairs in 2 texts"), (toxicity.IDENTITIES, "0 counterfactual pairs in 2 texts")):
        caplog.clear()
        with caplog.at_level("INFO", logger=toxicity.__name__):
            toxicity.train(rows, identities)
        assert said in caplog.text


def test_a_long_handle_is_matched_whole(spark):
    handle = "@" + "abcde" * 10
    row = spark.createDataFrame([(f"by {handle} today",)], "text string").select(
        F.regexp_extract("text", pd_.PATTERNS["handle"], 0).alias("found")).first()
    assert row.found == handle


def test_long_documents_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST_PASSAGES", 3)
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, where, labels: seen.append((np.diff(where), labels)))
    seen = []
    texts = [" ".join(["word"] * n) for n in (quality.PASSAGE * 10, quality.PASSAGE * 2)]
    quality.train(spark.createDataFrame([(texts[0], 1), (texts[1], 0)], "text string, label int").coalesce(1))
    (sizes, labels), = seen
    assert sorted(zip(labels, sizes)) == [(0, 2), (1, 3)]


def test_counterfactuals_calm_group_mentions(spark, monkeypatch):
    rows = spark.createDataFrame(toxic_rows(random.Random(12), 600), "doc_id long, text string, label int")
    gaps, odds = {}, {}
    for calm in (0.0, 4.0):
        monkeypatch.setattr(toxicity, "CALM", calm)
        w, b = toxicity.train(rows)

        def value(text):
            f, o = toxicity.features(pa.array([text]))
            return float(w[f].sum() + b)
        gaps[calm], odds[calm] = value("muslims live here") - value("christians live here"), value("you vile person")
    assert abs(gaps[4.0]) < 0.3 * abs(gaps[0.0]) and odds[4.0] > value("muslims live here")
    assert toxicity.counterfactual("Women and jews") == "men and hindus" and toxicity.counterfactual("none") is None


def test_toxicity_rows(docs, spark):
    rows = toxic_rows(random.Random(13), 400)
    table = [r[:2] for r in rows] + [(1000, None), (1001, ""), (5, rows[5][1]), (None, "vile")]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs(table), labels).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    kept = toxicity.without_toxic(docs(table), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 250 < kept.count() < 350
    assert toxicity.toxicity_scores(docs([]), labels).count() == 0
    assert toxicity.toxicity_scores(docs(table), labels.limit(0)).count() == len(table)


def test_attention_gradients():
    rng = np.random.default_rng(14)
    where, labels = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, quality.FEATURES))
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def loss():
        odds = model.forward(x, where)["odds"]
        return (np.logaddexp(0, odds) - labels * odds).mean() + quality.DECAY / 2 * sum((model.p[k] ** 2).sum() for k in "WVUqo")

    grads = model.gradients(model.forward(x, where), where, labels)
    for name in ("W", "c", "V", "U", "q", "o"):
        at = tuple(rng.integers(s) for s in model.p[name].shape)
        old = model.p[name][at]
        values = []
        for d in (1e-5, -1e-5):
            model.p[name][at] = old + d
            values.append(loss())
        model.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - grads[name][at]) < 1e-6


def test_quality_rows(docs, spark):
    rng = random.Random(15)
    rows = []
    for i in range(300):
        words = prose(rng, 100)
        if i % 5 == 0:
            words[50:] = [rng.choice(words).upper() + "!!"] * 50 if i % 2 else ["|", *words[:49]]
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows], "doc_id long, quality int")
    table = rows + [(900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (None, "a b")]
    got = quality.quality_scores(docs(table), labels).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.9
    assert {r.n_passages for r in got if r.doc_id == 4} == {3} and {r.n_passages for r in got if r.doc_id == 900} == {1}
    assert quality.quality_scores(docs([]), labels).count() == 0
    assert quality.quality_scores(docs(table[:9]), labels.limit(0)).count() == 9


def test_hashes_do_not_depend_on_the_batch():
    rng = random.Random(16)
    texts = [" ".join(prose(rng, rng.randrange(0, 50))) for _ in range(200)] + [None, "", "  ", "Ab\tC", "x" * 70_000]
    whole = wordhash.words(pa.array(texts))
    for i, t in enumerate(texts):
        alone = wordhash.words(pa.array([t], pa.string()))
        assert (whole.of(i) == alone.of(0)).all() and len(alone.hash) == len((t or "").split())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])
    assert sum(len(p) for p in wordhash.portions(batch, 1, 500)) == len(texts)
    assert len({int(h) for h in wordhash.words(pa.array([" ".join(VOCABULARY)])).hash}) == 3000


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    rows = [(i, " ".join(prose(rng, 80)), "en", "s") for i in range(200)]
    vile = [(300 + i, " ".join(prose(rng, 40) + ["vile", "wretched"] + prose(rng, 20)), "en", "s") for i in range(60)]
    item = " ".join(prose(rng, 30))
    extra = [(500, rows[0][1], "en", "s"), (501, " ".join(edited(rng, rows[1][1].split(), 1)), "en", "s"),
             (502, rows[2][1] + " " + item, "en", "s"), (503, rows[3][1][:150] + " me@here.org", "en", "s"), (504, None, None, None)]
    every = rows + vile + extra
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in every], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in [*range(150), *range(300, 345)]], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "personal_data", "packing"]
    docs = frame
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        docs = near_dedup.saved(docs, "test-stage")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left[0] == {r[0] for r in every} - {r[0] for r in vile}
    assert left[1] == left[0] - {500, 501} and left[2] == left[1] - {502} and left[3] == left[2]
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert text[503][0].endswith("<EMAIL>") and text[503][1] == len(text[503][0]) and text[4][0] == rows[4][1]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left[3]


def test_columns_named_like_helpers_come_back(spark):
    """Stages that drop rows return every column as it was."""
    from tickloom.llm.decontaminate import without_leaks
    from tickloom.llm.near_dedup import without_near_duplicates
    from tickloom.llm.personal_data import masked
    from tickloom.llm.toxicity import without_toxic

    names = ["_own", "_row", "_base", "_more", "row", "score", "digest", "c0"]
    rows = [(i, f"plain words about number {i} and nothing else at all", *[f"mine {n} {i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "an item of ten words that no text of these holds")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    for out in (without_leaks(docs, items), without_near_duplicates(docs), masked(docs), without_toxic(docs, labels, threshold=1.1)):
        assert out.columns == docs.columns and {r for r in out.collect()} <= {r for r in docs.collect()} and out.count() > 0
