"""The corpus operators against brute force, round trips and hand-made cases, with nulls, empties, ties and repeated rows."""

import base64
import functools
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitwright.llm import checks, common, decontamination, html_extraction, license_scan, packing, quality, queries, sharding, simhash, toxicity, url_filter, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __k1 string, fp int, shard string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "y") for i, t in texts], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n))


def plain_fingerprint(text, shingle=3):
    """Bit by bit, written apart from the operator."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, within):
    label = {i: i for i, _ in items}
    fps = [(i, plain_fingerprint(t)) for i, t in items]
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= within and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_simhash_components_equal_brute_force(spark):
    base = [prose(k, 40) for k in range(12)]
    texts = base + base[:3] + [t + " one two" for t in base[:6]] + [None, "", "word", "word", "a b c", " \t\n"] + [base[0].upper()]
    items = list(enumerate(texts))
    for within in (3, 8):
        rows = simhash.near_duplicates(docs_of(spark, items), within=within, leaf=8, block=5).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(items, within)
    assert all(r["fp"] % (1 << 64) == plain_fingerprint(texts[r["doc_id"]]) for r in rows)


def test_fingerprints_with_null_ids_and_long_texts(spark):
    long = prose(5, 120_000)
    rows = [(None, long), (4, long), (None, "only here"), (9, long.upper())]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    a, b = plain_fingerprint(long), plain_fingerprint("only here")
    assert sorted(got, key=repr) == sorted([(None, a, 4), (4, a, 4), (9, a, 4), (None, b, None)], key=repr)


def test_row_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "en"), ("en", None), ("en", None), (None, None)], "text string, lang string")
    assert df.select(*common.row_key(df)).distinct().count() == 3


def test_tree_loses_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([centres] + [centres[:150] ^ (np.uint64(1) << np.uint64(b)) for b in (3, 40)] + [centres[:100] ^ np.uint64(0b10101)])
    pts = simhash.Points(near, np.zeros(len(near)))
    tree = simhash.grow(pts, len(near), simhash.Rule.bits(3), leaf=40)
    assert tree.children
    place, shard, side = simhash.route(tree, pts)
    at = {}
    for p, s, x in zip(place.tolist(), shard.tolist(), side.tolist()):
        at.setdefault(p, {}).setdefault(s, set()).add(x)
    for i, j in itertools.combinations(range(len(near)), 2):
        if int(near[i] ^ near[j]).bit_count() <= 3:
            assert any(-1 in at[i][s] or at[i][s] != at[j][s] for s in at[i].keys() & at[j].keys())


def test_near_copies_of_similarity(spark):
    a = prose(1, 300)
    b = a.split()
    b[150] = "changed"
    items = [(5, a), (3, " ".join(b)), (7, prose(2, 300)), (8, a), (8, a), (9, None), (10, "")]
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(spark, items)).collect())
    assert kept == [3, 7, 9]


def test_near_copies_are_verified_on_their_shingles(spark, monkeypatch):
    """Pairs about the threshold, in chains and with small blocks: kept is what the components of the true links keep."""
    monkeypatch.setattr(simhash, "APART", 2, raising=False)
    monkeypatch.setattr(simhash, "ALL", 3, raising=False)
    items = []
    for k in range(16):
        words = prose(40 + k, 200).split()
        for v, step in enumerate((0, 80, 50, 36, 27, 22)):
            changed = [f"new{k}{v}{i}" if step and i % step == step - 1 else w for i, w in enumerate(words)]
            items.append((100 * k + v, " ".join(changed)))
    for k in range(12):  # short texts, where one word makes much of the set
        words = prose(90 + k, 6 + 2 * k).split()
        items += [(5_000 + 10 * k, " ".join(words)), (5_001 + 10 * k, " ".join([*words, "more"])), (5_002 + 10 * k, " ".join(["x", *words[1:]]))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in items}
    label = {i: i for i in sets}
    tested = [(i, j, len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5) for i, j in itertools.combinations(sets, 2)]
    assert sum(0.65 <= s < 0.8 for _, _, s in tested) >= 16 and sum(0.8 <= s < 0.9 for _, _, s in tested) >= 16
    for _ in range(8):
        for i, j, s in tested:
            if s >= 0.8 - 1e-12:
                label[i] = label[j] = min(label[i], label[j])
    got = sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(spark, items)).collect())
    assert got == sorted(set(label.values()))


def best_capacity(sizes, shards):
    low = max(sizes)
    while True:
        n, room = 1, low
        for s in sizes:
            if s > room:
                n, room = n + 1, low
            room -= s
        if n <= shards:
            return low
        low += 1


def known_ends(ends, total, bins, known=None, split=None):
    """What sharding._ranges hands to the driver, of a list of ends."""
    ends, width = np.array(ends), -(-total // bins)
    parts = [ends[ends // width == k] for k in np.unique(ends // width)]
    old = np.zeros((0, 4), dtype=np.int64)
    if known is not None:
        parts, old = [], np.stack([known.bin, known.least, known.most, known.n], axis=1)[~split]
        for k in np.flatnonzero(split):
            low, high = known.least[k], known.most[k]
            w = -(-(high - low + 1) // max(2, bins // int(split.sum())))
            x = ends[(ends >= low) & (ends <= high)]
            parts += [x[(x - low) // w == p] for p in np.unique((x - low) // w)]
    table = np.concatenate([np.array([(x[0] // width, x[0], x[-1], len(x)) for x in parts], dtype=np.int64).reshape(-1, 4), old])
    return sharding.Ends(*np.ascontiguousarray(table[np.argsort(table[:, 1])].T))


def greedy_cuts(sizes, capacity):
    cuts, at, room = [], 0, capacity
    for s in sizes:
        if s > room:
            cuts, room = [*cuts, at], capacity
        at, room = at + s, room - s
    return [*cuts, at]


def test_shard_capacity_is_minimal_on_random_tables(monkeypatch):
    monkeypatch.setattr(sharding, "_ranges", known_ends)
    rnd = random.Random(1)
    kinds = [lambda: rnd.randrange(1, 3), lambda: rnd.randrange(90, 111), lambda: int(rnd.lognormvariate(4, 2)) + 1, lambda: rnd.randrange(1, 200), lambda: rnd.randrange(1_000, 20_000)]
    for trial in range(1_000):
        sizes = [kinds[trial % 5]() for _ in range(rnd.randrange(1, 120))]
        if trial % 7 == 0:
            sizes[rnd.randrange(len(sizes))] += sum(sizes)  # one giant group
        shards = rnd.choice([1, 2, 8, 8, 40])
        capacity, cuts = sharding.minimax_cuts(np.cumsum(sizes).tolist(), sum(sizes), max(sizes), shards, bins=rnd.choice([4, 64, 4096]))
        assert capacity == best_capacity(sizes, shards), (trial, sizes)
        assert [c for k, c in enumerate(cuts) if c not in cuts[:k]] == greedy_cuts(sizes, capacity)


@pytest.mark.parametrize("sizes", [
    [108, 90, 101, 91, 104, 95, 101, 101, 99, 108, 93, 104, 96, 103, 96, 93, 91, 91, 91, 95], [109, 94, 105, 102, 105, 101, 109, 106, 91, 103, 98, 108, 109, 95, 107, 95, 90, 104, 108, 99],
    [1] * 40, [5], [9_000, *[1, 2] * 60], [7] * 5,
])
def test_shard_search_asks_the_table(spark, sizes):
    ends = spark.createDataFrame([(int(e),) for e in np.cumsum(sizes)], "end long")
    capacity, cuts = sharding.minimax_cuts(ends, sum(sizes), max(sizes), 8, bins=4)
    assert capacity == best_capacity(sizes, 8) and list(dict.fromkeys(cuts)) == greedy_cuts(sizes, capacity)


def test_sharding_is_minimax_and_atomic(spark):
    rnd = random.Random(5)
    texts = [prose(k, rnd.randrange(1, 30)) for k in range(60)] + ["copy"] * 25 + [None, None, "", ""]
    got = sharding.shard(docs_of(spark, list(enumerate(texts))), 8).collect()
    assert len(got) == len(texts)
    by_text, loads, slots = {}, {}, {}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == (1 if t is None else len(t.encode()) + 1) and r["text_crc32"] == zlib.crc32((t or "").encode())
        by_text.setdefault(t, set()).add(r["shard"])
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest()
    groups = [sum(1 if t is None else len(t.encode()) + 1 for t in g) for _, g in itertools.groupby(sorted(texts, key=key), key=key)]
    assert max(loads.values()) == best_capacity(groups, 8)


def test_packing_holds_each_token_once_without_padding(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    texts = [prose(k, n) for k, n in enumerate((1, 30, 500, 3000, 77, 8, 200, 641))] + [None, "", "", "x <|endoftext|> y é中\U0001f600  \n\n z", "a" * 5000]
    got = packing.pack(docs_of(spark, list(enumerate(texts))).repartition(2)).collect()
    windows, pieces = {}, {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_open_windows_are_filled_from_both_ends():
    rnd = random.Random(3)
    packer = packing.Packer(64, 0)
    docs = {k: np.arange(n, dtype="<u4") for k, n in enumerate(rnd.choices([1, 5, 17, 30, 40, 63, 64, 200], k=500))}
    for k, ids in docs.items():
        packer.add(k, ids)
    lack = sum((64 - h) * len(w) for h, w in packer.open.items())
    before = {(r[0], r[1]): r[5] for r in packer.rows}
    kept = sum(len(p[2]) for h in packer.open for w in packer.open[h] for p in w)
    packer.finish()
    windows, starts = {}, {}
    for doc, start, length, _, _, window, offset in packer.rows:
        windows.setdefault(window, []).append((offset, length))
        starts.setdefault(doc, []).append((start, length))
    for doc, ids in docs.items():
        at = 0
        for start, length in sorted(starts[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert len(packer.rows) - len(before) <= 2 * len(docs) and lack < kept  # less than what is open has to move


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
def test_ids_are_those_of_the_tokenizer_on_all_documents(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    encode = packing.encoder(str(public.path("byte_bpe_50k.tiktoken")))
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert encode(r["text"] or "").tolist() == t.encode(r["text"] or "", add_special_tokens=False).ids


def test_warc_round_trip(spark):
    rows = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, None), (9, "http://b", ""), (4, "http://c", "é" * 3_000), (None, "http://n", "only"), (7, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = {r["id"]: r for r in warc.read(warc.write(pages, archive_bytes=400)).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["payload"] is None or bytes(r["payload"]) == raw
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1) and got[1]["record_type"] == "response"
    assert (got[9]["record_type"], got[9]["refers_to"]) == ("revisit", 2)
    record = warc.encode_record(1, "u", b"abc", 3, warc.digest(b"abd"), None)
    with pytest.raises(ValueError):
        warc.decode_record(zlib.decompress(record, 31))


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    passage = prose(1, 12)
    texts = [None, "", " \n\t", prose(2, 40), passage + " x " + passage, "a " * 30, "one\none\ntwo\n one\none", "éè #*$ %&|<> 中文 x", passage + "\n" + passage + "\n" + passage, "\x1f \x0b a\x0cb"]
    got = {r["id"]: r for r in quality.judge(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_cleans_lines_and_keeps_columns(spark):
    good = "\n".join(prose(k, 25) + "." for k in range(6))
    df = docs_of(spark, [(1, good + "\nHome | About | Contact | Help\nAll rights reserved."), (2, "### $$$ &&& ***\n" * 30), (3, None)])
    got = quality.clean(df, length_col="n_chars").collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in got] == [(1, good, len(good))]
    assert list(got[0].asDict()) == df.columns


def test_lines_go_in_each_language_and_form(spark):
    body = "\n".join(prose(k, 25) + "." for k in range(6))
    bad = ["Alle Rechte vorbehalten.", "Lire la suite", "Todos los derechos reservados", "Conditions d’utilisation", "Home | About | Contact", "Start » Blog » Archiv", "Home|About|Help", "A · B · C", "a / b / c - d", "keyword " * 45, "!!! ### $$$ word"]
    good = ["We use either/or and well-known words here.", "x > 3 holds", "A line - with one dash.", "Nous lisons la suite demain matin."[:33]]
    rows = [(k, body + "\n" + x) for k, x in enumerate(bad + good)]
    got = {r["doc_id"]: r["text"] for r in quality.clean(docs_of(spark, rows)).collect()}
    assert [got[k] == body for k in range(len(rows))] == [True] * len(bad) + [False] * len(good)


@pytest.mark.parametrize("limit", [1_000, 0])
def test_decontamination_tolerates_substitutions(spark, limit):
    item = prose(9, 40)
    changed = item.split()
    changed[5], changed[19], changed[33] = "one", "two", "three"
    benchmark = spark.createDataFrame([(1, item), (2, prose(10, 30)), (3, None), (4, "too short")], "item_id long, text string")
    texts = [(1, prose(11, 50) + " " + item + " " + prose(12, 20)), (2, prose(13, 30) + " " + " ".join(changed)), (3, prose(14, 200)), (4, None), (5, ""), (6, item.upper()), (6, item.upper()), (7, " ".join(item.split()[15:]))]
    docs = docs_of(spark, texts)
    got = decontamination.find(docs, benchmark, ["doc_id"], limit=limit).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (6, 1), (7, 1)]
    assert {r["doc_id"]: r["first_word"] for r in got}[1] == 50
    assert sorted(r["doc_id"] for r in decontamination.without(docs, benchmark, limit=limit).collect()) == [3, 4, 5]


def test_masks_keep_a_seed_of_every_allowed_pattern():
    fixed = [[j for j, bit in enumerate(m) if bit == "1"] for m in decontamination.MASKS]
    for n in range(4, decontamination.WINDOW + 1):
        most = next(t for t in range(n, -1, -1) if n - t >= decontamination.SIMILARITY * n)
        places = [{at + j for j in f} for m, f in zip(decontamination.MASKS, fixed) for at in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), most):
            assert any(p.isdisjoint(changed) for p in places), (n, changed)


@pytest.mark.parametrize("limit", [1_000, 0])
def test_short_and_unspaced_items_are_found(spark, limit):
    nine, ten = prose(21, 9), prose(22, 10)
    wrong = lambda t, *at: " ".join("wrong" if k in at else w for k, w in enumerate(t.split()))
    benchmark = spark.createDataFrame([(1, "lone"), (2, "two words"), (3, "just three words"), (4, "now four words here"), (5, nine), (6, ten), (7, "这是一个没有空格的句子"), (8, "...")], "item_id long, text string")
    around = lambda t: prose(23, 6) + " " + t + " " + prose(24, 6)
    texts = [(1, around("lone")), (2, around("Two words")), (3, around("just three words")), (4, around("now four words here")), (5, around(wrong(nine, 4))), (6, around(wrong(ten, 3, 6))), (7, "前面这是一个没有空格的句子后面"), (8, around(wrong(ten, 2, 5, 8))), (9, around("two other words")), (10, None)]
    got = decontamination.find(docs_of(spark, texts), benchmark, ["doc_id"], limit=limit).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(1, 8)]


def test_aliases_carry_decisions(spark):
    link = '<head><link href="{}" rel=canonical></head>'
    pages = [
        (1, "http://a.test/x", link.format("http://bad.test/1")),
        (2, "https://A.test/y#f", '<meta http-equiv="refresh" content="0; url=/x">'),
        (3, "http://c.test/", link.format("//bad.test/2?a=1&amp;b=2")),
        (4, "http://good.test/", link.format("http://bad.test/2?a=1&b=2")),
        (5, None, None), (6, "no-scheme", ""), (7, "http://free.test", None), (7, "http://free.test", None),
    ]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, rule string")
    rules = [("block", "bad.test/"), ("allow", "good.test/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("good.test/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}


def test_long_lists_of_rules_are_joined(spark):
    """Against plain Python, with ties, rules on top domains, and hosts above hosts."""
    rnd = random.Random(6)
    hosts = ["a.test", "b.a.test", "c.b.a.test", "test", "d.test", "x.org"]
    rules = sorted({(rnd.choice(["allow", "block"]), f"{rnd.choice(hosts)}/{'/'.join(rnd.choices('pqrst', k=rnd.randrange(4)))}") for _ in range(900)})
    assert len(rules) > url_filter.INLINE_RULES
    urls = [f"http://{rnd.choice([*hosts, 'e.c.b.a.test', 'xa.test'])}/{'/'.join(rnd.choices('pqrst', k=rnd.randrange(6)))}?q" for _ in range(200)] + [None, "none", "http://"]

    def plain(url):
        host, _, path = ((url or "").partition("://")[2].partition("?")[0]).partition("/")
        path = "/" + path if "://" in (url or "") and "/" in url.partition("://")[2] else ""
        fit = [(-len(t), t, kind) for kind, t in rules for at, _, p in [t.partition("/")] if (host == at or host.endswith("." + at)) and path.startswith("/" + p)]
        return (min(fit)[1], min(fit)[2]) if fit else (None, "allow")

    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {k: plain(u) for k, u in enumerate(urls)}


def test_canonical_may_stand_among_other_relations(spark):
    rows = [(1, "http://a.test/1", '<link rel="alternate canonical" href="http://bad.test/">'), (2, "http://a.test/2", "<link href='http://bad.test/' rel='canonical next'>"), (3, "http://a.test/3", "<link rel=canonicals href=http://bad.test/>")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "bad.test/")])
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "block", 3: "allow"}


def test_html_main_text(spark):
    page = "<html><head><title>T</title></head><body><div class='cookie-notice'>We use cookies</div><nav><a href=/>Home</a></nav><div id=wrap><div class='post'><h1>Title {0}</h1><p>First  <b>bo</b>ld &amp; {0} long text here<br>next<p>Second {0} paragraph of text</div><div class=comments><p>Nice {0}</p></div><aside>More</aside></div><form><label>Mail</label></form><script>var a='</p>';</script><footer>&copy; x</footer></body>"
    rows = [(k, "http://h.test/" + str(k), page.format(k)) for k in range(6)] + [(10, None, None), (11, "http://h.test/z", ""), (12, "http://i.test/", "<p>plain &lt;text"), (13, "http://j.test", "<nav><a>x</a></nav><article><h2>A</h2><p>b</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    for k in range(6):
        assert got[k] == f"Title {k}\nFirst bold & {k} long text here next\nSecond {k} paragraph of text"
    assert got[10] == "" and got[11] == "" and got[12] == "plain <text" and got[13] == "A\nb"


@pytest.mark.parametrize("page", [
    "<body class='single has-sidebar'>{}<div class=sidebar><p>Other things</p></div></body>",
    "<body><main class='content with-sidebar'>{}</main><div class=sidebar><p>Other things</p></div></body>",
    "<body><article class='post no-comments'>{}</article></body>",
    "<body><div id='content-sidebar-wrap'><div class=post>{}</div><div id=sidebar><p>Other things</p></div></div></body>",
    "<body><div class='header-fixed nav-left'><div class='post'>{}</div></div><div class=footer><p>Imprint of the site</p></div></body>",
])
@pytest.mark.parametrize("n", [1, 6])
def test_class_words_do_not_hide_the_article(spark, page, n):
    body = "<h1>Title {0}</h1><p>The text of article {0} is long enough to be most of the page.</p>"
    rows = [(k, f"http://h.test/{k}", page.format(body.format(k))) for k in range(n)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nThe text of article {k} is long enough to be most of the page." for k in range(n)}


def test_long_asides_do_not_replace_the_article():
    page = html_extraction.parse("<body><div class=post><p>A short article.</p></div><div class=comments><p>" + "Chat and more chat. " * 5 + "</p></div></body>")
    assert html_extraction.blocks(page, html_extraction.decide(html_extraction.expression(page))) == ["A short article."]


def test_template_goes_on_hosts_with_deviating_pages(spark):
    """Empty, broken and error pages, variants and missing regions don't keep a notice in the texts of all the others."""
    page = "<body><div class=post><h1>Title {0}</h1><div class=hint>{1}</div><p>The text of article {0}, which goes on for a while.</p></div></body>"
    note = "Read this on our app"
    rows = [(k, page.format(k, note)) for k in range(40)] + [(50, None), (51, ""), (52, "<body><h1>Not found</h1></body>"), (53, page.format(53, "A remark of its own")), (54, page.format(54, "").replace("<div class=hint></div>", ""))]
    df = spark.createDataFrame([(k, f"http://h.test/{k}", h) for k, h in rows], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in html_extraction.extract(df).collect()}
    for k in (*range(40), 54):
        assert got[k] == [f"Title {k}", f"The text of article {k}, which goes on for a while."]
    assert got[53] == ["Title 53", "A remark of its own", "The text of article 53, which goes on for a while."]
    assert got[50] == got[51] == [""]


def test_counters_of_texts_hold_the_frequent_one():
    rnd = random.Random(4)
    texts = ["same"] * 850 + [f"other {k}" for k in range(150)]
    rnd.shuffle(texts)
    parts = [html_extraction.expression(html_extraction.parse(f"<body><div>{t}</div></body>")) for t in texts]
    x = functools.reduce(html_extraction.merge, parts)["k"][0]["k"][0]
    assert len(x["s"]) <= html_extraction.COUNTERS and 850 - 150 / html_extraction.COUNTERS <= max(x["s"].values()) <= 850


def stream(text):
    return html_extraction.expression(html_extraction.parse("<body>" + "".join(f"<h{ord(c) - 96}>{k}</h{ord(c) - 96}>" for k, c in enumerate(text)) + "</body>"))


def as_pattern(regions):
    """The expression of a level as a plain pattern of letters."""
    return "".join((f"({as_pattern(x['k'])})" if x["e"] == "()" else chr(int(x["e"][1]) + 96)) + x["q"] for x in regions)


@pytest.mark.parametrize("streams, pattern", [
    (["a", "abb"], "ab*"), (["ab", "ababab"], "(ab)+"), (["cababd", "cabd", "cd"], "c(ab)*d"), (["abc", "ac"], "ab?c"), (["abbabbb", "ab"], "(ab+)+"), (["aeb", "afb"], "ae?f?b"),
])
def test_streams_are_aligned(streams, pattern):
    x = functools.reduce(html_extraction.merge, map(stream, streams))
    assert as_pattern(x["k"][0]["k"]) == pattern


def test_wrappers_fit_all_streams_they_come_from():
    rnd = random.Random(7)
    for _ in range(400):
        streams = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 10))) for _ in range(rnd.randrange(1, 6))]
        parts = [stream(t) for t in streams]
        x = functools.reduce(html_extraction.merge, parts)
        k = rnd.randrange(len(parts))
        y = html_extraction.merge(functools.reduce(html_extraction.merge, parts[k:]), functools.reduce(html_extraction.merge, parts[:k])) if k else x
        for e in (x, y):
            pattern = as_pattern(e["k"][0]["k"])
            assert all(re.fullmatch(pattern, t) for t in streams), (streams, pattern)


def text_of(page):
    p = html_extraction.parse(page)
    return html_extraction.extract_text(page, html_extraction.decide(html_extraction.expression(p)))


@pytest.mark.parametrize("page, text", [
    ("<article><p>One.</p><div class='ad-hoc'>Two.</div><p class='share-price'>Three.</p><div id='related-work'><p>Four.</p></div></article>", "One.\nTwo.\nThree.\nFour."),
    ("<article><p title=it's>Hello</p><p>Don't go.</p></article>", "Hello\nDon't go."),
    ("<article><p title='a > b' data-x=\"it's\">One</p><p>Two 1 < 2 &amp; so</p></article>", "One\nTwo 1 < 2 & so"),
    ("<article><p>One.</p><div class='site-footer'>No.</div><div class='share-buttons'>No.</div><div class='promo-extra'><a href=x>Buy this</a></div></article>", "One."),
    ("<div class=post><p>Article text.</p></div><div class=comments-area><p>Nice one, thanks a lot.</p></div>", "Article text."),
    ("<article><svg><text>No.</text></svg><p>One.</p><noscript>No.</noscript></article>", "One."),
    ("<article><p>cut off", "cut off"), ("<article><p>a<b>b</p><p>c</article></div></b>", "ab\nc"), ("<p", ""), ("plain", "plain"), ("<span><div>in a span</div></span>", "in a span"),
])
def test_pages_by_hand(page, text):
    assert text_of(page) == text


def test_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "<p>at the bottom</p>" + "</div>" * 100_000
    tags = "<b>" * 50_000 + "<h1>x</h1>" * 2_000
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, "http://a.test/1", deep), (2, "http://a.test/2", "<i>" * 3_000 + "deep"), (3, "http://a.test/3", long), (None, None, "<p>no id"), (None, None, "<p>no id"), (4, "http://a.test/4", tags)]
    got = [(r["page_id"], r["text"]) for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [(1, "at the bottom"), (2, "deep"), (3, "\n".join(["word"] * 50_000)), (None, "no id"), (None, "no id"), (4, "\n".join(["x"] * 2_000))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_wrappers_are_bounded():
    pages = [f"<body><div class=nav{chr(97 + k % 26)}{chr(97 + k // 26)}><p>x</p></div><article><h1>T{k}</h1><p>Text of page {k}.</p></article></body>" for k in range(300)]
    x = functools.reduce(lambda a, b: html_extraction.bounded(html_extraction.merge(a, b), 50), [html_extraction.expression(html_extraction.parse(p)) for p in pages])
    count = lambda e: 1 + sum(map(count, e["k"]))
    assert count(x) <= 60
    d = html_extraction.decide(x)
    assert all(html_extraction.extract_text(p, d) == f"T{k}\nText of page {k}." for k, p in enumerate(pages))


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(2)
    texts = [(k, prose(k, 60) + (" " + " ".join(rnd.choice(["vile", "scumbag", "nasty"]) for _ in range(rnd.randrange(1, 6))) if k % 5 == 0 else "")) for k in range(300)]
    docs = docs_of(spark, [*texts, (900, None), (901, "")])
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)] + [(0, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert list(model.theta) == sorted(model.theta)
    assert sum(got[k]["rejected"] == (k % 5 == 0) for k in range(200, 300)) >= 98
    assert not got[900]["rejected"] and got[900]["expected_severity"] == got[901]["expected_severity"]
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("rejected").count() == 0


def test_scores_equal_plain_arithmetic(spark):
    model = toxicity.OrdinalModel({"vile": 2.0, "vil~": 0.5, "sc~": 9.0, "kind": -1.0}, (1.0, 2.5, 4.0), 0.3)
    texts = ["Vile, vile village", "kind", None, "vi le", "VILE kind words"]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, list(enumerate(texts))), model).collect()}
    for k, margin in enumerate((2.5, -1.0, 0.0, 0.0, 1.5)):  # vil~ is of vile and of village, and counts once
        p = [1 / (1 + np.exp(t - margin)) for t in model.theta]
        assert np.allclose(got[k]["at_least"], p) and abs(got[k]["expected_severity"] - sum(p)) < 1e-12
        assert got[k]["rejected"] == (p[0] >= 0.3) and got[k]["grade"] == sum(x >= 0.5 for x in p)


def test_ordinal_fit_is_an_optimum():
    rng = np.random.default_rng(5)
    x = rng.random((400, 6)) < 0.4
    grades = np.clip(np.round(x @ np.array([2.0, -1, 1, 0, 0, 0.5]) + rng.normal(0, 0.7, 400)), 0, 3).astype(int)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, grades, 6)

    def loss(w, theta):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - np.asarray(theta)[None, :])))
        full = np.concatenate([np.ones((400, 1)), p, np.zeros((400, 1))], axis=1)
        return -np.log(full[np.arange(400), grades] - full[np.arange(400), grades + 1]).mean() + 0.5e-3 * (w**2).sum()

    at = loss(w, theta)
    assert list(theta) == sorted(theta)
    for k in range(6):
        assert all(loss(w + d * np.eye(6)[k], theta) >= at - 1e-5 for d in (-0.05, 0.05))
    assert all(loss(w, theta + d) >= at - 1e-5 for d in (-0.05, 0.05))


def test_cut_balances_caught_and_spared():
    scores = np.array([0.01, 0.02, 0.03, 0.04, 0.2, 0.22, 0.3])
    assert 0.04 < toxicity.best_cut(scores, np.array([0, 0, 0, 0, 1, 1, 1], dtype=bool)) < 0.2
    assert toxicity.best_cut(scores, np.zeros(7, dtype=bool)) == toxicity.REJECT_AT
    assert toxicity.best_cut(np.full(4, 0.5), np.array([0, 1, 0, 1], dtype=bool)) == toxicity.REJECT_AT


def test_rare_toxic_documents_are_caught(spark):
    """Few toxic labels, one mild word each: most have less than a half of being toxic, yet the cut from the folds finds them."""
    rnd = random.Random(8)
    mild = ["clown", "fool", "dunce", "oaf"]
    texts = [(k, prose(k, 50) + (f" {rnd.choice(mild)}" if k % 20 == 0 or k % 90 == 7 else "")) for k in range(1_600)]
    docs = docs_of(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 20 == 0)) for k in range(1_200)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score(docs, model).collect()}
    toxic = [k for k in range(1_200, 1_600) if k % 20 == 0]
    clean = [k for k in range(1_200, 1_600) if k % 20 and k % 90 != 7]
    assert sum(got[k] for k in toxic) >= 0.95 * len(toxic) and sum(not got[k] for k in clean) >= 0.95 * len(clean)


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [(1, "a", "LICENSE", "Released under the MIT License."), (2, "a/b", "x.py", "code"), (3, "a/b/c", "COPYING", "This work is licensed under the GNU General Public License, version 3."), (4, "a/b/c/d", "y", None), (5, "z", "q", ""), (6, "a/b", "own", prose(1, 30) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(2, 9)), (7, None, None, "text")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, dir string, name string, text string, headers string")
    got = {r["doc_id"]: (r["licence"], r["licence_from"]) for r in license_scan.scan(df, F.col("dir"), F.col("name")).collect()}
    assert got == {1: ("MIT", "."), 2: ("MIT", "/a"), 3: ("GPL-3.0", "."), 4: ("GPL-3.0", "/a/b/c"), 5: (None, None), 6: ("Apache-2.0", "."), 7: (None, None)}


def wrapped(text, width):
    words, lines = text.split(), [[]]
    for w in words:
        if len(" ".join([*lines[-1], w])) > width:
            lines.append([])
        lines[-1].append(w)
    return "\n".join(map(" ".join, lines))


def test_each_template_is_found_by_its_own_text(spark):
    """One-line notices, and whole licence texts that are wrapped, also in a document with other text."""
    own = [(name, text) for name, text in license_scan.TEMPLATES] + [(name, wrapped(text, 60)) for name, text in license_scan.FILES]
    rows = [(k, f"d{k}", "x", text) for k, (_, text) in enumerate(own)] + [(100, "e", "x", prose(3, 80) + "\n" + own[2][1]), (101, "e", "y", "\n".join(prose(k, 12) for k in range(9)) + "\nThe work of a free person is in use and of this form."), (102, "f", "LICENSE", wrapped("Foo\nCopyright 2020 Bar\n" + license_scan.FILES[0][1], 50))]
    df = spark.createDataFrame(rows, "doc_id long, dir string, name string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df, F.col("dir"), F.col("name")).collect()}
    assert [got[k]["own_licence"] for k in range(len(own))] == [name for name, _ in own]
    assert got[100]["own_licence"] == "MIT" and got[101]["own_licence"] is None
    assert got[102]["own_licence"] == "MIT" and got[102]["is_file"]


def test_licence_terms_are_weighted_by_their_own_frequencies(spark):
    """Against plain Python; words outside of the templates that stand in every header weigh little, however large the corpus."""
    counts = {f"Copyright (c) 2020 Foo{k}. All rights reserved.": 900 for k in range(20)} | {"This file is part of Foo and is licensed under the Apache License, Version 2.0.": 5_000, "Released under the MIT License.": 700}
    terms = lambda x: [w for w in re.split("[^a-z0-9]+", x.lower()) if w]
    total, df = sum(counts.values()), {}
    for line, n in counts.items():
        for w in set(terms(line)):
            df[w] = df.get(w, 0) + n
    vector = lambda x: {w: terms(x).count(w) * (np.log((1 + total) / (1 + df.get(w, 1))) + 1) for w in set(terms(x))}
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    lines = spark.createDataFrame(list(counts.items()), "line string, n long")
    got = {r["line"]: r for r in license_scan.licence_of_lines(lines).collect()}
    for line in counts:
        s, k, name = max((round(cosine(vector(line), vector(text)), 6), -k, name) for k, (name, text) in enumerate(license_scan.TEMPLATES))
        assert got[line]["licence"] == name and abs(got[line]["similarity"] - s) < 2e-6


def test_empty_tables(spark):
    docs, pages = docs_of(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    results = [
        toxicity.score(docs, toxicity.fit(docs, labels)), decontamination.find(docs, benchmark, ["doc_id"]), url_filter.judge(pages, [("block", "x/")]), html_extraction.extract(pages), warc.read(warc.write(pages)),
        simhash.near_duplicates(docs), simhash.one_of_each(docs), sharding.shard(docs), packing.pack(docs), quality.judge(docs), license_scan.scan(docs, F.col("source"), F.col("lang")),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    clean = [(k, prose(k, 80) + ".") for k in range(40)]
    item = prose(500, 40)
    rows = [*clean, (100, clean[0][1]), (101, prose(600, 30) + ". " + item), (102, prose(601, 40) + " vile vile vile."), (103, "### *** " * 40)] + [(200 + k, prose(700 + k, 60) + " vile.") for k in range(12)]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(200 + k, 1, 1) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(40))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    rel = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_sql_of_the_url_filter_walks_aliases(spark):
    con = pytest.importorskip("duckdb").connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    link = '<head><link href="{}" rel=canonical></head>'
    rows = [(1, "http://a.test/x", link.format("http://bad.test/1")), (2, "https://A.test/y#f", '<meta http-equiv="refresh" content="0; url=/x">'), (3, "http://c.test/", link.format("//bad.test/2?a=1&amp;b=2")), (4, "http://good.test/", link.format("http://bad.test/2?a=1&b=2")), (5, None, None), (6, "no-scheme", ""), (7, "http://free.test/a/b", link.format("c"))]
    con.executemany("insert into pages values (?, ?, ?)", rows)
    rules = [("block", "bad.test/"), ("allow", "good.test/")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules)
    want = con.execute(checks.op3(rules)).fetchall()
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict", "carried").collect())) == sorted(want)
    assert {r[0]: r[4] for r in want} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
