"""Each operator against a plain version of itself, and on nulls, empty and very long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from aeroseries.llm import decontamination, html_extraction, language_id, packing, quality_rules, sharding, simhash
from aeroseries.llm import substring_dedup, url_filters, warc
from aeroseries.llm.components import connected_components
from aeroseries.llm.queries import RULES, SHARDS, vocabulary

EDGES = [(1, None), (None, "a b"), (2, ""), (3, " \n\t "), (3, "one two"), (3, "one two"), (4, "wörd " * 30_000), (None, None)]


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


# Packing


def test_packing_places_every_id_once(make_docs):
    from tokenizers import Tokenizer

    rows = EDGES + [(10 + i, "some words, and more. " * (i * 7)) for i in range(40)]
    pieces = packing.pack(make_docs(rows).coalesce(2), vocabulary()).collect()
    plain = Tokenizer.from_file(vocabulary())
    ids = [np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4") for _, text in rows]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    by_doc = {}
    for piece in pieces:
        by_doc.setdefault(piece.doc_id, []).append(piece)
    for (doc_id, _), own in zip(rows, ids):
        if doc_id in (None, 3):  # several rows
            continue
        found = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert [p.start for p in found] == [0, *np.cumsum([p.length for p in found])[:-1].tolist()]
        for p in found:
            assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
            assert p.doc_tokens == len(own)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
        total = sum(p.length for p in own)
        assert total == 1024 or total & (total - 1) == 0 and total < 1024


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(vocabulary()), packing.encoder(vocabulary())
    rng = random.Random(1)
    marks = [" ", "\n", "\t", "a", "'s", "é", "1", ",", "<|endoftext|>", "\x1c", "\x85", "\u3000", "word", "—"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(2_000)]
    for text, ids in zip(texts, encode.encode([text.encode() for text in texts])):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_with_one_hash_are_told_apart():
    """The order of a and b after Thue and Morse and its opposite collide in polynomial hashes modulo 2 ** 64."""
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(vocabulary()), packing.TextEncoder(vocabulary())
    for n in (1_024, 2_048):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        texts = [f"x {word} y", f"x {other} y", f"one {word} and {other}", f"{other}\n{word}", word, other]
        want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
        assert [ids.tolist() for ids in encode.encode([text.encode() for text in texts])] == want
        for text, ids in zip(texts, want):
            assert encode.encode([text.encode()])[0].tolist() == ids


def test_equal_stretches():
    rng = random.Random(5)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(400)]
    pool = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    ends = np.cumsum([len(x) for x in data])
    starts = ends - [len(x) for x in data]
    i, j = np.repeat(np.arange(400), 400), np.tile(np.arange(400), 400)
    found = packing._equal(pool, starts[i], ends[i], pool, starts[j], ends[j])
    assert found.tolist() == [data[a] == data[b] for a, b in zip(i, j)]


def test_sum_of_squares_choice():
    packer = packing.WindowPacker(window=10)
    piece = lambda n: np.zeros(n, "<u4").tobytes()
    for n in (6, 6, 4):
        packer.add(1, piece(n))
    # Two windows at level 6: closing one (sum of squares 1) beats opening a new one at level 4 (sum 5).
    assert packer.levels[6] == 1 and packer.levels[4] == 0 and len(packer.rows) == 2


def test_packing_an_empty_table(make_docs):
    assert packing.pack(make_docs([]), vocabulary()).count() == 0


# Sharding


def test_shards_are_even_and_move_little(make_docs):
    table = sharding.lookup_table(SHARDS)
    shares = np.bincount(table)
    assert shares.max() - shares.min() <= 1
    fewer = sharding.lookup_table(SHARDS[:-1])
    stayed = sum(a == b for a, b in zip(table, fewer) if a != len(SHARDS) - 1)
    assert stayed > 0.8 * sum(a != len(SHARDS) - 1 for a in table)
    with pytest.raises(ValueError):
        sharding.lookup_table(SHARDS, 2040)
    placed = sharding.place(make_docs(EDGES), "doc_id", SHARDS).collect()
    assert len(placed) == len(EDGES) and len({row.shard for row in placed if row.doc_id == 3}) == 1
    for row in placed:
        key = "" if row.doc_id is None else str(row.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (row.slot, row.shard) == (slot, table[slot])
    assert sharding.place(make_docs([]), "doc_id", SHARDS).count() == 0
    other = make_docs(EDGES).withColumnsRenamed({"h": "Slot", "shard": "Shard"})
    clashing = sharding.place(other, "doc_id", SHARDS)
    assert clashing.columns == [*other.columns, "slot", "shard"]
    assert [row[-2:] for row in sorted(clashing.collect(), key=repr)] == [row[-2:] for row in sorted(placed, key=repr)]


def test_write_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"text {i}") for i in range(300)]).drop("shard")
    sharding.write_shards(docs, "doc_id", SHARDS, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in written.collect()} == {(r.doc_id, r.shard) for r in sharding.place(docs, "doc_id", SHARDS).collect()}
    assert written.count() == 300


# Language identification


def test_gradients_are_those_of_the_loss():
    network = language_id.Network.fresh(["a", "b", "c"])
    network.table, network.inner, network.outer, network.bias = (w.astype(np.float64) for w in network.weights())
    data = np.random.default_rng(0).integers(0, 256, (5, 4)).astype(np.uint8)
    target = np.array([0, 1, 2, 1])
    loss = lambda: -np.log(network.labels(network.states(data))[:, target, np.arange(4)]).mean()
    for weights, gradient in zip(network.weights(), network.gradients(data, target)):
        at = np.unravel_index(int(np.argmax(np.abs(gradient))), weights.shape)
        kept, step = weights[at], 1e-2
        weights[at] = kept + step
        up = loss()
        weights[at] = kept - step
        down = loss()
        weights[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(gradient[at], rel=0.01)


def test_language_of_held_out_documents(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs)
    judged = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [row for row in judged if row.held_out]
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in judged)
    assert np.mean([row.lang == row.lang_pred for row in held]) > 0.98
    assert all(0 <= row.score <= 1 for row in judged)


def test_language_edges(make_docs):
    found = language_id.identify(make_docs([(i, t, None) for i, t in EDGES])).collect()
    assert len(found) == len(EDGES) and {row.lang_pred for row in found} == {"und"}
    network = language_id.Network.fresh(["a", "b"])
    found = language_id.identify(make_docs([*EDGES, (9, "12 !?")]), network=network).collect()
    assert sum(row.lang_pred == "und" for row in found) == 5
    assert language_id.identify(make_docs([])).count() == 0


# Substring dedup


def plain_dedup(rows, k=13):
    least, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (1, 0) if i is None else (0, i)
    for i, w in words:
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - k + 1) if least[tuple(w[p : p + k])] < order(i) for q in range(p, p + k)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group, broadcast", [(250_000, 48 << 20), (50, 0)])
def test_substring_dedup(make_docs, monkeypatch, group, broadcast):
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", group)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", broadcast)
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcde") for _ in range(40)) for _ in range(5)]
    rows = [(rng.choice([i, None, i // 2]), rng.choice(pool) + rng.choice([" ", "\n\n"]) + rng.choice(pool)[9:]) for i in range(80)]
    rows += EDGES + rows[:9]
    assert rows_of(substring_dedup.measure(make_docs(rows))) == plain_dedup(rows)


def test_remove_repeats_keeps_columns(make_docs):
    text = " ".join(f"w{i}" for i in range(20))
    docs = make_docs([(1, text), (2, text), (3, f"x {text} y"), (4, "a\nb"), (5, None)])
    kept = substring_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert {row.doc_id: row.text for row in kept.collect()} == {1: text, 3: "x y", 4: "a\nb", 5: None}
    assert substring_dedup.measure(make_docs([])).count() == 0


# HTML extraction

PAGE = (
    "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><a href='/'>Home page</a></nav>"
    "<article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four<br>five<div class='share-box'>Share this</div>"
    "<!-- no --><aside>Side note</aside></article><section id=comments><p>first comment</p></section>"
    "<footer>&copy; all of it</footer></body></html>"
)


def test_html_extraction(spark):
    weights = html_extraction.weights_of(html_extraction.count_kinds(PAGE))
    assert html_extraction.main_text(PAGE, weights) == "A & B\n\nOne two three.\n\nFour five"
    assert html_extraction.main_text("<p>Only &lt;text&gt;</p>", weights) == "Only <text>"
    assert html_extraction.main_text("<article><p>open <!-- never closed", weights) == "open"
    rows = [(1, None, None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<p>" + "long " * 90_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {row.page_id: row for row in html_extraction.extract(pages).collect()}
    assert found[1].text == "" and found[2].n_chars == 0 and found[3].n_chars == len("A & B\n\nOne two three.\n\nFour five") and found[None].n_chars == 449_999
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_asides_within_an_article_do_not_cut_it():
    def page(wrapper, tag, lead, advert):
        advert = "".join(f"<p>{advert}</p>" for _ in range(3))
        body = f"<{tag}><h1>Head line</h1><p>{lead}</p><div class=advert>{advert}</div><p>{'body ' * 100}</p></{tag}>"
        return f"<body><div class='{wrapper}'><nav>menu {'item ' * 30}</nav>{body}<footer>foot</footer></div></body>"

    trained = sum((html_extraction.count_kinds(page("page", "article", "lead " * 40, "buy " * 5)) for _ in range(50)), Counter())
    weights = html_extraction.weights_of(trained)
    want = "Head line\n\nA short lead.\n\n" + ("body " * 100).strip()
    for tag in ("article", "main", "div"):
        for wrapper in ("page", "page has-sidebar"):
            assert html_extraction.main_text(page(wrapper, tag, "A short lead.", "buy this now " * 20), weights) == want
    assert html_extraction.main_text(page("page widget", "article", "A short lead.", "buy this now " * 20), weights) == want
    comments = page("page", "article", "A short lead.", "buy") + "<div class=comments><article>a comment</article></div>"
    assert html_extraction.main_text(comments, weights) == want


def test_best_run():
    assert html_extraction.best_run([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert html_extraction.best_run([-1, -2]) == (0, 0) == html_extraction.best_run([])


# Quality rules


def plain_quality(text):
    words = (text or "").encode().split()
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\x0b\x0c\r")]
    windows = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
    seen = {w for w in windows if windows.count(w) > 1}
    repeats = len({p + k for p, w in enumerate(windows) if w in seen for k in range(5)})
    chars = sum(len(word.decode()) for word in words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed


def test_quality_figures(make_docs):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "b ", "ç\n", "#\t", "x y z\n", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [row for row in EDGES if len(row[1] or "") < 1000]
    found = quality_rules.measure(make_docs(rows)).collect()
    assert sorted((r.doc_id, *r[1:7]) for r in found if r.doc_id) == sorted((i, *plain_quality(t)) for i, t in rows if i)
    assert all(not row.kept for row in found if row.base_failed)
    good = " ".join(f"word{i}" for i in range(30))
    kept = quality_rules.keep_good(make_docs([(1, good), (1, good), (2, good.upper()), (3, None), (4, "a| " * 9 + good)]))
    assert [row.doc_id for row in kept.collect()] == [1, 1]
    assert quality_rules.measure(make_docs([])).count() == 0


def test_cascade_order(make_docs):
    rules = {rule.name: rule for rule in quality_rules.RULES}
    text, words = quality_rules.F.col("text"), quality_rules.words_of(quality_rules.F.col("text"))
    docs = make_docs([(1, "## ## ##"), (2, "plain words here")])
    for names in (["symbols", "capitals"], ["capitals", "symbols"]):
        verdict = quality_rules.rejected_by([rules[name] for name in names], text, words)
        assert [row[0] for row in docs.orderBy("doc_id").select(verdict).collect()] == ["symbols", None]


# SimHash


def plain_fingerprint(text, width):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[p : p + width]) for p in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(shingle, 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {fp: fp for fp in prints}

    def root(fp):
        while parent[fp] != fp:
            fp = parent[fp]
        return fp

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {fp: root(fp) for fp in parent}


def test_simhash_components(make_docs):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    rows = list(EDGES[:6]) + [(20 + i, rng.choice(base) + rng.choice(["", " z", " Q q"])) for i in range(60)]
    found = simhash.components(make_docs(rows)).select("doc_id", simhash.hex_fingerprint(simhash.F.col("fp")), "component_id")
    prints = [plain_fingerprint(text, 3) for _, text in rows]
    roots = plain_components(prints)
    least = {}
    for (doc_id, _), fp in zip(rows, prints):
        if doc_id is not None:
            least[roots[fp]] = min(least.get(roots[fp], doc_id), doc_id)
    want = [(i, f"{fp:016x}", least.get(roots[fp])) for (i, _), fp in zip(rows, prints)]
    assert rows_of(found) == sorted(want, key=repr)
    assert simhash.components(make_docs([])).count() == 0


@pytest.mark.parametrize("group", [4_000, 40, 5])
def test_ball_links_find_all_within_three_bits(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP_FINGERPRINTS", group)
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        prints.add(base)
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 6), replace=False).tolist()
            prints.add(base ^ sum(1 << bit for bit in flips))
    signed = lambda fp: fp - (1 << 64) if fp >> 63 else fp
    links = simhash.links(spark.createDataFrame([(signed(fp),) for fp in prints], "fp bigint"))
    found = {row.node: row.component for row in connected_components(links).collect()}
    groups = lambda of: sorted(sorted(fp for fp in prints if of(fp) == key) for key in {of(fp) for fp in prints})
    want = plain_components(prints)
    assert groups(lambda fp: found.get(signed(fp), signed(fp))) == groups(want.get)


def test_keep_one_of_each_group(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    kept = simhash.keep_one(make_docs([(5, text), (2, text), (7, "other words than those before"), (2, text)]))
    assert sorted(row.doc_id for row in kept.collect()) == [2, 2, 7]


def test_keep_one_leaves_the_first_of_each_component(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200))) for i in range(20)]
    rows += [(100 + i, text.upper().replace(" ", "\n")) for i, text in rows[:7]] + [(-3, rows[4][1]), (200, None), (201, " ")]
    docs = make_docs(rows)
    found = {row.doc_id: row.component_id for row in simhash.components(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == set(found.values()) == {*range(20), -3, 200} - {4}
    assert simhash.keep_one(make_docs([])).count() == 0


def test_warc_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(__import__("pathlib").Path(__file__).parents[2]))
    large, same = "lärge " * 50, "same " * 40
    rows = [(5, "http://b.org/x", same), (2, "http://a.b.org/y z\n", same), (9, None, large), (7, "http://b.org/x", "tiny")]
    rows += [(8, "http://b.org/x", "tiny"), (2, "http://c.net", same), (None, "http://c.net", same), (1, "http://c.net", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file:{tmp_path}/archives"
    index = warc.build_index(warc.write_archives(pages, folder))
    found = rows_of(warc.read_all(index, folder))
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = html == same and page_id != 2
        digest = hashlib.sha256(body).hexdigest()
        want.append((page_id, len(body), digest, "revisit" if revisit else "response", 2 if revisit else None))
    assert found == sorted(want, key=repr)
    looked = warc.lookup(index, folder, spark.createDataFrame([("https://B.org/x",), ("http://no.org/",)], "url string"))
    assert sorted(row.page_id for row in looked.collect()) == [5, 7, 8]
    # All records once by their own URLs, however the directory is cut and the keys are shared out.
    for name, value in (("MAX_DIRECTORY", 1), ("KEYS_AT_ONCE", 1)):
        assert rows_of(warc.lookup(index, folder, pages).drop("key")) == found
        monkeypatch.setattr(warc, name, value)
    assert rows_of(warc.lookup(index, folder, pages).drop("key")) == found
    empty = f"file:{tmp_path}/none"
    nothing = warc.build_index(warc.write_archives(pages.limit(0), empty))
    assert warc.read_all(nothing, empty).count() == warc.lookup(nothing, empty, pages).count() == 0


def test_warc_keys_with_line_breaks_and_percent_signs(spark, tmp_path):
    urls = ["http://b.org/x\ny", "http://b.org/a\nb", "http://b.org/x", "http://b.org/x%0Ay", "http://b.org/x%250Ay", "http://b.org/x\r\ny"]
    urls += [f"http://b.org/{c}{i}" for c in "!%&\n~" for i in range(400)]
    pages = spark.createDataFrame([(i, url, f"page {i}") for i, url in enumerate(urls)], "page_id bigint, url string, html string")
    folder = f"file:{tmp_path}/archives"
    index = warc.build_index(warc.write_archives(pages, folder))
    for i in range(6):
        asked = spark.createDataFrame([(urls[i],)], "url string")
        assert [row.page_id for row in warc.lookup(index, folder, asked).collect()] == [i]
    assert sorted(row.page_id for row in warc.lookup(index, folder, pages).collect()) == list(range(len(urls)))


# Decontamination


def plain_alignment(item, passage):
    best = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = 2 if item[i - 1] == passage[j - 1] else -1
            best[i][j] = max(0, best[i - 1][j - 1] + same, best[i - 1][j] - 1, best[i][j - 1] - 1)
    return max(map(max, best))


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, passage = (rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        score, matched, start, end = decontamination.align(item, passage)
        assert score == plain_alignment(item.tolist(), passage.tolist()) and 0 <= start <= end <= len(passage)


def test_leaks_are_found_and_clean_documents_left(make_docs, spark):
    item = " ".join(f"item{i}" for i in range(30))
    edited = " ".join(("changed" if i % 7 == 3 else w) for i, w in enumerate(item.split()) if i != 12)
    clean = " ".join(f"other{i}" for i in range(200))
    rows = [(1, f"{clean} {item.upper()}. {clean}"), (2, f"{clean} {edited}, {clean}"), (3, clean), (4, item[:60]), (5, "short one")]
    rows += [(6, f"Some  SHORT, one {item}"), *((10 * i, t) for i, t in EDGES if i), (None, clean), (1, clean)]
    tests = spark.createDataFrame([(10, item), (11, None), (12, "short one"), (10, item)], "item_id bigint, text string")
    found = decontamination.find(make_docs(rows), tests).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 10), (2, 10), (5, 12), (6, 10), (6, 12)]
    exact = next(r for r in found if (r.doc_id, r.item_id) == (1, 10))
    assert (exact.score, exact.start_word, exact.end_word) == (1.0, 200, 230)
    kept = decontamination.clean(make_docs(rows), tests)
    assert {row.doc_id for row in kept.collect()} == {3, 4, 10, 20, 30, 40, None} and kept.columns == make_docs([]).columns
    assert decontamination.find(make_docs([]), tests).count() == 0 == decontamination.find(make_docs(rows), tests.limit(0)).count()


def test_one_exact_and_many_equal_edited_copies(make_docs, spark):
    item = [f"item{i}" for i in range(40)]
    edited = " ".join("changed" if i % 7 == 3 else w for i, w in enumerate(item))
    rows = [(0, " ".join(item)), *((i, f"before it {edited} after") for i in range(1, 1_001)), (2_000, "item4 item5 item6 item8")]
    rows.append((2_001, "item4 item5 item6 item7 and no more"))
    tests = spark.createDataFrame([(10, " ".join(item))], "item_id bigint, text string")
    found = decontamination.find(make_docs(rows), tests).collect()
    assert sorted(r.doc_id for r in found) == list(range(1_001))


def test_a_shared_stem_joins_nothing_and_own_words_do(make_docs, spark):
    stem = " ".join(f"stem{i}" for i in range(12))
    own = [" ".join(f"own{k}x{i}" for i in range(8)) for k in range(2_000)]
    items = spark.createDataFrame([(k, f"{stem} {own[k]}") for k in range(2_000)], "item_id bigint, text string")
    docs = make_docs([(1, stem), (2, f"{stem} and again {stem} " * 10), (3, f"before {stem} {own[7]} after"), (4, f"{own[9]} alone")])
    assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, items).collect()} == {(3, 7)}
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {1, 2, 4}
    # Items that share all they have are found all the same.
    same = spark.createDataFrame([(k, stem) for k in range(20)] + [(99, stem + " end")], "item_id bigint, text string")
    assert decontamination.find(docs.where("doc_id = 1"), same).count() == 21


def test_find_equals_brute_force(make_docs, spark, monkeypatch):
    rng = random.Random(11)
    kinds = [f"w{i}" for i in range(25)]
    draw = lambda n: [rng.choice(kinds) for _ in range(n)]
    items = [draw(rng.randint(1, 9)) for _ in range(60)] + [["w0", "w1", "w2", "w3", *draw(4)] for _ in range(12)]
    docs = []
    for item in items + items[-12:]:
        body = [w if rng.random() < 0.8 else rng.choice(kinds) for w in item]
        docs.append(draw(rng.randint(0, 3)) + body + draw(rng.randint(0, 3)))
    held = Counter()
    grams = []
    for item in items:
        n = min(4, len(item))
        grams.append({tuple(item[i : i + n]) for i in range(len(item) - n + 1)})
    for texts in {tuple(item): own for item, own in zip(items, grams)}.values():
        held.update(texts)
    want = set()
    number = {kind: np.uint64(i) for i, kind in enumerate(kinds)}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            least = min(held[g] for g in grams[i])
            seeds = {g for g in grams[i] if held[g] <= max(decontamination.RARE_ITEMS, least)}
            n = min(4, len(item))
            if seeds & {tuple(doc[k : k + n]) for k in range(len(doc) - n + 1)}:
                score = decontamination.align(np.array([number[w] for w in item]), np.array([number[w] for w in doc]))[0]
                if score >= 0.5 * 2 * len(item):
                    want.add((d, i, round(score / (2 * len(item)), 9)))
    table = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id bigint, text string")
    for grams_at_once in (2_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK_GRAMS", grams_at_once)
        found = decontamination.find(make_docs([(d, " ".join(doc)) for d, doc in enumerate(docs)]), table).collect()
        assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in found} == want and len(found) == len(want) > 60


def test_case_and_punctuation_of_any_script(make_docs, spark):
    items = ["Žluťoučký kůň úpěl Ďábelské ódy", "привет мир как твои дела", "人人生而自由在尊严和权利上一律平等", "Ñandú Élan über Ärger Öl"]
    rows = [
        (0, "x “ŽLUŤOUČKÝ—KŮŇ…úpěl ďábelské ÓDY” y"), (1, "ПРИВЕТ, МИР — «как» ТВОИ ДЕЛА!"), (2, "他说人人生而自由，在尊严和权利上一律平等的"),
        (3, "n\u0303andu\u0301\u00a0éLAN ÜBER äRGER’öl"), (4, "人 自 — ñ"),
    ]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.find(make_docs(rows), tests).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in found) == [(i, i, 1.0) for i in range(4)]


# URL filters


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "myexample.com", "org", "b.org", "", "..", "a..net"]
    paths = ["", "/", "/en", "/en/x?q=/de/", "/de/#top", "/fr/", "?x", "#y"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "a://", "x://y://net/"]
    rules = [*RULES, ("a.example.net", "/en/", "block"), ("net", "/en/x", "allow"), (None, "/", "block"), ("com", "/de/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1])], "page_id bigint, url string")
    listed = spark.createDataFrame(rules + rules[:1], "host string, path string, verdict string")
    found = sorted(tuple(row) for row in url_filters.judge(pages, listed).collect())
    assert [row[0] for row in found] == sorted([*range(len(urls)), 1])
    for page_id, *rest in found:
        assert tuple(rest) == plain_verdict(urls[page_id], rules), urls[page_id]
    assert url_filters.judge(pages.limit(0), listed).count() == 0
    assert {row.verdict for row in url_filters.judge(pages, listed.limit(0)).collect()} == {"allow"}
