"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, extra
columns with clashing names, and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import embedding_dedup, fertility, html_extract, jaccard_join, packing, pair_rank, source_mix, substring_dedup, suffix_dedup, suffix_sort, word_tokens

RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghié"), RNG.integers(1, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


BASE, PASSAGE, LONG = prose(120), prose(60), prose(4000)
EDITED = BASE.split()
EDITED[40] = "changed"
TEXTS = [
    BASE, BASE, " ".join(EDITED), None, "", "  \n\t ", "one", "one two three", "One TWO three", prose(30) + " " + PASSAGE + " " + prose(20), prose(25) + "\n" + PASSAGE, LONG, LONG + " tail " + prose(10),
    "x " * 300, prose(80), "l1 l2\nl1 l2\n\nl1 l2 # $ <b>", BASE.upper(),
]
ROWS = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i * 10, "clash") for i, t in enumerate(TEXTS)] + [(0, BASE, None, None, 0, "clash"), (None, prose(50), "en", "s1", 1, "clash")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


def table(spark, extra: str, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA.format(extra))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def covered(sequences: list, length: int) -> list[list[bool]]:
    counts = collections.Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def as_counter(rows):
    return collections.Counter(rows)


def test_substring_dedup(spark):
    out = substring_dedup.remove_repeats(table(spark, "n_removed")).collect()
    sequences = [words(r[1]) for r in ROWS]
    expected = []
    for r, s, gone in zip(ROWS, sequences, covered(sequences, 35)):
        kept = b" ".join(w for w, g in zip(s, gone) if not g)
        expected.append((r[0], len(s), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert as_counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == as_counter(expected)
    same = {r.doc_id: r.kept_text for r in out if r.n_removed == 0}
    assert same[15] == TEXTS[15] and same[5] == TEXTS[5]
    assert all(words(r.kept_text) == [w for w, g in zip(*next((s, g) for x, s, g in zip(ROWS, sequences, covered(sequences, 35)) if x[0] == r.doc_id)) if not g] for r in out if r.doc_id is not None)


def test_suffix_dedup(spark):
    out = suffix_dedup.remove_repeats(table(spark, "n_bytes")).collect()
    sequences = [(r[1] or "").encode() for r in ROWS]
    expected = []
    for r, s, gone in zip(ROWS, sequences, covered(sequences, 200)):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        expected.append((r[0], len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert as_counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == as_counter(expected)


def test_suffix_dedup_deals_large_buckets_anew(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2)
    rows = [(i, prose(9) + " " + PASSAGE + " " + prose(9)) for i in range(12)]
    out = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sequences = [t.encode() for _, t in rows]
    for (i, _), s, gone in zip(rows, sequences, covered(sequences, 200)):
        assert out[i] == (sum(gone), hashlib.sha256(bytes(b for b, g in zip(s, gone) if not g)).hexdigest())


def test_suffix_array():
    for n in range(1, 40):
        text = RNG.integers(97, 100, n).astype(np.uint8)
        raw = text.tobytes()
        assert [raw[i:] for i in suffix_sort.suffix_array(text, 200)] == sorted(raw[i:] for i in range(n))
    found = suffix_sort.repeated_starts([b"abcdefghijkl", b"zzabcdefghizz", b"single-one"], np.array([1, 1, 2]), 8)
    assert [x.tolist() for x in found] == [[0, 1], [2, 3], [0, 1, 2]]


def test_jaccard_join(spark):
    out = jaccard_join.near_duplicates(table(spark, "component_id")).collect()
    sets = {}
    for r in ROWS:
        w = [x.lower() for x in words(r[1])]
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    component = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    assert len(out) == len(ROWS)
    for r in out:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is not None:
            assert r.component_id == component[r.doc_id]


def test_jaccard_join_of_a_large_group(spark):
    base = prose(150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in RNG.integers(0, 150, i % 5):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    out = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    component = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    component[i] = component[j] = min(component[i], component[j])
    assert [out[i] for i in range(60)] == component


def test_packing(spark):
    out = packing.pack(table(spark, "offset")).collect()
    tokenizer = word_tokens.WordBpe(packing.default_tokenizer()).tokenizer
    expected = []
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[start : start + 4096], "<u4")
            expected.append((r[0], piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert as_counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == as_counter(expected)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= -(-sum(r.length for r in out) // 4096) + 1


def test_best_two_fit():
    counts = np.zeros(101, dtype=int)
    for x in RNG.integers(1, 70, 500):
        counts[x] += 1
    patterns = packing.best_two_fit(counts, 100)
    used = collections.Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    assert all(used[x] == counts[x] for x in range(101))
    total = int((counts * np.arange(101)).sum())
    assert sum(n for _, n in patterns) <= -(-total // 100) + 2
    # Greedy takes 60 and 30; two pieces of 19 and 20 fit the place of the 30 more tightly.
    counts = np.zeros(101, dtype=int)
    counts[[60, 30, 20, 19]] = 1
    assert packing.best_two_fit(counts, 100)[0][0] == [60, 20, 19]


def test_sequences_round_trip(spark):
    packed = packing.pack(table(spark, "x"), with_ids=True).cache()
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


@pytest.mark.parametrize("text", ["It's we'll x'", "Straße ÀÉ ﬁ", "a<|endoftext|>b", "İstanbul ΣΑΣ ς", "é café,", "word''' (paren)", "a\xa0b\x1cc\x85d", "123 4.5", "日本語。", "мир!", "😀😀 ok", "\x00\x01", "ABC$$$ def%%%", ""])
def test_word_ids_are_the_tokenizers(text):
    bpe = word_tokens.WordBpe(packing.default_tokenizer())
    assert bpe.ids([text.encode()])[0] == np.array(bpe.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_source_mix(spark):
    rows = [(i, prose(int(n)) if n else None, s, 0) for i, (n, s) in enumerate(zip(RNG.integers(0, 90, 300), RNG.choice(["a", "b", "c", None], 300, p=[0.7, 0.2, 0.05, 0.05])))]
    rows.append(rows[7])
    out = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")).collect()
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s] + 1e-9}
        if not more:
            break
        capped |= more
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - (3 * sizes[r.source] if r.source in capped else level * weight[r.source])) < 1e-6
        taken[r.source] += r.taken
    for r in out:
        assert abs(taken[r.source] - r.target) <= 0.5 + 1e-6
    mixed = source_mix.apply_mix(source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, taken long"))).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(taken.values())


def test_source_mix_of_copies_and_odd_sources(spark):
    """One row is two thirds of its source; sources without words, without a name or with an empty one; clashing columns."""
    rows = [(1, "w " * 7, "a", "t")] * 400 + [(i, "v " * 3, "a", "t") for i in range(2, 200)] + [(500 + i, "u " * 5, "b", None) for i in range(500)]
    rows += [(1000, None, "c", "t"), (1001, "", "c", "t"), (None, "x y", None, "t"), (1003, "z", "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").withColumn("size", F.lit("clash"))
    for weights in ((1, 2, 3), (1, 9, 1)):
        out = source_mix.mix(docs, weights).collect()
        again = source_mix.mix(docs.repartition(3), weights).collect()
        as_rows = lambda x: as_counter((r.doc_id, r.source, r.text, r.size, r.source_size, r.target, r.taken) for r in x)
        assert as_rows(out) == as_rows(again) and len(out) == len(rows)
        taken, target = collections.Counter(), {}
        for r in out:
            assert r.size == len(words(r.text)) and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())
        assert abs(sum(target.values()) - sum(len(words(r[1])) for r in rows)) < 1e-6
    nothing = source_mix.mix(docs.withColumn("source", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in nothing} == {(0, 0, 0.0, 0)}


def test_quality_classifier_of_repeated_and_odd_rows(spark):
    rows = [(i, prose(60) if i % 3 else " | ".join(prose(60).split()).upper()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    learnt = pair_rank.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    labels = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    clash = spark.createDataFrame([(i, t, "s", 7) for i, t in [*rows, (None, "some words"), (None, None)]], "doc_id long, text string, score string, held_out int")
    again = pair_rank.learn(clash, labels)
    assert np.allclose(learnt.weights, again.weights) and learnt.threshold == again.threshold
    out = pair_rank.classify(clash.unionByName(clash), again).collect()
    assert len(out) == 604 and all(type(r.held_out) is bool and 0 <= r.score <= 1 for r in out)
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.score)
    assert all(len(v) == 1 for i, v in by.items() if i is not None) and {r.held_out for r in out if r.doc_id is None} == {False}
    # The threshold is the quantile of all rows that are learned from, whatever the sample of the fit.
    small = pair_rank.learn(clash, labels, sample=60)
    known = [(small.rank(pair_rank.features(np.frombuffer(t.encode(), np.uint8))), i % 3 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    ranks, share = sorted(float(z) for z, _ in known), np.mean([bad for _, bad in known])
    assert abs(small.threshold - ranks[int(np.ceil(share * len(ranks))) - 1]) < 1e-6


def test_embedding_dedup(spark):
    x = RNG.standard_normal((150, 16))
    x[10:30] = x[10] + 0.05 * RNG.standard_normal((20, 16))
    x[40:45] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [1.0, None] + [1.0] * 14), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [3e200] * 16), (208, [1e-200] * 16)]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    link = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    component = {i: i for i, _ in rows}
    for _ in rows:
        for i, js in link.items():
            for j in js:
                component[i] = component[j] = min(component[i], component[j])
    for i, _ in rows:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (len(link.get(i, ())), component[i], component[i] == i)


def test_embedding_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    x = np.repeat(RNG.standard_normal((3, 16)), 12, axis=0) + 0.02 * RNG.standard_normal((36, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(11, 0), (11, 12), (11, 24)}


@pytest.mark.parametrize("tile,rows,dim", [(1 << 15, 1024, 24), (16, 8, 24), (64, 1024, 3)])
def test_embedding_links_are_those_of_all_pairs(spark, monkeypatch, tile, rows, dim):
    for name, x in (("TILE", tile), ("ROWS", rows), ("COLUMNS", 2 * rows)):
        monkeypatch.setattr(embedding_dedup, name, x)
    rng = np.random.default_rng(tile)
    x = rng.standard_normal((400, dim))
    x[:120] = x[0] + 0.1 * np.abs(x[0]).mean() * rng.standard_normal((120, dim))  # one hot group of near copies
    x[120:200] = x[120] + 0.25 * np.abs(x[120]).mean() * rng.standard_normal((80, dim))  # links in part only
    x[200] = np.eye(dim)[0]
    x[201] = 0.95 * np.eye(dim)[0] + (1 - 0.95**2) ** 0.5 * np.eye(dim)[1]  # at the threshold
    x[202] = (0.95 - 1e-9) * np.eye(dim)[0] + (1 - (0.95 - 1e-9) ** 2) ** 0.5 * np.eye(dim)[2]  # just below it
    x[203:206] = x[210]
    table = spark.createDataFrame([(i + 5, [float(v) for v in r], 1, True) for i, r in enumerate(x)], "vec_id long, embedding array<double>, n_links int, copies boolean")
    out = {r.vec_id - 5: r for r in embedding_dedup.near_duplicates(table).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = np.einsum("ik,jk->ij", unit, unit) >= 0.95
    links[200, 201] = links[201, 200] = out[201].n_links - (links[201].sum() - links[201, 200] - 1) == 1  # either, by rounding
    component = np.arange(400)
    for _ in range(400):
        new = np.where(links, component[None, :], 400).min(axis=1)
        if (new == component).all():
            break
        component = new
    assert [out[i].n_links for i in range(400)] == (links.sum(1) - 1).tolist()
    assert [out[i].component_id - 5 for i in range(400)] == component.tolist()
    assert all(r.copies for r in out.values())


def test_embeddings_with_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(4, v), (4, v), (None, v), (7, w), (None, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in out) == [(-1, 0), (-1, 2), (4, 2), (4, 2), (7, 0)]


def test_quality_rules(spark):
    rows = ROWS + [(500 + i, prose(100), "en", "s", 0, "") for i in range(150)] + [(900, " | ".join(prose(1) + "$$$" for _ in range(100)), "en", "s", 0, "")]
    out = fertility.quality_rules(table(spark, "kept", rows)).collect()
    expected = []
    for r in rows:
        text = r[1] or ""
        w = [x.decode() for x in words(text)]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = sum(covered([w], 3)[0]) if len(w) >= 3 and n else 0
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        expected.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again, failed))
    assert as_counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == as_counter(expected)
    assert not any(r.kept for r in out if r.base_failed or r.doc_id == 900)
    assert all(r.kept for r in out if r.doc_id and 500 <= r.doc_id < 650)


def test_quality_classifier(spark):
    rows = [(i, prose(60) if i % 3 else " | ".join(prose(60).split()).upper()) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(1, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in pair_rank.classify(docs, pair_rank.learn(docs, labels)).collect()}
    for i, _ in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i].score <= 1 and out[i].predicted == (out[i].score >= 0.5)
    assert np.mean([out[i].predicted == (i % 3 > 0) for i in range(400) if out[i].held_out]) > 0.97
    nothing = pair_rank.learn(docs, labels.where("false"))
    assert {r.score for r in pair_rank.classify(docs, nothing).collect()} == {0.5}


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1><ul class=menu><li><a href=/>Home</a></ul></header><div class='cookie-notice'>We use cookies</div>"
    "<main><article><h1>Title &amp; more</h1><p>First&nbsp;para\n <a href=x>link</a> text.<p>Sec<b>ond</b> &lt;last<br>line</p><form><input>go</form><div class='comments'><p>I disagree</p></div></article></main><aside>side</aside><footer>foot</footer></body></html>"
)


def test_html_extraction(spark):
    bare = "<body><div id=nav><a href=/a>A</a> <a href=/b>B</a></div><div><h2>Head</h2><p>Long text of several words goes here.</p><p>More of the words here.</p></div><div id=sidebar><p>Popular</p></div><p>"
    pages = [(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (4, "u", "<nav>only a menu</nav>", "t"), (5, "u", bare, "t"), (6, "u", PAGE, "t"), (7, "u", "plain words only", "t"), (8, "u", "<p>" + "w " * 50_000, "t")]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert out[1].text == out[6].text == "Title & more First para link text. Second <last line"
    assert (out[2].text, out[3].text, out[4].text, out[2].n_chars) == ("", "", "", 0)
    assert out[5].text == "Head Long text of several words goes here. More of the words here."
    assert out[7].text == "plain words only" and out[8].n_chars == 99_999


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, jaccard_join.near_duplicates, packing.pack, source_mix.mix, fertility.quality_rules])
def test_empty_tables(spark, operator):
    assert operator(table(spark, "x").where("false")).count() == 0


def test_empty_tables_of_other_kinds(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    docs = table(spark, "x").where("false")
    assert pair_rank.classify(docs, pair_rank.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
